"""Turtle files as triples, a large file by many tasks.

Only strings in three quotes run over line ends, so at the start of a line a reader is in one of
three states: outside strings, or in a long one of either quote. A first pass tells for each
split of a file which state each of the three leads to; composed in the order of splits, these
give the state that each split starts in. A second pass cuts splits where a line ends with a
full stop outside strings, which ends a statement at any depth of brackets. What stands before
the first and after the last cut of a split is put together with its neighbours. Pieces are
parsed by themselves, with the prefixes and bases that stand before them in the file.

Terms are absolute: ``<address>``, or a short name if its namespace is among those given; blank
nodes are ``_:`` and a name that no other file shares. Literals keep datatype and language.

Defined cases: a file with an error gives a row of errors and no triples, and others are read;
two objects without a comma, undeclared prefixes, unknown escapes and an unfinished statement
are errors; an empty file has no triples; triples of one graph that are alike come once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.storage import BROADCAST_BYTES, sized, written

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Characters that a piece for the parser holds, but for a longer statement.
PIECE_CHARS = 1 << 16
OUTSIDE, IN_DOUBLE, IN_SINGLE = range(3)

#: The words of the language, from its grammar.
TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]++|\#[^\n\r]*+)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+>)
    |(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
    |(?P<short>"(?:[^"\\\n\r]|\\.)*+"|'(?:[^'\\\n\r]|\\.)*+')
    |(?P<at>@[A-Za-z]++(?:-[A-Za-z0-9]+)*+)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:[0-9]*\.[0-9]+|[0-9]+\.(?=[eE])|[0-9]+)(?:[eE][+-]?[0-9]+)?(?![\w:%-]))
    |(?P<mark>[;,.\[\]()])
    |(?P<word>(?:[^\s<>"'\#;,.()\[\]\\@^{}|`]|\\.)++(?:\.+(?:[^\s<>"'\#;,.()\[\]\\@^{}|`]|\\.)+)*+)""",
    re.VERBOSE | re.DOTALL,
)
LONG_START = re.compile(r"\"{3}|'{3}")
LONG_REST = {
    IN_DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*+"{3}', re.DOTALL),
    IN_SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*+'{3}", re.DOTALL),
}
ABSOLUTE = re.compile("[A-Za-z][A-Za-z0-9+.-]*+:")
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
ESCAPED = dict(zip("tbnrf\"'\\", "\t\b\n\r\f\"'\\", strict=True))
DIRECTIVE = re.compile("@prefix|@base|(?i:prefix|base)")

PIECE_SCHEMA = "file string, block bigint, n bigint, loose boolean, closes boolean, text string"
TRIPLE_SCHEMA = "s string, p string, o string, kind string, datatype string, lang string, graph string"


DIRECTIVE_ARROW = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("i", pa.int64()), ("name", pa.string()), ("address", pa.string())]
)
PARSED_ARROW = pa.schema([(c, pa.string()) for c in ("s", "p", "o", "kind", "datatype", "lang", "graph", "file", "error")])


def after_line(line: str, state: int) -> tuple[int, bool]:
    """The state after a line that begins in ``state``, and whether a statement ends with it."""
    if state == OUTSIDE and '"""' not in line and "'''" not in line and "#" not in line and not line.rstrip().endswith("."):
        return state, False
    at, last = 0, ""
    while at < len(line):
        if state:
            rest = LONG_REST[state].match(line, at)
            if not rest:
                return state, False
            at, state, last = rest.end(), OUTSIDE, "long"
        elif m := LONG_START.match(line, at):
            at, state = m.end(), IN_DOUBLE if m[0][0] == '"' else IN_SINGLE
        elif m := TOKEN.match(line, at):
            at = m.end()
            if m.lastgroup != "skip":
                last = m[0] if m.lastgroup == "mark" else m.lastgroup
        else:  # the parser will say what is wrong
            at, last = at + 1, "?"
    return state, state == OUTSIDE and last == "."


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The first row of each split in a task, and its lines, which have to be read in turn."""
    here: list[tuple | None] = [None]

    def rows() -> Iterator[tuple[str, int, str, int]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "state")), strict=True)

    each = rows()
    row = next(each, None)
    while row is not None:
        here = [row]

        def lines() -> Iterator[str]:
            first = here[0]
            while here[0] is not None and here[0][:2] == first[:2]:
                yield here[0][2] or ""
                here[0] = next(each, None)

        yield row, lines()
        row = here[0]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines in the order they have within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def starts(lines: DataFrame) -> DataFrame:
    """(file, block, state) of splits that begin within a long string."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, *_), own in runs(batches):
            states = [OUTSIDE, IN_DOUBLE, IN_SINGLE]
            for line in own:
                if '"' in line or "'" in line:
                    states = [after_line(line, s)[0] for s in states]
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "leads": states}])

    def compose(blocks: pd.DataFrame) -> pd.DataFrame:
        state, out = OUTSIDE, []
        for row in blocks.sort_values("block").itertuples():
            out.append((row.file, row.block, state))
            state = int(row.leads[state])
        return pd.DataFrame(out, columns=["file", "block", "state"])

    leads = lines.withColumn("state", F.lit(0)).mapInArrow(lead, "file string, block bigint, leads array<bigint>")
    found = leads.groupBy("file").applyInPandas(compose, "file string, block bigint, state int")
    return written(found.where("state > 0"), "turtle-starts")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, text): whole statements of the files, in pieces, written."""
    lines = lines_of(spark, path)
    within = starts(lines)
    small = within.count() * 300 < BROADCAST_BYTES
    within = F.broadcast(within) if small else within

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, n: int, text: list[str], loose: bool, closes: bool) -> pa.RecordBatch:
            values = (key[0], key[1], n, loose, closes, "".join(text))
            names = ("file", "block", "n", "loose", "closes", "text")
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))])

        for (file, block, _, state), own in runs(batches):
            text, size, n, state = [], 0, 0, state or OUTSIDE
            for line in own:
                if block == 0 and not n and not text:
                    line = line.removeprefix("﻿")
                text.append(line + "\n")
                size += len(line) + 1
                state, ends = after_line(line, state)
                if ends and (n == 0 or size >= PIECE_CHARS):
                    yield row((file, block), n, text, n == 0, True)
                    text, size, n = [], 0, n + 1
            if text:
                yield row((file, block), n, text, n == 0 or not ends, ends)

    # Lines keep their order in a join with a broadcast side; after an exchange they need a sort.
    lines = lines.join(within, ["file", "block"], "left")
    if not small:
        lines = lines.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    found = written(lines.mapInArrow(cut, PIECE_SCHEMA), "turtle-pieces")
    # Ends of splits: those up to one that closes belong together.
    order = W.partitionBy("file").orderBy("block", "n").rowsBetween(W.unboundedPreceding, -1)
    loose = found.where("loose").withColumn(
        "group", F.coalesce(F.sum(F.col("closes").cast("bigint")).over(order), F.lit(0))
    )
    whole = loose.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text"))).alias("parts"))
    whole = whole.selectExpr("file", "parts[0].block as block", "parts[0].n as n", "array_join(parts.text, '') as text")
    return found.where("not loose").select("file", "block", "n", "text").unionByName(whole)


@dataclass
class Scope:
    """Prefixes and base at a place of a file, and what its blank nodes are called."""

    prefixes: dict[str, str]
    base: str
    file: str
    place: str

    def resolve(self, address: str) -> str:
        if not self.base or ABSOLUTE.match(address):
            return address
        found = urljoin(self.base, address)
        return found + "#" if address.endswith("#") and not found.endswith("#") else found


def unescaped(value: str) -> str:
    if "\\" not in value:
        return value

    def one(m: re.Match) -> str:
        if len(m[1]) > 1:
            return chr(int(m[1][1:], 16))
        if m[1] not in ESCAPED:
            raise ValueError(f"unknown escape \\{m[1]}")
        return ESCAPED[m[1]]

    return ESCAPE.sub(one, value)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no Turtle here: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "skip":
            yield m.lastgroup, m[0]
    yield "end", ""


#: A term: kind, value, datatype, language.
Term = tuple[str, str, str | None, str | None]


@dataclass
class Frame:
    """An open statement, property list (``[``) or collection (``(``)."""

    opened: str = ""
    subject: Term | None = None
    predicate: Term | None = None
    has_object: bool = False
    alone: bool = False  # a property list may stand without a predicate
    last: Term | None = None  # of a collection


class Parser:
    """Triples of whole statements, and the directives among them."""

    def __init__(self, scope: Scope):
        self.scope, self.triples, self.directives = scope, [], []
        self.stack, self.made = [Frame()], 0

    def fresh(self) -> Term:
        self.made += 1
        return "blank", f"_:{self.scope.place}n{self.made}", None, None

    def iri(self, kind: str, word: str) -> Term:
        if kind == "iri":
            return "iri", self.scope.resolve(unescaped(word[1:-1])), None, None
        prefix, colon, local = word.partition(":")
        if not colon:
            raise ValueError(f"not a name: {word!r}")
        if prefix == "_":
            return "blank", f"_:{self.scope.file}b{local}", None, None
        if prefix not in self.scope.prefixes:
            raise ValueError(f"prefix {prefix!r} is not declared")
        return "iri", self.scope.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None

    def emit(self, s: Term, p: str, o: Term) -> None:
        self.triples.append((s, p, o))

    def term(self, term: Term, alone: bool = False) -> None:
        frame = self.stack[-1]
        if frame.opened == "(":
            node = self.fresh()
            if frame.last is None:
                frame.subject = node
            else:
                self.emit(frame.last, RDF + "rest", node)
            self.emit(node, RDF + "first", term)
            frame.last = node
        elif frame.subject is None:
            if term[0] == "literal":
                raise ValueError(f"a literal as subject: {term[1]!r}")
            frame.subject, frame.alone = term, alone
        elif frame.predicate is None:
            if term[0] != "iri":
                raise ValueError(f"no predicate: {term[1]!r}")
            frame.predicate = term
        elif frame.has_object:
            raise ValueError(f"two objects without a comma: {term[1]!r}")
        else:
            self.emit(frame.subject, frame.predicate[1], term)
            frame.has_object = True

    def mark(self, mark: str) -> None:
        frame = self.stack[-1]
        complete = frame.has_object or frame.predicate is None and (frame.alone or frame.opened == "[")
        if mark in "[(":
            self.stack.append(Frame(mark, self.fresh() if mark == "[" else None))
        elif mark == "]" and frame.opened == "[" and complete:
            self.stack.pop()
            self.term(frame.subject, alone=frame.alone or frame.has_object)
        elif mark == ")" and frame.opened == "(":
            self.stack.pop()
            nil = ("iri", RDF + "nil", None, None)
            if frame.last is not None:
                self.emit(frame.last, RDF + "rest", nil)
            self.term(frame.subject or nil)
        elif mark == "," and frame.has_object:
            frame.has_object = False
        elif mark == ";" and frame.subject is not None and (complete or frame.alone and frame.predicate is None):
            frame.predicate, frame.has_object, frame.alone = None, False, True
        elif mark == "." and len(self.stack) == 1 and complete and frame.subject is not None:
            self.stack = [Frame()]
        else:
            raise ValueError(f"{mark!r} out of place")

    def directive(self, word: str, each: Iterator[tuple[str, str]]) -> None:
        name = ""
        if word.lower().endswith("prefix"):
            kind, name = next(each)
            if kind != "word" or name[-1] != ":":
                raise ValueError(f"no prefix: {name!r}")
        kind, address = next(each)
        if kind != "iri":
            raise ValueError(f"no address: {address!r}")
        address = self.scope.resolve(unescaped(address[1:-1]))
        if word[0] == "@" and next(each) != ("mark", "."):
            raise ValueError(f"{word} without a full stop")
        self.directives.append((name, address))
        if name:
            self.scope.prefixes[name[:-1]] = address
        else:
            self.scope.base = address

    def read(self, text: str) -> None:
        each = tokens(text)
        kind, word = next(each)
        while kind != "end":
            first = len(self.stack) == 1 and self.stack[-1].subject is None
            if first and kind in ("at", "word") and DIRECTIVE.fullmatch(word):
                self.directive(word, each)
                kind, word = next(each)
                continue
            if kind in ("long", "short"):
                quotes = 3 if kind == "long" else 1
                value, datatype, lang = unescaped(word[quotes:-quotes]), None, None
                kind, word = next(each)
                if kind == "at":
                    lang = word[1:].lower()
                    kind, word = next(each)
                elif kind == "type":
                    datatype = self.iri(*next(each))[1]
                    kind, word = next(each)
                self.term(("literal", value, datatype, lang))
                continue
            if kind == "mark":
                self.mark(word)
            elif kind == "number":
                exact = "integer" if word.lstrip("+-").isdigit() else "decimal"
                self.term(("literal", word, XSD + ("double" if "e" in word.lower() else exact), None))
            elif word == "a" and self.stack[-1].subject is not None and self.stack[-1].predicate is None:
                self.term(("iri", RDF + "type", None, None))
            elif word in ("true", "false"):
                self.term(("literal", word, XSD + "boolean", None))
            elif kind in ("iri", "word"):
                self.term(self.iri(kind, word))
            else:
                raise ValueError(f"{word!r} out of place")
            kind, word = next(each)
        if len(self.stack) > 1 or self.stack[-1].subject is not None:
            raise ValueError("unfinished statement")


def shortener(names: Mapping[str, str]) -> Callable[[str], str]:
    """Addresses as short names of the longest namespace given, or in angle brackets."""
    spaces = sorted(((space, name) for name, space in names.items()), key=lambda x: -len(x[0]))

    @lru_cache(1 << 16)
    def short(address: str) -> str:
        for space, name in spaces:
            if address.startswith(space) and re.fullmatch(r"[\w-](?:[\w.-]*[\w-])?", address[len(space) :]):
                return f"{name}:{address[len(space) :]}"
        return f"<{address}>"

    return short


def read(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, errors: file, message) of Turtle files; a graph is named after its file.

    ``names`` maps the short names of namespaces, as triples are to have them.
    """
    names = dict(names or {})
    own = written(pieces(spark, path), "turtle-statements")

    def directives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = directives_of(row["text"])
                yield pa.RecordBatch.from_pylist(
                    [{"file": row["file"], "block": row["block"], "n": row["n"], "i": i, "name": a, "address": b}
                     for i, (a, b) in enumerate(found)],
                    DIRECTIVE_ARROW,
                )

    some = own.where(F.rlike("text", F.lit(r"(?i)prefix|base")))
    some = some.mapInArrow(directives, "file string, block bigint, n bigint, i bigint, name string, address string")
    scopes = written(
        some.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "n", "i", "name", "address"))).alias("scope")),
        "turtle-scopes",
    )
    n, size = scopes.agg(F.count("*"), F.sum(F.length(F.to_json("scope")))).first()
    scopes = sized(scopes, n, (size or 0) // max(1, n) + 200)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = shortener(names)
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(parsed(row, short), PARSED_ARROW)

    every = own.join(scopes, "file", "left").mapInArrow(parse, f"{TRIPLE_SCHEMA}, file string, error string")
    every = written(every, "turtle-triples")
    errors = every.where("error is not null").select("file", F.col("error").alias("message"))
    bad = errors.select("file").distinct()
    good = every.where("error is null").join(bad, "file", "left_anti").drop("file", "error").dropDuplicates()
    return good, errors


def directives_of(text: str) -> list[tuple[str, str]]:
    """(name with its colon, or blank for a base; address as written) of a piece's directives."""
    out, first = [], True
    try:
        each = tokens(text)
        for kind, word in each:
            if first and kind in ("at", "word") and DIRECTIVE.fullmatch(word):
                name = next(each)[1] if word.lower().endswith("prefix") else ""
                out.append((name, unescaped(next(each)[1][1:-1])))
                first = word[0] != "@"
            else:
                first = (kind, word) == ("mark", ".")
    except (ValueError, StopIteration):
        pass  # the parser says what is wrong
    return out


def parsed(row: dict, short: Callable[[str], str]) -> list[dict]:
    """Triples of a piece, or its error."""
    file = row["file"]
    mark = hashlib.md5(file.encode()).hexdigest()[:16]
    scope = Scope({}, "", mark, f"{mark}p{row['block']}p{row['n']}")
    graph = file.rsplit("/", 1)[-1]
    for x in row["scope"] or ():
        if (x["block"], x["n"]) >= (row["block"], row["n"]):
            break
        address = scope.resolve(x["address"])
        if x["name"]:
            scope.prefixes[x["name"][:-1]] = address
        else:
            scope.base = address
    parser = Parser(scope)
    try:
        parser.read(row["text"])
    except ValueError as problem:
        return [{"file": file, "error": f"split {row['block']}, piece {row['n']}: {problem}"}]

    def shown(term: Term) -> str:
        return short(term[1]) if term[0] == "iri" else term[1]

    return [
        {
            "s": shown(s), "p": short(p), "o": shown(o), "kind": o[0],
            "datatype": None if o[2] is None else short(o[2]), "lang": o[3], "graph": graph, "file": file,
        }
        for s, p, o in parser.triples
    ]
