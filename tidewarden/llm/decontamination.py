"""Benchmark decontamination by one Aho-Corasick automaton over normalised items.

Texts are normalised to lower-case ASCII-or-wider words that single spaces part. Every
window of ``WINDOW`` consecutive words of an item (or all its words, if fewer) is a
pattern; the automaton reads each normalised document once and reports where patterns
end. Word numbers map back to character offsets of the original text.

The automaton is a copy on every executor, so its size is bounded. Items beyond
``AUTOMATON_BYTES`` of text, a long item cut into overlapping pieces, are dealt to several
automata of that size. Each is broadcast for one pass over the documents and dropped before
the next is, so an executor holds one and the driver the patterns of two. A pass keeps the
hits of hit texts alone, by the text's SHA-256; they are united at the end. Nothing is
left out at any size.

Defined cases: null or empty text has no words and no hits; an item without words has no
window; items without an id are one item that counts but has no place in lists of ids;
items with the same window are all reported;
repeated documents are repeated in the result; an empty benchmark hits nothing; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.shared import map_arrow, scratch_path, sized, written

WINDOW = 10
#: Characters of items that one automaton takes, but for one piece more.
AUTOMATON_BYTES = 1 << 19
#: Windows that one piece of a long item has at most.
PIECE_WINDOWS = 1 << 12

#: Every ASCII byte to its normal form: letters to lower case, the rest but digits to a space.
NORMAL = bytes(
    b
    if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else b + 32
    if 0x41 <= b <= 0x5A
    else 0x20
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HIT_SCHEMA = (
    "n_words bigint, n_hit bigint, item_ids array<string>,"
    " words array<struct<first: bigint, last: bigint>>,"
    " spans array<struct<start: bigint, end: bigint>>"
)
HIT_ARROW = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("item_ids", pa.list_(pa.string())),
    ("words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]


def normal_words(text: str | None) -> list[str]:
    """Words of a text in normal form."""
    return [w for w in (text or "").encode().translate(NORMAL).decode().split(" ") if w]


def normal_text(text: str | None) -> tuple[str, int]:
    """All words of a text in normal form, a space on either side, and their number."""
    words = (text or "").encode().translate(NORMAL).split(b" ")
    words = list(filter(None, words))
    return f" {b' '.join(words).decode()} ", len(words)


@dataclass
class Matcher:
    """Patterns ``" w1 ... wn "`` with their number of words and the items that have them."""

    patterns: list[tuple[str, int, tuple[str | None, ...]]]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int) -> Matcher:
        found: dict[tuple[str, ...], set[str | None]] = {}
        for item_id, text in items:
            words = normal_words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(item_id)
        return cls([(f" {' '.join(w)} ", len(w), tuple(in_order(x))) for w, x in found.items()])

    def __getstate__(self) -> list:
        return self.patterns

    def __setstate__(self, patterns: list) -> None:
        self.patterns = patterns

    @property
    def automaton(self) -> ahocorasick.Automaton:
        if "_automaton" not in self.__dict__:
            self._automaton = ahocorasick.Automaton()
            for text, n, items in self.patterns:
                self._automaton.add_word(text, (n, items))
            if self.patterns:
                self._automaton.make_automaton()
        return self._automaton

    def scan(self, joined: str) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Ranges of hit words of a normal text, and the ids of items with a window there."""
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        at = seen = 0
        for end, (n, ids) in self.automaton.iter(joined) if self.patterns else ():
            at += joined.count(" ", seen, end)  # words that end before this place
            seen = end
            items.update(ids)
            ranges.append((at - n, at - 1))
        return ranges, items


def in_order(ids: set[str | None]) -> list[str | None]:
    """Ids sorted as strings; the item without one, if any, comes last."""
    return sorted(ids - {None}) + [None] * (None in ids)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def char_spans(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in the original text of ranges of words."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b][1]) for a, b in ranges]


def pieces(text: str | None, window: int) -> Iterator[str]:
    """A short text as it is; a long one in pieces that have each of its windows once."""
    words = normal_words(text)
    if len(words) < PIECE_WINDOWS + window:
        yield text or ""
        return
    for i in range(0, len(words) - window + 1, PIECE_WINDOWS):
        yield " ".join(words[i : i + PIECE_WINDOWS + window - 1])


def matchers(benchmark: DataFrame, window: int) -> Iterator[Matcher]:
    """One automaton, or as many of bounded size as the benchmark takes, one at a time.

    Only item ids and texts are read to the driver, a partition at a time.
    """
    part: list[tuple[str | None, str | None]] = []
    size = made = 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text")
    for item_id, text in rows.distinct().toLocalIterator():
        for piece in pieces(text, window):
            part.append((item_id, piece))
            size += len(piece)
            if size >= AUTOMATON_BYTES:
                yield Matcher.of(part, window)
                made += 1
                part, size = [], 0
    if part or not made:
        yield Matcher.of(part, window)


def scanned(docs: DataFrame, matcher: Broadcast, key: str) -> DataFrame:
    """``docs`` (key, text) as (key, n_words, n_hit, item_ids, words, spans)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for text in batch.column("text").to_pylist():
            joined, n = normal_text(text)
            ranges, items = matcher.value.scan(joined)
            ranges = merged(ranges)
            values = (
                n,
                sum(b - a + 1 for a, b in ranges),
                in_order(items),
                [{"first": a, "last": b} for a, b in ranges],
                [{"start": a, "end": b} for a, b in char_spans(text, ranges)],
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return with_hits(batch.column(key), columns, key)

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, "text"), each, f"{key} {kind}, {HIT_SCHEMA}")


def with_hits(ids: pa.Array, columns: list[list], key: str) -> pa.RecordBatch:
    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, HIT_ARROW, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *arrays], [key, *(n for n, _ in HIT_ARROW)])


def united(parts: list[dict] | None) -> tuple[int, list, list, list]:
    """(n_hit, item_ids, words, spans) of what automata found in one text."""
    items: set[str | None] = set()
    places: list[list[int]] = []
    for part in parts or ():
        items.update(part["item_ids"])
        for w, s in zip(part["words"], part["spans"], strict=True):
            places.append([w["first"], w["last"], s["start"], s["end"]])
    whole: list[list[int]] = []
    for place in sorted(places):
        if whole and place[0] <= whole[-1][1] + 1:
            if place[1] > whole[-1][1]:
                whole[-1][1::2] = place[1::2]
        else:
            whole.append(place)
    return (
        sum(last - first + 1 for first, last, _, _ in whole),
        in_order(items),
        [{"first": p[0], "last": p[1]} for p in whole],
        [{"start": p[2], "end": p[3]} for p in whole],
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_words, n_hit, item_ids, words, spans)."""
    docs = docs.select("doc_id", "text")
    context = docs.sparkSession.sparkContext
    each = matchers(benchmark, window)
    matcher, more = next(each), next(each, None)
    if more is None:
        return scanned(docs, context.broadcast(matcher), "doc_id")

    texts = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    path = scratch_path(docs.sparkSession, "decontamination-hits")
    while matcher is not None:
        shared = context.broadcast(matcher)
        # Rows of one text find the same, so one of them stands for all.
        found = scanned(texts, shared, "digest").where(contaminated())
        found = found.groupBy("digest").agg(F.first(F.struct("item_ids", "words", "spans")).alias("part"))
        found.write.mode("append").parquet(path)
        shared.destroy()
        matcher, more = more, next(each, None)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    # A text has one part for each automaton at most.
    parts = written(found.groupBy("digest").agg(F.collect_list("part").alias("parts")), "decontamination-parts")
    n, size = parts.agg(F.count("*"), F.sum(F.length(F.to_json("parts")) + 64)).first()
    parts = sized(parts, n, (size or 0) // max(1, n) + 1)
    # Whole texts are not shuffled: rows meet their hits by digest, their words counted before.
    counted = word_counts(docs).join(parts, "digest", "left")

    def unite(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [united(p) for p in batch.column("parts").to_pylist()]
        columns = [batch.column("n_words").to_pylist(), *([f[i] for f in found] for i in range(4))]
        return with_hits(batch.column("doc_id"), columns, "doc_id")

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(counted.select("doc_id", "n_words", "parts"), unite, f"doc_id {kind}, {HIT_SCHEMA}")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words) of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD.pattern), F.lit(0))).cast("bigint")
    return docs.select("doc_id", F.sha2(text, 256).alias("digest"), words.alias("n_words"))


def contaminated() -> Column:
    return F.col("n_hit") > 0


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def brute_force(text: str | None, items: dict[str | None, str | None], window: int = WINDOW) -> tuple:
    """(n_words, n_hit, sorted item ids) of one text, each window tried at each place."""
    words = normal_words(text)
    hit: set[int] = set()
    ids: set[str | None] = set()
    for item_id, item in items.items():
        own = normal_words(item)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            want = own[i : i + window]
            for j in range(len(words) - len(want) + 1):
                if words[j : j + len(want)] == want:
                    hit.update(range(j, j + len(want)))
                    ids.add(item_id)
    return len(words), len(hit), in_order(ids)


def item_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM p),
s AS (SELECT doc_id, n.n, i, array_to_string(list_slice(w, i, i + n.n - 1), ' ') AS t
  FROM d JOIN n ON len(d.w) >= n.n,
    unnest(generate_series(1, len(w) - n.n + 1)) AS g(i)),
m AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.t = p.t AND s.n = p.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM m, unnest(generate_series(m.i, m.i + m.n - 1)) AS g(k) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
