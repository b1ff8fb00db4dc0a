"""Text functions: trimming, slugs, term patterns, snippets, labels and formats."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Case-insensitive for all scripts, and \w \s \b for all scripts: Java needs both flags.
FLAGS = "(?iuU)"


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def na_to_null(c: Column | str, markers: Sequence[str] = ("", "NaN", "nan", "N/A")) -> Column:
    """Trimmed text; blank and the markers of missing values are null."""
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(*markers), trimmed)


def dash_slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at either end."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    folded = values.str.normalize("NFKD")
    return folded.str.encode("ascii", "ignore").str.decode("ascii").where(values.notna(), None)


def underscore_slug(c: Column) -> Column:
    """As ``dash_slug`` but accents fold to their letter and the joint is an underscore.

    Text that is ASCII already, as most is, stays in the JVM; only the rest goes through
    an Arrow batch, as decomposition of Unicode has no built-in function.
    """
    plain = F.length(c) == F.octet_length(c)
    folded = F.when(plain, c).otherwise(_ascii_fold(c))
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(folded)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def collapse_space(c: Column) -> Column:
    """Runs of white space of any script as one space, none at either end."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


@cache
def _cases() -> dict[str, str]:
    """Each letter of the basic plane with all that differ from it in case only."""
    groups: dict[str, set[str]] = {}
    for code in range(0x10000):
        c = chr(code)
        if len(c.lower()) == 1 and len(c.upper()) == 1 and (c.lower() != c or c.upper() != c):
            groups.setdefault(c.upper().lower(), set()).update((c, c.lower(), c.upper()))
    return {c: "".join(sorted(group)) for group in groups.values() for c in group}


def any_case(word: str) -> str:
    """Pattern of a word in any case: a class for each letter, which Java matches faster than
    its flag for all scripts."""
    return "".join(f"[{_cases()[c]}]" if c in _cases() else re.escape(c) for c in word)


def term_pattern(term: str, acronyms: Sequence[str] = ()) -> str:
    """Pattern of a term in any case; an acronym must not touch word characters."""
    body = any_case(term)
    return rf"(?U)(?<!\w){body}(?!\w)" if term in acronyms else body


def first_match(text: Column, pattern: str) -> Column:
    """Struct (start, end) of the first match in code points, null without one.

    One split in two finds the match: what stands before and after it gives its place.
    """

    def place(parts: Column) -> Column:
        return F.when(
            F.size(parts) == 2,
            F.struct(
                F.length(F.get(parts, F.lit(0))).alias("start"),
                (F.length(text) - F.length(F.get(parts, F.lit(1)))).alias("end"),
            ),
        )

    return F.get(F.transform(F.array(F.split(text, pattern, 2)), place), F.lit(0))


@cache
def _folding() -> dict[int, str]:
    """Each letter that differs from others in case only, to the least of these."""
    return {ord(c): group[0] for c, group in _cases().items()}


def is_word(c: str) -> bool:
    """Whether ``\\w`` takes a character, of any script."""
    return c.isalnum() or c == "_"


class Terms:
    """An automaton of all terms, letters folded to one case."""

    def __init__(self, terms: Sequence[str], acronyms: Sequence[str]):
        self.sizes = [len(t) for t in terms]
        self.guarded = [t in set(acronyms) for t in terms]
        self.automaton = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            same.setdefault(term.translate(_folding()), []).append(i)
        self.blank = same.pop("", [])
        for term, own in same.items():
            self.automaton.add_word(term, own)
        if same:
            self.automaton.make_automaton()

    def first_places(self, text: str) -> list[dict]:
        """(at, start, end) of the first place of each term that occurs, in the order of terms."""
        found = {i: 0 for i in self.blank}
        for last, own in self.automaton.iter(text.translate(_folding())) if len(self.automaton) else ():
            for i in own:
                if i not in found:
                    start = last + 1 - self.sizes[i]
                    touched = self.guarded[i] and (
                        start > 0 and is_word(text[start - 1]) or last + 1 < len(text) and is_word(text[last + 1])
                    )
                    if not touched:
                        found[i] = start
        return [{"at": i, "start": found[i], "end": found[i] + self.sizes[i]} for i in sorted(found)]


PLACES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("at", "start", "end")]))


def first_places(body: Column, terms: Sequence[str], acronyms: Sequence[str] = ()) -> Column:
    """Array of (at, start, end): the first place of each term that occurs, in any case and in
    code points; an acronym must not touch word characters. One pass for all terms, in Arrow
    batches, however many there are."""
    terms, acronyms = list(terms), list(acronyms)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(PLACES)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Terms(terms, acronyms)
        for some in texts:
            yield pa.array([automaton.first_places(t or "") for t in some.to_pylist()], kind)

    return find(body)


def window_text(text: Column, start: Column, end: Column) -> Column:
    """Characters start up to end, white space collapsed."""
    return collapse_space(F.substring(text, start + 1, end - start))


def locator(start: Column, end: Column) -> Column:
    return F.format_string("char[%d:%d]", start, end)


def first_upper(text: Column, pattern: str) -> Column:
    """First match in upper case, null without one."""
    return F.upper(F.regexp_substr(text, F.lit(FLAGS + pattern)))


def subtype(text: Column) -> Column:
    """First influenza subtype, such as H5N1."""
    return first_upper(text, r"\bH[0-9]N[0-9]\b")


def labels_of_terms(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Labels of the terms that occur, in the order of the terms, each once."""
    found = F.filter(
        F.array(
            *(
                F.when(text.rlike(any_case(term)), F.lit(label))
                for term, label in terms
            )
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_distinct(found)


def split_list(c: Column, sep: str = ",") -> Column:
    """Trimmed parts of a separated list without blank ones; null is an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def word_count(c: Column) -> Column:
    """White-space words; blank and null have none."""
    trimmed = collapse_space(F.coalesce(c, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def first_sentence_with(text: Column, terms: Sequence[str]) -> Column:
    """First sentence that has any of the terms."""
    pattern = "|".join(any_case(t) for t in terms)
    sentences = F.split(F.trim(text), r"(?<=[.!?])\s+")
    return F.get(F.filter(sentences, lambda s: s.rlike(pattern)), F.lit(0))


def measures_with_sentences(text: Column, terms: Sequence[tuple[str, str]]) -> Column:
    """Array of (measure, sentence): each label that occurs, with its term's first sentence."""
    found = F.filter(
        F.array(
            *(
                F.struct(
                    F.lit(label).alias("measure"),
                    first_sentence_with(text, [term]).alias("sentence"),
                )
                for term, label in terms
            )
        ),
        lambda x: x["sentence"].isNotNull(),
    )
    return found


def first_of(text: Column, names: Sequence[str]) -> Column:
    """The first of the names, in their order, that occurs as a word."""
    return F.coalesce(
        *(F.when(text.rlike(FLAGS + rf"\b\Q{n}\E\b"), F.lit(n)) for n in names), F.lit(None)
    )


def cascade(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule (pattern, label) that matches."""
    return F.coalesce(
        *(F.when(text.rlike(FLAGS + p), F.lit(label)) for p, label in rules), F.lit(None)
    )


def cell(c: Column, kind: T.DataType) -> Column:
    """CSV cell: null is blank, booleans in lower case, nested values as JSON."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "true").when(~c, "false")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = json_text(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def json_text(c: Column) -> Column:
    """JSON with nulls kept; a struct's fields come in the order that it has them."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def markdown(blocks: Sequence[Column]) -> Column:
    """Non-blank blocks parted by blank lines."""
    kept = F.filter(F.array(*blocks), lambda b: b.isNotNull() & (F.trim(b) != ""))
    return F.array_join(kept, "\n\n")


def strip_label(c: Column, *labels: str) -> Column:
    """Trimmed text without leading labels such as ``Bild:``."""
    for label in labels:
        c = F.replace(c, F.lit(label), F.lit(""))
    return F.trim(c)


def unfence(c: Column) -> Column:
    """Text inside a fenced code block, or the text itself."""
    ends = r"^\s+|\s+\z"
    inner = F.regexp_replace(F.regexp_replace(c, ends, ""), r"(?s)^```[a-zA-Z]*\s*|\s*```\z", "")
    return F.regexp_replace(inner, ends, "")


def display_time(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yy · HH:mm")


def padded_id(prefix: str, c: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), width, "0"))


def image_url(html: Column, base: str) -> Column:
    """Absolute address of the first image."""
    src = F.nullif(F.regexp_extract(html, r"(?i)<img[^>]*\ssrc=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return F.when(src.rlike("^https?://"), src).when(
        src.isNotNull(), F.concat(F.lit(base.rstrip("/")), F.lit("/"), F.ltrim(src, F.lit("/")))
    )


def evidence_text(snippets: Column) -> Column:
    """Texts of snippets joined by semicolons."""
    return F.array_join(F.transform(snippets, lambda s: s["text"]), "; ")
