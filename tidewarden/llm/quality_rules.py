"""Quality rules with host-level verdicts, DataFrame functions only.

Each document gets word, symbol, line and repetition counts in one pass over its text,
inside its row: no word or window ever becomes a row of its own. Documents are then
aggregated by host (the ``source`` of documents); per rule, the host's failure rate is
shrunk towards the corpus by a beta prior whose two parameters are fitted to the rates of
all hosts. A host with a shrunk rate of ``HOST_LIMIT`` or more in any rule is rejected,
and its verdict is joined back to its documents.

The counts are written to the shared folder once and read twice, so texts are read once.
Host aggregation has a partial step, so a host with a third of all rows sends a row a task.

Defined cases: null text has no words (``base_failed``, as fewer than ``MIN_WORDS``); null
hosts are one host of their own; repeated rows count each; an empty table gives an empty
result; extra columns are ignored; rates on the limit reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.shared import sized, written

MIN_WORDS = 10
#: Windows of so many words that occur twice or more are repeats.
REPEAT_WINDOW = 5
#: Percent of words in repeats, of symbols to words, of lines seen before.
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 50
MAX_DUP_LINE_PERCENT = 50
#: A host of this shrunk failure rate in any rule is rejected.
HOST_LIMIT = 0.6

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
RULES = ("short", "repeats", "symbols", "dup_lines")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more in the list.

    Windows are compared by 64-bit hashes. Where none repeats, as in most texts, sorting
    stops there; else equal neighbours in (hash, place) order give the places, and each
    place covers its window up to the next one.
    """
    n = REPEAT_WINDOW

    def window(words: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(n)))

    def covered(pairs: Column) -> Column:
        def twin(i: Column) -> Column:
            own = F.get(pairs, i)["h"]
            return F.when(
                (own == F.get(pairs, i - 1)["h"]) | (own == F.get(pairs, i + 1)["h"]),
                F.get(pairs, i)["i"],
            )

        places = F.sort_array(
            F.array_compact(F.transform(F.sequence(F.lit(0), F.size(pairs) - 1), twin))
        )
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-n).alias("last")),
            lambda acc, i: F.struct(
                (acc["total"] + F.least(F.lit(n), i - acc["last"])).alias("total"),
                i.alias("last"),
            ),
            lambda acc: acc["total"],
        )

    def of_hashes(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            let(F.sort_array(pairs), covered),
        ).otherwise(F.lit(0).cast("bigint"))

    return let(
        words,
        lambda w: F.when(
            F.size(w) > n,
            let(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: window(w, i)), of_hashes),
        ).otherwise(F.lit(0).cast("bigint")),
    )


def counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        word_list(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(
                lines,
                lambda x: F.struct(
                    F.size(x).cast("bigint").alias("n"),
                    (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
                ),
            ).alias("lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, host, the counts, base_failed, failed: an array over RULES)."""
    c = docs.select("doc_id", F.col("source").alias("host"), counts(F.col("text")).alias("c"))
    c = c.select("doc_id", "host", "c.*")
    short = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")
    dup_lines = 100 * F.col("lines.dup") > MAX_DUP_LINE_PERCENT * F.col("lines.n")
    return c.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        (short | repeats).alias("base_failed"),
        F.array(short, repeats, symbols, dup_lines).alias("failed"),
    )


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n, rate of each rule, shrunk by the rule's beta prior)."""
    fails = [
        F.sum(F.element_at("failed", i + 1).cast("bigint")).alias(f"k_{rule}")
        for i, rule in enumerate(RULES)
    ]
    hosts = counted.groupBy("host").agg(F.count("*").alias("n"), *fails)
    moments = []
    for rule in RULES:
        rate = F.col(f"k_{rule}") / F.col("n")
        moments += [F.avg(rate).alias(f"m_{rule}"), F.var_pop(rate).alias(f"v_{rule}")]
    prior = hosts.agg(*moments).first()  # two numbers a rule
    shrunk = []
    for rule in RULES:
        alpha, beta = beta_prior(prior[f"m_{rule}"], prior[f"v_{rule}"])
        rate = (F.col(f"k_{rule}") + alpha) / (F.col("n") + alpha + beta)
        shrunk.append(rate.alias(f"rate_{rule}"))
    return hosts.select("host", "n", *shrunk)


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters with this mean and variance, worth 2 to 1000 documents."""
    mean = min(max(mean or 0.0, 1e-3), 1 - 1e-3)
    spread = mean * (1 - mean)
    weight = min(max(spread / variance - 1, 2.0), 1000.0) if variance else 1000.0
    return mean * weight, (1 - mean) * weight


def verdicts(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs`` (doc_id, source, text)."""
    counted = written(document_counts(docs), "quality-counts")
    worst = F.greatest(*(f"rate_{rule}" for rule in RULES))
    rejected = written(
        host_rates(counted).where(worst >= HOST_LIMIT).select(F.col("host").alias("bad_host")),
        "quality-hosts",
    ).withColumn("host_rejected", F.lit(True))
    rejected = sized(rejected, rejected.count(), 200)
    return counted.join(rejected, counted["host"].eqNullSafe(rejected["bad_host"]), "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("host_rejected").isNull()).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS x
  FROM d, unnest(generate_series(1, len(w) - 4)) AS g(i) WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n
  FROM r, unnest(generate_series(i, i + 4)) AS g(k) GROUP BY doc_id),
b AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id),
f AS (SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2,
    100 * n_symbols > 50 * n_words AS f3, 100 * n_dup_lines > 50 * n_lines AS f4 FROM b),
h AS (SELECT source, rule, count(*) AS n, sum(CAST(bad AS INT)) AS k
  FROM (UNPIVOT (SELECT source, f1, f2, f3, f4 FROM f) ON f1, f2, f3, f4
    INTO NAME rule VALUE bad) GROUP BY ALL),
p AS (SELECT rule, least(greatest(avg(k / n), 0.001), 0.999) AS m, var_pop(k / n) AS v
  FROM h GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN v = 0 THEN 1000.0
    ELSE least(greatest(m * (1 - m) / v - 1, 2), 1000) END AS z FROM p),
x AS (SELECT source, max((k + m * z) / (n + z)) AS worst
  FROM h JOIN q ON h.rule = q.rule GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  f1 OR f2 AS base_failed, NOT (f1 OR f2) AND worst < 0.6 AS kept
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""
