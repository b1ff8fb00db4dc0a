"""Secret scans with an incremental blob ledger.

A path (a document, or any version of a file) is content-addressed: its blob is named by
the SHA-256 of its text. The ledger is a table in the shared folder with a row for each
blob and rule version that has been scanned, and its spans. A run scans only the pairs of
blob and rule version that the ledger lacks, each once, appends them, and joins findings
back to every path that has the blob.

Which text stands for an unseen blob is settled on (blob, path) alone. Texts are then
filtered in place: paths that need no scan are fewer by far in a first run, and paths that
need one in a later run, so the smaller of the two sets is counted and broadcast while it
takes less than ``BROADCAST_BYTES``; beyond that, paths are joined by shuffles.

Spans are kind:start:end in code points, end exclusive. The base kinds are assign, access
and hex; rule version 1 adds tokens of public services and private key headers.

Defined cases: null text is the empty blob; ledger rows of other rule versions are kept
and ignored; rows that repeat both doc_id and text are scanned once and each get the
findings; rows of one doc_id with other texts are paths of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.shared import BROADCAST_BYTES, map_arrow, scratch_path, sized, written

RULE_VERSION = 1
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINT = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
#: What rule version 1 adds to the base: formats that public services document.
ADDED = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": (("xox",), re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": (("eyJ",), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")),
    "private_key": (("-----BEGIN",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
}
#: A run of a JWT's letters before what must follow; tried once a run, where the pattern above
#: tries each ``eyJ`` in it up to the run's end.
JWT_RUN = re.compile(
    r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{11,}+(?=\.(eyJ[A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]++))"
)
KINDS = (*BASE_KINDS, *ADDED)
SPAN_SCHEMA = "array<struct<kind: string, start: bigint, end: bigint>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

Span = tuple[int, int, str, int]


def base_spans(text: str) -> Iterator[Span]:
    """(start, order of kind, kind, end) of the base kinds."""
    if ASSIGN_HINT.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                yield m.start(), 0, "assign", m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                yield m.start(), 1, "access", m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, "hex", m.end()


def jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of JWTs finds, in time linear in the text."""
    done = 0
    for m in JWT_RUN.finditer(text):
        start = text.find("eyJ", m.start(), m.end() - 8) if m.start() >= done else -1
        if start >= 0:
            done = m.end(2)
            yield start, done


def spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    found = list(base_spans(text))
    for order, (kind, (hints, pattern)) in enumerate(ADDED.items(), len(BASE_KINDS)):
        if any(h in text for h in hints):
            own = jwt_spans(text) if kind == "jwt" else (m.span() for m in pattern.finditer(text))
            found += [(start, order, kind, end) for start, end in own]
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(
    texts: DataFrame, scanner: Callable[[str | None], list[dict]], version: int
) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of ``texts`` (blob, text)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([scanner(t) for t in batch.column("text").to_pylist()], SPAN_ARROW)
        versions = pa.array([version] * len(found), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("blob"), versions, found], ["blob", "rule_version", "spans"]
        )

    return map_arrow(
        texts.select("blob", "text"), each, f"blob string, rule_version int, spans {SPAN_SCHEMA}"
    )


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's table; empty before the first run."""
    schema = f"blob string, rule_version int, spans {SPAN_SCHEMA}"
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(ledger)
    return spark.createDataFrame([], schema)


def scan(
    paths: DataFrame,
    ledger: str,
    scanner: Callable[[str | None], list[dict]] = spans,
    version: int = RULE_VERSION,
) -> DataFrame:
    """(doc_id, blob, spans) of every row of ``paths`` (doc_id, text); extends the ledger."""
    spark = paths.sparkSession
    paths = paths.select("doc_id", "text").withColumn("blob", blob_of(F.col("text")))
    addresses = written(paths.select("doc_id", "blob"), "secret-paths")
    known = ledger_rows(spark, ledger).where(F.col("rule_version") == version).select("blob")
    # One path for each unseen blob; a doc_id may come with several texts, so that is a pair.
    chosen = written(
        addresses.groupBy("blob", "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy("blob")
        .agg(F.min(F.struct("doc_id", "n")).alias("x"))
        .join(known, "blob", "left_anti")
        .select(F.col("x.doc_id").alias("own"), F.col("blob").alias("own_blob"), "x.n"),
        "secret-unseen",
    )
    repeated = chosen.where("n > 1").select("own_blob")
    chosen = chosen.drop("n")
    n_scan = chosen.count()
    row_bytes = 150
    same = (F.col("blob") == F.col("own_blob")) & F.col("doc_id").eqNullSafe(F.col("own"))
    if n_scan * row_bytes < BROADCAST_BYTES:
        texts = paths.join(F.broadcast(chosen), same, "left_semi")
    elif (addresses.count() - n_scan) * row_bytes < BROADCAST_BYTES:
        skipped = addresses.join(chosen, same, "left_anti").distinct()
        skipped = skipped.select(F.col("doc_id").alias("own"), F.col("blob").alias("own_blob"))
        texts = paths.join(F.broadcast(skipped), same, "left_anti")
    else:
        texts = paths.join(chosen, same, "left_semi")
    n_repeated = repeated.count()
    if n_repeated:  # rows of one path and text: one of each blob
        repeated = sized(repeated, n_repeated, 100)
        named = F.col("blob") == F.col("own_blob")
        once = texts.join(repeated, named, "left_semi").dropDuplicates(["blob"])
        texts = texts.join(repeated, named, "left_anti").unionByName(once)
    scan_blobs(texts, scanner, version).write.mode("append").parquet(ledger)
    # Findings of this run's blobs alone: the ledger may hold many more. Written, so that the
    # join below has plain exchanges and a blob with a third of all paths can be split.
    found = ledger_rows(spark, ledger).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    blobs = addresses.select("blob").distinct()
    findings = written(
        found.select("blob", "spans").join(blobs, "blob", "left_semi").dropDuplicates(["blob"]), "secret-findings"
    )
    n_found, n_spans = findings.agg(F.count("*"), F.sum(F.size("spans"))).first()
    findings = sized(findings, n_found + (n_spans or 0), 120)
    empty = F.expr("cast(array() as " + SPAN_SCHEMA.replace(": ", ":") + ")")
    return addresses.join(findings, "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", empty).alias("spans")
    )


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, scratch_path(spark, "secret-ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [number(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds in SQL: pattern, group that a length holds for, least length.
_SQL_KINDS = {
    "assign": (
        "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
    **{kind: (pattern.pattern, 0, 1) for kind, (_, pattern) in ADDED.items()},
}

#: Matches and the gaps between them give places, as sums of lengths.
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nk AS ("
    + "\nUNION ALL ".join(
        f"SELECT doc_id, {order} AS o, '{kind}' AS kind, {group} AS grp, {least} AS least, '{pattern}' AS p,"
        f" regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d"
        for order, (kind, (pattern, group, least)) in enumerate(_SQL_KINDS.items())
    )
    + """),
s AS (SELECT doc_id, o, kind, grp, least, p, m[i] AS x, list_sum(list_transform(g[1:i], lambda v: length(v)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a
  FROM k, unnest(generate_series(1, len(m))) AS q(i)),
f AS (SELECT doc_id, o, kind, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(x) AS BIGINT) AS span FROM s
  WHERE length(CASE WHEN grp = 2 THEN regexp_extract(x, p, 2) ELSE x END) >= least),
r AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
    string_agg(span, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(span, ',' ORDER BY a, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
)
