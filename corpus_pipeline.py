"""The corpus pipeline: documents to token shards, each stage an operator of tidewarden.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and reads it back as the next stage's documents. All but the last
return the columns of documents.

1. quality rules       documents that the rules reject go
2. near duplicates     the least doc_id of each SimHash component stays
3. decontamination     documents with a window of a benchmark item go
4. mixing              documents come as often as the mix takes them, in its shards' order
5. token output        token shards in the order of the mix, read back: a row for each document

Stages decide row by row: operators get the key of a row (doc_id and a 64-bit hash of the
whole row) as its doc_id, so rows that share a doc_id, null included, each have a fate of
their own. Only rows alike in every column share a key, and any of them can stand for the
others. The keys that go are counted; while they are few they are broadcast and texts are
filtered where they lie, and beyond that they are joined by shuffles.

Defined cases: null and empty texts fail the rules; an empty table gives an empty result of
every stage; extra columns are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import decontamination, mixing, quality_rules, simhash, token_output
from tidewarden.llm.shared import remove, scratch_path, sized, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS of ``docs`` and a hash of the whole row, which tells nulls from values."""
    parts = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    return docs.select(*COLUMNS, F.xxhash64(*parts).alias("row_hash"))


def by_key(rows: DataFrame) -> DataFrame:
    """``rows`` with their keys as doc_id, for an operator; null ids come last."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "row_hash")
    return rows.withColumn("doc_id", key)


def own_key(found: DataFrame, *more: Column | str) -> DataFrame:
    """(own_id, own_hash, more) of an operator's rows."""
    return found.select(
        F.col("doc_id.id").alias("own_id"), F.col("doc_id.row_hash").alias("own_hash"), *more
    )


def same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row_hash") == F.col("own_hash"))


def without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``rows`` whose keys are not among those ``gone`` (own_id, own_hash)."""
    gone = written(gone.distinct(), name)
    gone = sized(gone, gone.count(), 32)
    return rows.join(gone, same_row(), "left_anti")


def one_of_each(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with one of those alike; ``keys`` has the key of every row of them or more."""
    repeated = keys.groupBy("own_id", "own_hash").count().where("count > 1")
    repeated = written(repeated.drop("count"), name)
    n = repeated.count()
    if not n:
        return rows
    alike = rows.join(sized(repeated, n, 32), same_row(), "left_semi")
    once = alike.dropDuplicates(["doc_id", "row_hash"])
    return without(rows, repeated, f"{name}-all").unionByName(once)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    judged = own_key(quality_rules.verdicts(by_key(rows)).where("not kept"))
    return without(rows, judged, "pipeline-rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = written(simhash.near_duplicates(by_key(rows)), "pipeline-components")
    copies = own_key(found.where("doc_id <> component_id"))
    kept = without(rows, copies, "pipeline-copies")
    return one_of_each(kept, own_key(found), "pipeline-repeated").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    hits = decontamination.hits(by_key(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = own_key(hits.where(decontamination.contaminated()))
    return without(rows, leaks, "pipeline-leaks").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    mixed = written(
        own_key(mixing.mix(by_key(rows), whole_documents=True), "copies"), "pipeline-mix"
    )
    # Rows alike: one of them meets the copies of all.
    rows = one_of_each(rows, mixed.select("own_id", "own_hash"), "pipeline-alike")
    copies = mixed.select("own_id", "own_hash", F.explode("copies").alias("c")).select(
        "own_id", "own_hash", "c.shard", "c.order_key"
    )
    copies = sized(copies, copies.count(), 48)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(copies, same_row())
        .repartitionByRange(parts, "shard", "order_key")
        .sortWithinPartitions("shard", "order_key")
        .select(*COLUMNS)
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "pipeline-shards")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_output.write_shards(docs, tokenizer, path, keep_order=True)
    return token_output.read_shards(manifest)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_by_rules),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token output", tokens),
]

#: Fingerprints, hashed permutations and token ids have no SQL; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
