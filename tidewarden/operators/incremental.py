"""Incremental processing: manifests, keyed state, reuse, overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What fetching adds to a manifest row.
FETCH_COLUMNS = ("fetched_at", "status_code", "raw_html_path", "content_hash", "canonical_url")
STATE_KEY = ("source", "stage", "record_key")


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def duplicated(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with ``is_duplicate``: an equal one stands before it."""
    rank = F.row_number().over(W.partitionBy(*columns).orderBy(*order))
    return df.withColumn("is_duplicate", rank > 1)


def merge_manifest(found: DataFrame, existing: DataFrame, fetched: Sequence[str] = FETCH_COLUMNS) -> DataFrame:
    """Discovered rows, with what was fetched for an unchanged ``last_modified``, and the
    existing rows that were not discovered again; of existing rows of one link the latest."""
    latest = [F.col("last_modified").desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in fetched)]
    existing = first_of(existing, ["source_link"], latest)
    old = existing.select(
        F.col("source_link").alias("__link"),
        F.col("last_modified").alias("__modified"),
        *(F.col(c).alias(f"__{c}") for c in fetched),
    )
    same = F.col("last_modified").eqNullSafe(F.col("__modified")) & F.col("__link").isNotNull()
    merged = found.join(old, F.col("source_link") == F.col("__link"), "left").select(
        *(c for c in found.columns if c not in fetched),
        *(F.when(same, F.col(f"__{c}")).alias(c) for c in fetched),
    )
    rest = existing.join(found.select("source_link"), "source_link", "left_anti")
    return merged.unionByName(rest, allowMissingColumns=True)


def fill_known(rows: DataFrame, *others: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose blank columns take the first known value of the other tables; of values that
    one of them has for a key the last in order."""
    out = rows
    for i, other in enumerate(others):
        known = [F.max(F.nullif(F.trim(F.col(c)), F.lit(""))).alias(f"__{c}{i}") for c in columns]
        named = other.groupBy(F.col(key).alias(f"__key{i}")).agg(*known)
        out = out.join(named, F.col(key) == F.col(f"__key{i}"), "left").drop(f"__key{i}")
    known = [
        F.coalesce(
            F.nullif(F.trim(F.col(c)), F.lit("")),
            *(F.nullif(F.trim(F.col(f"__{c}{i}")), F.lit("")) for i in range(len(others))),
        ).alias(c)
        for c in columns
    ]
    return out.select(*(c for c in rows.columns if c not in columns), *known)


def upsert_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """State with the latest row of each key; at equal times a new row wins."""
    both = state.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = [F.col("processed_at").desc(), F.col("__new").desc(), F.col("fingerprint").desc()]
    return first_of(both, STATE_KEY, order).drop("__new")


def split_current(
    records: DataFrame, state: DataFrame, outputs: DataFrame, stage: str, key: str = "record_key"
) -> tuple[DataFrame, DataFrame]:
    """(reused, pending) of records (source, key, fingerprint).

    A record is reused if its state has the same fingerprint and its output is there, or
    its state says that there is none to expect (``skipped``).
    """
    mine = state.where(F.col("stage") == stage).select(
        F.col("source").alias("__source"),
        F.col("record_key").alias("__key"),
        F.col("fingerprint").alias("__fingerprint"),
        *((F.col("skipped").alias("__skipped"),) if "skipped" in state.columns else (F.lit(False).alias("__skipped"),)),
    )
    there = outputs.select(F.col(key).alias("__out")).distinct()
    joined = records.join(
        mine, (F.col("source") == F.col("__source")) & (F.col(key) == F.col("__key")), "left"
    ).join(there, F.col(key) == F.col("__out"), "left")
    current = F.coalesce(
        (F.col("fingerprint") == F.col("__fingerprint"))
        & (F.col("__out").isNotNull() | F.coalesce("__skipped", F.lit(False))),
        F.lit(False),
    )
    marked = joined.withColumn("__current", current)
    keep = records.columns
    return marked.where("__current").select(*keep), marked.where("not __current").select(*keep)


def recombine(reused: DataFrame, fresh: DataFrame, position: str = "pos") -> DataFrame:
    return reused.unionByName(fresh, allowMissingColumns=True).orderBy(position)


def head_split(manifest: DataFrame, n: int, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(the first n rows by position, the rest)."""
    if n <= 0:
        return manifest, manifest.limit(0)
    edge = manifest.select(position).orderBy(position).limit(n).agg(F.max(position)).first()[0]
    if edge is None:
        return manifest, manifest.limit(0)
    return manifest.where(F.col(position) <= edge), manifest.where(F.col(position) > edge)


def overlay(records: DataFrame, json_column: str, fields: Sequence[T.StructField]) -> DataFrame:
    """Records whose whitelisted fields take the values of a JSON object that has their key.

    A key with null overwrites with null; a missing key leaves the value; others are dropped.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    parsed = F.from_json(json_column, schema)
    present = F.coalesce(F.json_object_keys(json_column), F.array().cast("array<string>"))
    names = {f.name: f for f in fields}
    return records.select(
        *(
            F.when(F.array_contains(present, c), parsed[c]).otherwise(F.col(c)).alias(c)
            if c in names
            else F.col(c)
            for c in records.columns
            if c != json_column
        )
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")
