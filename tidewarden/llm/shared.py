"""What the corpus operators share: scratch tables, size-checked joins, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that an Arrow batch for Python holds: some hundred long texts fit a worker.
BATCH_ROWS = 512
#: Bytes that an Arrow batch holds, but for a longer text.
BATCH_BYTES = 32 << 20
#: A side of fewer estimated bytes is broadcast; a larger one is joined by shuffles.
BROADCAST_BYTES = 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder is made and set if Spark runs on this machine alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewarden-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; ``remove`` it when the work is done."""
    return f"{checkpoint_dir(spark)}/tidewarden/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that no other call gets."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, outlives any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table or folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts takes in a Python worker, in rows and bytes,
    for the session: plans take these settings when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the counted rows take less than BROADCAST_BYTES, else none."""
    return F.broadcast(df) if rows * row_bytes < BROADCAST_BYTES else df


def join_on_hubs(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``side``, a table with one row for each key; its ``n`` is
    how many rows a key meets at most, and ``total`` the sum of these.

    Keys with more than a part of 1 in 4 partitions are fewer than that many, so they are
    broadcast; what is left is spread evenly by a shuffle.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hub = F.col("n") > max(1000, total // (4 * parts))
    hubs = side.where(hub).drop("n")
    if not hubs.take(1):
        return rows.join(side.drop("n"), key)
    hubs = F.broadcast(hubs)
    rest = rows.join(hubs.select(key), key, "left_anti").join(side.where(~hub).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def ascii_lower(text: Column | str) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def map_arrow(
    df: DataFrame,
    each: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: T.StructType | str,
) -> DataFrame:
    """``each`` over the Arrow batches of ``df``, partition by partition."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(each, batches)

    return df.mapInArrow(run, schema)
