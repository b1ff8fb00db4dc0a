"""Log-structured keyed state: a batch writes its own rows, readers merge.

A state is a list of runs, each the rows of a batch or of several that were compacted, the
latest of each key, dealt to buckets by a hash of the key (``bucket=`` folders). A manifest
names the runs in order; manifests are numbered, and the last whole one is the state, so a
reader keeps what it opened and a writer that is lost leaves files that nobody names.

    upsert    writes the batch as one run: its size follows the batch, not the state
    read      the latest row of each key over all runs: one aggregate with partial results
    lookup    the rows of some keys: a Bloom filter for each run and bucket names the files
              that may have them, and only those are read
    compact   newer runs become one; all do where they are more than half of the oldest

Compaction runs by itself beyond MAX_RUNS runs. A batch that comes again adds a run that says
the same. The latest of a key is the one with the greatest order columns, and of equals that
of the newest run.

Defined cases: null keys are keys like others; a batch without rows writes nothing; rows of one
key and order within a batch count as the greatest in all their columns; two writers at once
clash at the manifest, and the later one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators.incremental import STATE_KEY

BUCKETS = 16
#: Runs that are kept beside each other.
MAX_RUNS = 8
#: Bits of a Bloom filter for each key of its bucket, and places that a key sets.
BLOOM_BITS = 10
BLOOM_PLACES = 7
FILTER_SCHEMA = "run string, bucket int, size bigint, bits binary"


class KeyedState:
    """A keyed table in a folder that batches upsert."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType | str,
        key: Sequence[str] = STATE_KEY,
        order: Sequence[str] = ("processed_at",),
        buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), list(key), list(order)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.names
        known = self.manifest()
        self.buckets = known["buckets"] if known else buckets  # fixed with the first run

    # Manifests.

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _number(self) -> int | None:
        """Number of the last manifest."""
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[0] != "."), default=None)

    def manifest(self) -> dict | None:
        """{buckets, runs: [{name, rows}]}, the oldest run first."""
        number = self._number()
        if number is None:
            return None
        text = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).first()[0]
        return json.loads(text) | {"number": number}

    def _commit(self, before: dict | None, runs: list[dict]) -> None:
        """Write the next manifest beside its place and move it there, unless one is there."""
        number = before["number"] + 1 if before else 0
        here, there = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{number:012d}.json")
        out = self._files.create(here)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": runs}).encode()))
        out.close()
        if self._files.exists(there) or not self._files.rename(here, there):
            self._files.delete(here, False)
            raise RuntimeError(f"another writer made version {number} of {self.path}")

    # Rows.

    def _bucket(self) -> Column:
        nulls = [x for c in self.key for x in (F.col(c).isNull(), F.col(c))]
        return F.pmod(F.xxhash64(*nulls), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame, *newest: str) -> DataFrame:
        """The greatest row of each key by order columns, then ``newest``, then all columns."""
        rest = [c for c in self.columns if c not in self.key and c not in self.order]
        by = [*self.order, *newest, *rest]
        found = rows.groupBy(*self.key).agg(F.max(F.struct(*by)).alias("__row"))
        own = [F.col(c) if c in self.key else F.col(f"__row.{c}").alias(c) for c in self.columns]
        return found.select(*own)

    def _runs(self, runs: Sequence[dict], files: dict[str, list[int]] | None = None) -> DataFrame:
        """Rows of runs with the run's place; of given buckets alone if ``files`` names them."""
        frames = []
        for place, run in enumerate(runs):
            folder = f"{self.path}/runs/{run['name']}"
            own = files.get(run["name"], []) if files is not None else None
            if own == []:
                continue
            paths = [folder] if own is None else [f"{folder}/bucket={b}" for b in own]
            frames.append(self.spark.read.schema(self.schema).parquet(*paths).select(*self.columns, F.lit(place).alias("__run")))
        if not frames:
            return self.spark.createDataFrame([], self.schema).withColumn("__run", F.lit(0))
        return reduce(DataFrame.unionByName, frames)

    def read(self) -> DataFrame:
        """The latest row of each key."""
        known = self.manifest()
        runs = known["runs"] if known else []
        rows = self._runs(runs)
        return rows.drop("__run") if len(runs) == 1 else self._latest(rows, "__run")

    def _write(self, rows: DataFrame) -> dict | None:
        """A run of rows that have each key once; None without rows."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/runs/{name}"
        dealt = rows.select(*self.columns, self._bucket().alias("bucket")).repartition(self.buckets, "bucket")
        dealt.write.partitionBy("bucket").parquet(folder)
        schema = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])
        filters = self._filters(self.spark.read.schema(schema).parquet(folder), name)
        filters.write.parquet(f"{self.path}/filters/{name}")
        n = self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.path}/filters/{name}").agg(F.sum("size")).first()[0]
        return {"name": name, "rows": n} if n else None

    def upsert(self, batch: DataFrame, _: int = 0) -> None:
        """Add a batch; of a key's rows the latest."""
        known = self.manifest()
        run = self._write(self._latest(batch.select(*self.columns)))
        if run is None:
            return
        self._commit(known, [*(known["runs"] if known else []), run])
        if known and len(known["runs"]) >= MAX_RUNS:
            self.compact()

    def compact(self) -> None:
        """Make newer runs one; the oldest too, once they are more than half of it."""
        known = self.manifest()
        if not known or len(known["runs"]) < 2:
            return
        oldest, *newer = known["runs"]
        if sum(r["rows"] for r in newer) * 2 > oldest["rows"]:
            kept, merged = [], known["runs"]
        else:
            kept, merged = [oldest], newer
        run = self._write(self._latest(self._runs(merged), "__run"))
        self._commit(known, [*kept, run])

    def vacuum(self) -> int:
        """Remove runs that the current manifest doesn't name; how many. Readers of older
        manifests and writers at work lose theirs, so call it when there are none."""
        known = self.manifest()
        own = {r["name"] for r in known["runs"]} if known else set()
        gone = 0
        for kind in ("runs", "filters"):
            folder = self._path(kind)
            for status in self._files.listStatus(folder) if self._files.exists(folder) else ():
                if status.getPath().getName() not in own:
                    gone += self._files.delete(status.getPath(), True)
        return gone

    # Bloom filters.

    def _hashes(self) -> list[Column]:
        """Two hashes of a key, of which all its places are made."""
        nulls = [x for c in self.key for x in (F.col(c).isNull(), F.col(c))]
        return [F.xxhash64(*nulls, F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)]

    def _filters(self, rows: DataFrame, run: str) -> DataFrame:
        """A filter for each bucket of a run, from hashes of its keys alone."""

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                bucket = batch.column("bucket").to_numpy()
                pair = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")])
                for b in np.unique(bucket):
                    by_bucket.setdefault(int(b), []).append(pair[:, bucket == b])
            for b, pairs in by_bucket.items():
                pair = np.concatenate(pairs, axis=1)
                size = pair.shape[1]
                bits = np.zeros(max(8, size * BLOOM_BITS + 7 & ~7), np.uint8)
                for at in places(pair, len(bits)):
                    bits[at] = 1
                row = [[run], [b], [size], [np.packbits(bits, bitorder="little").tobytes()]]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["run", "bucket", "size", "bits"]
                )

        own = rows.select("bucket", *self._hashes()).repartition(self.buckets, "bucket")
        return own.mapInArrow(build, FILTER_SCHEMA)

    def files_for(self, keys: DataFrame) -> dict[str, list[int]]:
        """Buckets of each run that may have one of some keys: at most runs times buckets."""
        known = self.manifest()
        names = [r["name"] for r in known["runs"]] if known else []
        if not names:
            return {}
        filters = self.spark.read.schema(FILTER_SCHEMA).parquet(*(f"{self.path}/filters/{n}" for n in names))
        asked = keys.select(*self.key).distinct().select(self._bucket().alias("bucket"), *self._hashes())

        def match(left: pa.Table, right: pa.Table) -> pa.Table:
            hit: list[dict] = []
            if left.num_rows:
                pair = np.stack([left.column(c).to_numpy() for c in ("h1", "h2")])
                for r in right.to_pylist():
                    bits = np.frombuffer(r["bits"], np.uint8)
                    found = np.ones(pair.shape[1], bool)
                    for at in places(pair, len(bits) * 8):
                        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                    if found.any():
                        hit.append({"run": r["run"], "bucket": r["bucket"]})
            return pa.Table.from_pylist(hit, pa.schema([("run", pa.string()), ("bucket", pa.int32())]))

        pairs = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(match, "run string, bucket int")
        out: dict[str, list[int]] = {}
        for run, bucket in pairs.collect():
            out.setdefault(run, []).append(bucket)
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The state of some keys, from the files that may have them."""
        known = self.manifest()
        rows = self._runs(known["runs"] if known else [], self.files_for(keys))
        asked = keys.select(*(F.col(c).alias(f"__{c}") for c in self.key)).distinct()
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in self.key))
        return self._latest(rows.join(asked, same, "left_semi"), "__run")

    def changed(self, batch: DataFrame, by: str = "fingerprint") -> DataFrame:
        """Rows of a batch whose key is new or has another ``by`` than the state."""
        old = self.lookup(batch).select(*(F.col(c).alias(f"__{c}") for c in (*self.key, by)))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*self.key, by)))
        return batch.join(old, same, "left_anti")


def places(pair: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of keys in a filter of ``size`` bits, from two hashes."""
    first, second = pair.astype(np.int64).view(np.uint64)
    for i in range(BLOOM_PLACES):
        yield ((first + np.uint64(i) * (second | np.uint64(1))) % np.uint64(size)).astype(np.int64)
