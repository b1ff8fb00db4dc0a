"""Nearest concept by cosine among a table of concepts: an inverted file with exact bounds.

Concepts are dealt to cells, each around one of a bounded sample of them. On unit vectors the
nearest by cosine is the nearest by distance, for which the triangle bound holds: a cell of
radius r whose centre is d away from a vector has nothing nearer than d - r. Both sides are
packed into blocks of bounded size, a row each, and a task compares a vector with those cells
of a block alone whose bound does not pass the best it has, at first its nearest centre. So the
result is that of comparing with every concept.

Where many numbers make all vectors about as far from each other, the bound leaves most cells
open, and the work is that of all pairs. It is then matrix products alone: pairs of blocks are
a cross join, which reads blocks again instead of keeping copies of vectors for each cell, so
disk grows with the rows. Products are of single precision, and what may be the nearest by
them is compared again in double precision.

Defined cases: of concepts as near, the least in ``name`` is taken; null, empty and zero vectors, those
of infinite numbers and those of another size than most concepts, have no concept and are none;
repeated rows each get their concept; without concepts there is none for any vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.storage import written

#: Cells, at most: their centres are broadcast. And concepts that a cell has on average, at least.
CELLS = 256
LEAST = 1024
#: Rows and bytes of a block, at most.
BLOCK = 1 << 13
BLOCK_BYTES = 4 << 20
#: Bytes of concepts that a task holds, and that a task packs.
HELD_BYTES = 64 << 20
PACKED_BYTES = 16 << 20
#: What rounding may add to a bound, and the difference of similarities that are the same.
SLACK = 1e-6
SAME = 1e-12
#: Numbers in a product of matrices.
PRODUCT = 1 << 20


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * similarity))


def _numbers(df: DataFrame, embedding: str) -> Column:
    """The vectors as ``e``, in single precision if they are given so."""
    kind = df.select(embedding).schema[0].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(embedding).cast("array<float>" if single else "array<double>").alias("e")


def _usable(df: DataFrame, size: int) -> DataFrame:
    """Rows whose ``e`` is a vector of ``size`` known and finite numbers, not all zero."""
    known = F.coalesce(F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where((F.size("e") == size) & known & F.exists("e", lambda x: x != 0))


def nearest_concepts(vectors: DataFrame, concepts: DataFrame, embedding: str = "embedding", cells: int = CELLS) -> DataFrame:
    """``vectors`` with ``concept`` and ``similarity``, from ``concepts`` (name, embedding)."""
    named = concepts.select(F.col("name").cast("string").alias("name"), _numbers(concepts, embedding)).where("name is not null")
    sizes = named.where("size(e) > 0").groupBy(F.size("e").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    asked = written(vectors.withColumn("__id", F.monotonically_increasing_id()), "concept-vectors")
    none = asked.select("__id").withColumns({"concept": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")}).limit(0)
    best = none
    if most:
        size, rows = most["size"], most["count"]
        cells = max(1, min(cells, rows // LEAST))
        best = _best(_usable(asked.select("__id", _numbers(asked, embedding)), size), _usable(named, size), size, rows, cells)
    return asked.join(best, "__id", "left").drop("__id")


def _best(asked: DataFrame, named: DataFrame, size: int, rows: int, cells: int) -> DataFrame:
    context = asked.sparkSession.sparkContext
    # A bounded sample, the same each time; centres are concepts, so the nearest centre is a bound.
    sample = named.orderBy(F.md5("name"), "name").limit(cells).collect()
    if not sample:
        return asked.select("__id", F.lit(None).cast("string").alias("concept"), F.lit(None).cast("double").alias("similarity"))
    centres = context.broadcast(_unit(np.array([r.e for r in sample])))
    parts, bytes_ = context.defaultParallelism, rows * size * _width(named)
    near = _dealt(named, "name string", centres).repartitionByRange(max(parts, -(-bytes_ // PACKED_BYTES)), "cell", F.xxhash64("name"))
    right = written(_packed(near.sortWithinPartitions("cell", "name"), "name string", size, _width(named), centres), "concept-blocks")
    left = _packed(_dealt(asked, "__id bigint", centres).sortWithinPartitions("cell"), "__id bigint", size, _width(asked), centres)
    if asked.rdd.getNumPartitions() < parts:
        left = left.repartition(2 * parts)
    left = written(left.withColumn("block", F.monotonically_increasing_id()), "concept-asked")

    left = left.select("block", F.col("keys").alias("ids"), F.col("e").alias("v"), "reach")
    right = right.select(F.col("keys").alias("names"), "e", "cells", "starts", "radii").coalesce(-(-bytes_ // HELD_BYTES))
    segments = F.arrays_zip("cells", "radii")
    is_open = F.exists(segments, lambda x: F.get("reach", x["cells"]) + x["radii"] + SLACK >= 0)
    pairs = left.join(right.hint("shuffle_replicate_nl"), is_open).drop("reach")
    found = pairs.mapInArrow(_compared(size, _width(asked), _width(named), centres), "__id bigint, s double, name string")
    # A row for each task that held concepts.
    every = found.groupBy("__id").agg(F.max("s").alias("similarity"), F.collect_list(F.struct("s", "name")).alias("b"))
    first = F.array_min(F.transform(F.filter("b", lambda x: x["s"] >= F.col("similarity") - SAME), lambda x: x["name"]))
    return written(every.select("__id", first.alias("concept"), "similarity"), "concept-found")


def _width(df: DataFrame) -> int:
    """Bytes of a number of ``e``."""
    return 4 if isinstance(df.schema["e"].dataType.elementType, T.FloatType) else 8


def _dealt(df: DataFrame, key: str, centres: Broadcast) -> DataFrame:
    """(key, e as bytes, cell, d): the nearest centre and how far it is."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                s = _unit(flat.reshape(n, -1)) @ centres.value.T
                cell = s.argmax(axis=1).astype(np.int32)
                offsets = np.arange(n + 1, dtype=np.int32) * (flat.nbytes // n)
                e = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), e, pa.array(cell), pa.array(_distance(s[np.arange(n), cell]))], [key.split()[0], "e", "cell", "d"])

    return df.mapInArrow(assign, f"{key}, e binary, cell int, d double")


def _packed(df: DataFrame, key: str, size: int, width: int, centres: Broadcast) -> DataFrame:
    """A row for each block of consecutive rows: keys, e as bytes; cells, where each starts and its
    radius; and for each centre, how far the bounds of the rows reach beyond it at most."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (size * width)))
    kind = key.split()[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - n)
                held, n, batch = [*held, part], n + part.num_rows, batch.slice(part.num_rows)
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        e = b"".join(t.column(1).to_pylist())
        cell, d = t.column(2).to_numpy(), t.column(3).to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        far = _distance(_unit(np.frombuffer(e, f"<f{width}").reshape(-1, size)) @ centres.value.T)
        values = [t.column(0).to_pylist(), e, cell[starts], starts.astype(np.int32), np.maximum.reduceat(d, starts), (d[:, None] - far).max(axis=0)]
        kinds = [pa.list_(pa.string() if kind == "string" else pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["keys", "e", "cells", "starts", "radii", "reach"])

    return df.mapInArrow(pack, f"keys array<{kind}>, e binary, cells array<int>, starts array<int>, radii array<double>, reach array<double>")


def _compared(size: int, asked_width: int, named_width: int, centres: Broadcast):
    """Pairs of blocks to (__id, s, name): the nearest concept of each vector among a task's."""
    # Single precision errs by less, on unit vectors.
    margin = (size + 8) * 2.0**-23

    def rows(cell: pa.Scalar, width: int) -> np.ndarray:
        return _unit(np.frombuffer(cell.as_buffer(), f"<f{width}").reshape(-1, size))

    class Vectors:
        """A block of vectors and the best that each has."""

        def __init__(self, ids: np.ndarray, v: np.ndarray):
            self.ids, self.v, self.single = ids, v, v.astype(np.float32)
            s = v @ centres.value.T
            self.far, self.best = _distance(s), s.max(axis=1) - 1e-9
            self.name = np.full(len(v), None, dtype=object)

        def look(self, names: pa.Array, e: np.ndarray, single: np.ndarray, cell: int, radius: float) -> None:
            """Compare with concepts of a cell, sorted by name."""
            open_ = np.flatnonzero(self.far[:, cell] - radius <= _distance(self.best) + SLACK)
            step = max(1, PRODUCT // len(e))
            for at in range(0, len(open_), step):
                some = open_[at : at + step]
                top = (self.single[some] @ single.T).max(axis=1)
                some = some[top >= self.best[some] - margin]
                if not len(some):
                    continue
                s = self.v[some] @ e.T
                top = s.max(axis=1)
                better = top >= self.best[some] - SAME
                some, s, top = some[better], s[better], top[better]
                if not len(some):
                    continue
                found = names.take(pa.array((s >= top[:, None] - SAME).argmax(axis=1))).to_numpy(zero_copy_only=False)
                old, was = self.name[some], self.best[some]
                same = top <= was + SAME
                self.name[some] = [min(o, f) if t and o is not None else f for o, f, t in zip(old, found, same, strict=True)]
                self.best[some] = np.maximum(top, was)

        def found(self) -> pa.RecordBatch:
            have = np.array([x is not None for x in self.name], dtype=bool)
            return pa.RecordBatch.from_arrays(
                [pa.array(self.ids[have]), pa.array(self.best[have]), pa.array(self.name[have], pa.string())], ["__id", "s", "name"]
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            block_ids, ids, v, names, e, cells, starts, radii = batch.columns
            for i in range(batch.num_rows):
                if held is None or block_ids[i].as_py() != block:
                    if held is not None:
                        yield held.found()
                    block, held = block_ids[i].as_py(), Vectors(ids[i].values.to_numpy(), rows(v[i], asked_width))
                concepts = rows(e[i], named_width)
                single, at = concepts.astype(np.float32), [*starts[i].as_py(), len(concepts)]
                for k, (cell, radius) in enumerate(zip(cells[i].as_py(), radii[i].as_py(), strict=True)):
                    part = slice(at[k], at[k + 1])
                    held.look(names[i].values[part], concepts[part], single[part], cell, radius)
        if held is not None:
            yield held.found()

    return compare
