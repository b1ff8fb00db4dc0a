"""Token sequences of equal length, packed by a non-negative least squares plan.

A document's ids are cut at every SEQUENCE ids, so it has full pieces and a last one of any
length. How many pieces each length has is a histogram of at most SEQUENCE numbers, and what
is planned on it is bounded whatever the number of documents:

1. enumerate   combinations of two or three lengths that fill a sequence
2. solve       repeats of each combination, non-negative least squares against the histogram
               (Lawson-Hanson: an active set with the inverse of its normal matrix kept; at
               most as many combinations as lengths are repeated)
3. round       repeats to whole numbers that the histogram has pieces for
4. residuals   greedily, longest first, with one or two lengths that fill the sequence, or else
               the longest that fit; what fills none is laid end to end and cut at the ends of
               sequences

So documents are cut where they are longer than a sequence or left over, and nothing is padded:
the last sequence of those laid end to end is cut at powers of two. The plan says which
pieces of a length, by their number within it, go where: a few thousand ranges, broadcast.

Plan: documents are encoded where they lie and written once, each piece numbered among those of
its length and lot (a task's). Counts by lot and length, summed over lots, make that a number
within the length, so hot lengths need no group of their own. Ids are not shuffled unless
lots are so many that their counts are too large to broadcast.

Defined cases: a null text is empty and has the end id alone; each row is a document, so
repeated rows and null doc_ids are packed one by one; pieces of one length are numbered by lot
and place in it, so they follow how the input is split; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.llm.shared import scratch_path, sized, small_batches, written
from tidewarden.llm.token_output import END_ID, encoder_of

SEQUENCE = 1024
#: Ids that a batch of pieces holds, but for one document's.
BATCH_IDS = 4 << 20
#: Least squares stops where no combination's gradient is above this part of a length's mean.
TOLERANCE = 0.01
PIECE_SCHEMA = "doc_id bigint, start bigint, length int, doc_tokens bigint, lot int, place bigint, ids binary"
PIECE_ARROW = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int32(),
    "doc_tokens": pa.int64(),
    "lot": pa.int32(),
    "place": pa.int64(),
    "ids": pa.binary(),
}


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``sequence`` ids, little-endian unsigned
    32-bit numbers, written; ``place`` numbers those of one lot and length."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        lot, seen = TaskContext.get().partitionId(), [0] * (sequence + 1)
        rows: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, PIECE_ARROW.values(), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, list(PIECE_ARROW))

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = np.append(np.frombuffer(encoder.encode(text or ""), encoder.dtype), END_ID).astype("<u4")
                data = memoryview(ids.tobytes())
                for start in range(0, len(ids), sequence):
                    length = min(sequence, len(ids) - start)
                    own = bytes(data[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, len(ids), lot, seen[length], own))
                    seen[length] += 1
                held += len(ids)
                if held >= BATCH_IDS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    path = scratch_path(docs.sparkSession, "packing-pieces")
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    docs.mapInArrow(run, PIECE_SCHEMA).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(PIECE_SCHEMA).parquet(path)


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Twos (with a zero) and threes of lengths that fill a sequence, as rows in rising order, of
    lengths that the histogram has; place l of it counts pieces of length l."""
    full = len(histogram) - 1
    have = histogram > 0
    have[0] = have[full] = False
    first = np.flatnonzero(have)
    out = [np.zeros((0, 3), np.int64)]
    for a in [0, *first.tolist()]:
        b = np.arange(max(a, 1), (full - a) // 2 + 1)
        c = full - a - b
        some = have[b] & have[c]
        out.append(np.stack([np.full(int(some.sum()), a), b[some], c[some]], axis=1))
    return np.concatenate(out)


class LeastSquares:
    """min |A x - h|, x >= 0, for columns of A that count the lengths of a combination."""

    def __init__(self, histogram: np.ndarray, columns: np.ndarray):
        self.h = histogram.astype(float)
        self.h[0] = 0
        self.columns = columns
        self.own: list[int] = []  # the active columns
        self.rows = np.zeros((0, len(histogram)))  # and what they count
        self.inverse = np.zeros((0, 0))  # of their normal matrix
        self.x = np.zeros(0)

    def counts(self, j: int) -> np.ndarray:
        out = np.bincount(self.columns[j], minlength=len(self.h)).astype(float)
        out[0] = 0
        return out

    def residual(self) -> np.ndarray:
        return self.h - self.x @ self.rows

    def enter(self, j: int) -> bool:
        """Make a column active, unless those active span it; the inverse by its border."""
        row = self.counts(j)
        across = self.rows @ row
        half = self.inverse @ across
        rest = row @ row - across @ half
        if rest < 1e-9:
            return False
        n = len(self.own)
        inverse = np.empty((n + 1, n + 1))
        inverse[:n, :n] = self.inverse + np.outer(half, half) / rest
        inverse[n, :n] = inverse[:n, n] = -half / rest
        inverse[n, n] = 1 / rest
        self.inverse, self.rows = inverse, np.vstack([self.rows, row])
        self.own.append(j)
        self.x = np.append(self.x, 0.0)
        return True

    def leave(self, i: int) -> None:
        keep = np.arange(len(self.own)) != i
        across = self.inverse[keep, i]
        self.inverse = self.inverse[np.ix_(keep, keep)] - np.outer(across, across) / self.inverse[i, i]
        self.rows, self.x = self.rows[keep], self.x[keep]
        del self.own[i]

    def solve(self) -> dict[int, float]:
        """Repeats of columns above 0."""
        mean = self.h.sum() / max(1, np.count_nonzero(self.h))
        spanned: set[int] = set()
        for _ in range(3 * len(self.h)):
            left = self.residual()
            left[0] = 0
            gradient = left[self.columns].sum(axis=1)
            gradient[[*self.own, *spanned]] = 0
            if not len(gradient) or gradient.max() <= max(1.0, TOLERANCE * mean):
                break
            j = int(gradient.argmax())
            if not self.enter(j):
                spanned.add(j)
                continue
            spanned.clear()
            while True:
                want = self.inverse @ (self.rows @ self.h)
                if (want > 0).all():
                    self.x = want
                    break
                below = want <= 0
                step = (self.x[below] / (self.x[below] - want[below] + 1e-300)).min()
                self.x = self.x + step * (want - self.x)
                out = int(np.where(below, self.x, np.inf).argmin())
                self.leave(out)
        return {j: float(v) for j, v in zip(self.own, self.x, strict=True) if v > 0}


class Plan:
    """Where pieces go, by length and number within it."""

    def __init__(self, histogram: np.ndarray):
        self.full = len(histogram) - 1
        self.left = histogram.copy()
        self.first = np.zeros_like(histogram)  # pieces of each length that have a place
        self.sequences = 0
        #: (length, first, last, sequence, offset, position): the first of pieces first to last has
        #: its place in ``sequence``, each other one in the next; or has ``position`` in the stream.
        self.ranges: list[tuple[int, int, int, int | None, int | None, int | None]] = []
        self.repeat({self.full: 1}, int(histogram[self.full]))
        columns = combinations(self.left)
        found = LeastSquares(self.left, columns).solve() if len(columns) else {}
        for j, x in sorted(found.items(), key=lambda v: (-v[1], v[0])):
            self.repeat(counted(columns[j].tolist()), round(x))
        self.greedy()
        self.stream()

    def repeat(self, lengths: dict[int, int], times: int) -> None:
        """So many sequences of these lengths, as far as there are pieces."""
        times = min(times, *(int(self.left[x]) // n for x, n in lengths.items()))
        if times <= 0:
            return
        offset = 0
        for length in sorted(lengths, reverse=True):
            for _ in range(lengths[length]):
                at = int(self.first[length])
                self.ranges.append((length, at, at + times, self.sequences, offset, None))
                self.first[length] += times
                self.left[length] -= times
                offset += length
        self.sequences += times

    def greedy(self) -> None:
        """Longest first, with what fills the sequence: one piece, two, or the longest that fit."""
        for longest in range(self.full - 1, 0, -1):
            while self.left[longest]:
                own = self.filled(longest)
                if own is None:
                    break
                self.repeat(own, int(self.left[longest]))

    def filled(self, longest: int) -> dict[int, int] | None:
        """Lengths, with one of ``longest``, that fill a sequence and are left."""
        left = self.left.copy()
        left[longest] -= 1
        room = self.full - longest
        if left[room]:
            return counted([longest, room])
        a = np.arange(1, room // 2 + 1)
        pairs = np.flatnonzero((left[a] > 0) & (left[room - a] > (a == room - a)))
        if len(pairs):
            a = int(a[pairs[-1]])
            return counted([longest, a, room - a])
        own, length = [longest], min(longest, room)
        while room and length:
            if left[length]:
                own.append(length)
                left[length] -= 1
                room -= length
                length = min(length, room)
            else:
                length -= 1
        return None if room else counted(own)

    def stream(self) -> None:
        """What is left, end to end: full sequences, then powers of two."""
        position = 0
        for length in range(self.full, 0, -1):
            n, at = int(self.left[length]), int(self.first[length])
            if n:
                self.ranges.append((length, at, at + n, None, None, position))
                position += n * length
        self.whole = position // self.full * self.full  # ids of full sequences of the stream
        self.ends: list[int] = []  # of the sequences after them
        at = self.whole
        for bit in reversed(range(self.full.bit_length())):
            if (position - self.whole) >> bit & 1:
                at += 1 << bit
                self.ends.append(at)


def counted(lengths: list[int]) -> dict[int, int]:
    return {x: lengths.count(x) for x in set(lengths) - {0}}


def numbered(cut: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Pieces with their number within their length, and how many each length has."""
    lots = cut.groupBy("lot", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)
    lots = written(lots.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-lots")
    longest = cut.agg(F.max("length")).first()[0] or 0
    histogram = np.zeros(longest + 1, np.int64)
    for length, n in lots.groupBy("length").agg(F.sum("n")).collect():  # one row a length
        histogram[length] = n
    lots = sized(lots.drop("n"), lots.count(), 24)
    own = cut.join(lots, ["lot", "length"]).withColumn("number", F.col("base") + F.col("place"))
    return own.drop("lot", "place", "base"), histogram


def placed(own: DataFrame, plan: Plan) -> DataFrame:
    """Pieces by the plan, those of the stream cut at the ends of its sequences."""
    spark = own.sparkSession
    schema = "size int, first bigint, last bigint, sequence bigint, slot bigint, position bigint"
    ranges = spark.createDataFrame(plan.ranges, schema)
    within = (F.col("length") == F.col("size")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last"))
    own = own.join(F.broadcast(ranges), within).withColumn("after", F.col("number") - F.col("first"))
    ends = f"array({','.join(f'{x}L' for x in plan.ends)})" if plan.ends else "cast(array() as array<bigint>)"
    full, whole, made = plan.full, plan.whole, plan.sequences
    own = own.selectExpr("*", "coalesce(position + after * length, 0L) as low").selectExpr(
        "*",
        f"""case when position is null then cast(array() as array<bigint>)
            else filter(concat(array((low div {full} + 1) * {full}), {ends}), x -> x > low and x < low + length)
            end as cuts""",
    )
    own = own.selectExpr("*", "concat(array(low), cuts) as a", "concat(cuts, array(low + length)) as b")
    own = own.selectExpr("*", "explode(arrays_zip(a, b)) as part").selectExpr(
        "doc_id",
        "start + part.a - low as start",
        "part.b - part.a as length",
        "doc_tokens",
        "substring(ids, cast(4 * (part.a - low) + 1 as int), cast(4 * (part.b - part.a) as int)) as ids",
        "position is not null as streamed", "sequence + after as sequence", "slot", "part.a as at",
    )
    return own.selectExpr(
        "doc_id", "start", "length", "doc_tokens", "ids",
        f"""case when not streamed then sequence
            when at < {whole}L then {made}L + at div {full}
            else {made + whole // full}L + size(filter({ends}, x -> x <= at)) end as sequence_id""",
        f"""case when not streamed then slot when at < {whole}L then at % {full}
            else at - array_max(concat(array({whole}L), filter({ends}, x -> x <= at))) end as offset""",
    )


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset) of ``docs`` (doc_id,
    text); sequences have ``sequence`` ids (a power of two), or a lesser power of two.

    ``tokenizer`` is the place of a tokenizer file on every machine.
    """
    if sequence & (sequence - 1) or sequence < 2:
        raise ValueError("sequences have a power of two of ids")
    own, histogram = numbered(pieces(docs, tokenizer, sequence))
    whole = np.zeros(sequence + 1, np.int64)
    whole[: len(histogram)] = histogram
    return placed(own, Plan(whole))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids, offsets) of packed pieces; a sequence has as many
    pieces as ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .selectExpr(
            "sequence_id",
            "n_tokens",
            "aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids)) as ids",
            "parts.doc_id as doc_ids",
            "parts.offset as offsets",
        )
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
