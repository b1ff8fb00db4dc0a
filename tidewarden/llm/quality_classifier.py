"""Quality classifier by co-training of a text view and a metadata view.

The text view sees words (hashed) and character statistics; the metadata view sees source,
language, length and line layout. Each view is a ridge logistic regression. They start from
labelled documents; round by round, each view labels all unlabelled documents where it is
sure, and those pseudo-labels train the other view. Held-out labels then calibrate each
view's log-odds, and the calibrated views are added up to score all documents.

Both views' vectors of every document are written to the shared folder once (0.6 KB a
document). A Newton step of the students is one pass over the unlabelled ones: tasks add up
the gradients and curvatures of the documents that the teachers are sure of, by view and
class, and sums of fixed size are added in order of partitions, so reruns agree. However many
pseudo-labels a class has, together they weigh at most as its share of the labelled
documents does. Labelled documents are at most ``MAX_LABELLED``, the first in order of a keyed
hash of doc_id: the only sample.

Defined cases: null text has no words; null metadata is a category of its own; labels
without a document, or null, are skipped; a document with contrary labels counts as its
mean, half rounds up; of labelled rows that repeat a doc_id one stands for it; without both classes of labels every document gets the mean of the
labels (0.5 if none) as its score; repeated rows each get their score; an empty table gives
an empty result; extra columns are ignored; a score of exactly ``KEEP`` is kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.shared import BROADCAST_BYTES, map_arrow, sized, written

MAX_LABELLED = 8_000
ROUNDS = 4
#: Newton steps of a round.
STEPS = 2
#: A view is sure of a document at this chance or more, of either class.
SURE = 0.95
KEEP = 0.5
SEED = 5
BUCKETS = 96
STATS = 12
LANGS, SOURCES, LAYOUT = 8, 32, 7
TEXT_DIM = BUCKETS + STATS + 1
META_DIM = LANGS + SOURCES + LAYOUT + 1
#: Where each view's columns stand in a document's vector, and how many they are.
VIEWS = (slice(0, TEXT_DIM), slice(TEXT_DIM, TEXT_DIM + META_DIM))
DIMS = (TEXT_DIM, META_DIM)
#: Words whose buckets a worker remembers.
WORDS = 200_000

SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]^~_=+\\@", np.uint8)
ENDS = np.frombuffer(b".?;:,", np.uint8)


class Features:
    """Vectors of both views, one after the other; remembers buckets of words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def text(self, text: str | None) -> np.ndarray:
        out = np.zeros(TEXT_DIM, np.float32)
        out[-1] = 1
        words = (text or "").split()
        if not words:
            return out
        known = self.known
        if len(known) > WORDS:
            known.clear()
        at = []
        for w in words:
            bucket = known.get(w)
            if bucket is None:
                bucket = known[w] = zlib.crc32(w.encode()) % BUCKETS
            at.append(bucket)
        n = len(words)
        out[:BUCKETS] = np.sqrt(np.bincount(at, minlength=BUCKETS) / n)
        hist = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = hist.sum()
        upper, lower = hist[65:91].sum(), hist[97:123].sum()
        out[BUCKETS:-1] = (
            hist[SYMBOLS].sum() / n,
            upper / (upper + lower + 1),
            hist[48:58].sum() / size,
            hist[33] / n,
            hist[124] / n,
            hist[ENDS].sum() / n,
            hist[128:].sum() / size,
            min(size / n, 40) / 10,
            len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            np.log1p(n) / 8,
            n < 10,
        )
        return out

    def meta(self, source: str | None, lang: str | None, size: int | None, text: str | None):
        out = np.zeros(META_DIM, np.float32)
        out[-1] = 1
        out[zlib.crc32(repr(lang).encode()) % LANGS] = 1
        out[LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
        lines = [x for x in (text or "").split("\n") if x.strip()]
        n = len(lines)
        size = size if size is not None and size > 0 else 0
        out[LANGS + SOURCES : -1] = (
            np.log1p(size) / 10,
            (np.log1p(size) / 10) ** 2,
            size == 0,
            np.log1p(n) / 5,
            np.log1p(size / n if n else 0) / 8,
            (n - len(set(lines))) / n if n else 0,
            n <= 1,
        )
        return out


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the vectors of both views, one after the other, as float32 bytes."""
    docs = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        "text",
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = Features()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars", "text")))
        found = [
            np.concatenate([features.text(text), features.meta(source, lang, size, text)]).tobytes()
            for source, lang, size, text in rows
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "x"]
        )

    return map_arrow(docs, each, f"doc_id {kind}, x binary")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, sum(DIMS))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    x = x.astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        curve = (x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Model:
    """Weights of both views, and the scale and shift that calibrate each one's log-odds."""

    text: np.ndarray
    meta: np.ndarray
    scale: np.ndarray
    prior: float
    held_out: float = 0.0

    def chances(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za = self.scale[0] * (a @ self.text) + self.scale[1]
        zb = self.scale[2] * (b @ self.meta) + self.scale[3]
        # Both views hold the prior; it counts once.
        return sigmoid(za), sigmoid(zb), sigmoid(za + zb - self.prior)


def constant(chance: float) -> Model:
    chance = min(max(chance, 1e-6), 1 - 1e-6)
    prior = float(np.log(chance / (1 - chance)))
    nothing = (np.zeros(TEXT_DIM), np.zeros(META_DIM))
    return Model(*nothing, np.array([0, prior, 0, prior]), prior)


#: For each view and class (0, 1): how many are sure, and their gradient and curvature.
Sums = list[list[tuple[float, np.ndarray, np.ndarray]]]


def sure_sums(pool: DataFrame, teachers: list[np.ndarray], students: list[np.ndarray]) -> Sums:
    """What each view's Newton step needs of the unlabelled documents (x) that the other is
    sure of."""
    spark = pool.sparkSession
    shared = spark.sparkContext.broadcast((teachers, students))
    sizes = [1 + d + d * d for d in DIMS for _ in (0, 1)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        teach, learn = shared.value
        total = np.zeros(sum(sizes))
        for batch in batches:
            x = matrix(batch.column("x"))
            parts = []
            for v, other in ((0, 1), (1, 0)):
                chance = sigmoid(x[:, VIEWS[other]] @ teach[other])
                for sure, label in ((chance <= 1 - SURE, 0), (chance >= SURE, 1)):
                    z = x[sure][:, VIEWS[v]].astype(np.float64)
                    p = sigmoid(z @ learn[v])
                    curve = (z.T * (p * (1 - p))) @ z
                    parts += [[float(sure.sum())], z.T @ (p - label), curve.ravel()]
            total += np.concatenate(parts)
        yield row(TaskContext.get().partitionId(), total)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, np.zeros(sum(sizes))
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                first = part if first is None else first
                total += np.frombuffer(sums)
        if first is not None:
            yield row(first, total)

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "sums"])

    # Sums of about the square root of the partitions each, and as many of them to the driver.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, round(parts**0.5))
    found = (
        pool.select("x")
        .mapInArrow(add, "part int, sums binary")
        .repartition(groups, F.col("part") % groups)
        .sortWithinPartitions("part")
        .mapInArrow(join, "part int, sums binary")
        .collect()
    )
    total = np.zeros(sum(sizes))
    for r in sorted(found, key=lambda r: r["part"]):
        total += np.frombuffer(r["sums"])
    pieces = np.split(total, np.cumsum(sizes)[:-1])
    return [
        [
            (float(one[0]), one[1 : 1 + d], one[1 + d :].reshape(d, d))
            for one in pieces[2 * v : 2 * v + 2]
        ]
        for v, d in enumerate(DIMS)
    ]


def newton(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, more: list, share: float, weight: float, ridge: float = 1.0
) -> np.ndarray:
    """Weights after a step for labelled vectors and the sums of pseudo-labels, which weigh
    ``weight`` documents at most, classes in proportion."""
    x = x.astype(np.float64)
    p = sigmoid(x @ w)
    slope = x.T @ (p - y) + ridge * w
    curve = (x.T * (p * (1 - p) + 1e-6)) @ x + ridge * np.eye(len(w))
    for (n, gradient, curvature), part in zip(more, (1 - share, share), strict=True):
        if n:
            each = min(1.0, weight * part / n)
            slope, curve = slope + each * gradient, curve + each * curvature
    step = np.linalg.solve(curve, slope)
    return w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))


def co_train(
    x: np.ndarray, y: np.ndarray, sums: Callable[[list[np.ndarray], list[np.ndarray]], Sums]
) -> Model:
    """Fit both views to labelled vectors and, through ``sums`` (of teachers and students), to
    the unlabelled documents."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    share = float(y.mean())
    rng = np.random.default_rng(SEED)
    held = np.zeros(len(y), bool)
    for label in (0, 1):  # a fifth of each class calibrates
        rows = rng.permutation(np.flatnonzero(y == label))
        held[rows[: max(1, len(rows) // 5)]] = True
    if y[~held].min() == y[~held].max():
        held[:] = False
    own, own_y = x[~held], y[~held]
    weights = [logistic(own[:, c], own_y) for c in VIEWS]
    for turn in range(ROUNDS):
        teachers = weights
        weight = len(own_y) * (turn + 1) / ROUNDS
        for _ in range(STEPS):
            more = sums(teachers, weights)
            weights = [
                newton(own[:, c], own_y, w, m, share, weight)
                for c, w, m in zip(VIEWS, weights, more, strict=True)
            ]
    rows = held if held.any() else np.ones(len(y), bool)
    scale = []
    for c, w in zip(VIEWS, weights, strict=True):
        z = x[rows][:, c] @ w
        shift = logistic(np.stack([z, np.ones(len(z))], axis=1), y[rows], 0.1)
        scale += [max(float(shift[0]), 0.0), float(shift[1])]
    model = Model(weights[0], weights[1], np.array(scale), float(np.log(share / (1 - share))))
    score = model.chances(x[rows][:, VIEWS[0]], x[rows][:, VIEWS[1]])[2]
    model.held_out = float(((score >= KEEP) == (y[rows] == 1)).mean())
    return model


def fit(made: DataFrame, labels: DataFrame) -> Model:
    """A model of written ``vectors`` with ``labels`` (doc_id, quality)."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    known = written(
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.floor(F.avg("quality") + 0.5).cast("double").alias("y")),
        "quality-labels",
    )
    some = (
        known.join(made.select("doc_id"), "doc_id", "left_semi")
        .orderBy(order, "doc_id")
        .limit(MAX_LABELLED)
    )
    # At most MAX_LABELLED rows of two numbers, and as many vectors: one for each doc_id.
    y_of = {r["doc_id"]: r["y"] for r in some.collect()}
    kind = made.schema["doc_id"].dataType
    keys = made.sparkSession.createDataFrame([(k,) for k in y_of], f"doc_id {kind.simpleString()}")
    rows = (
        made.join(F.broadcast(keys), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, sum(DIMS))
    y = np.array([y_of[r["doc_id"]] for r in rows], float)
    n_known = known.count()
    pool = made.join(sized(known.select("doc_id"), n_known, 16), "doc_id", "left_anti")
    if n_known * 16 >= BROADCAST_BYTES:  # a shuffle, not to be done for each pass
        pool = written(pool, "quality-pool")
    return co_train(x, y, lambda teachers, students: sure_sums(pool, teachers, students))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of every row of ``docs``."""
    made = written(vectors(docs), "quality-vectors")
    model = docs.sparkSession.sparkContext.broadcast(fit(made, labels))
    kind = made.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("x"))
        found = [pa.array(c.astype(np.float64)) for c in model.value.chances(*(x[:, v] for v in VIEWS))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *found], ["doc_id", "p_text", "p_meta", "score"]
        )

    found = map_arrow(made, each, f"doc_id {kind}, p_text double, p_meta double, score double")
    return found.withColumn("kept", F.col("score") >= KEEP)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of good quality, by each view and both, of every document."""
    return scores(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
    )
