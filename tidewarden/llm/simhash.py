"""SimHash near-duplicates by a forest of vantage-point trees over Hamming distances.

Fingerprints link at ``RADIUS`` or fewer differing bits, and components of links are
near-duplicate groups. Exact copies share a fingerprint, so all work below is on distinct
fingerprints.

A vantage-point tree splits points by their distance to a chosen point, and the triangle
bound |d(x, v) - d(y, v)| <= d(x, y) tells which side a search may skip. Over all 64 bits
that bound hardly prunes: distances of unlike texts gather around 32, and a search of
radius 4 visits 87 % of the points at each level. So each tree here measures a masked
distance, the differing bits under its mask, for which the triangle bound holds as well.
The bits are cut into RADIUS - r + c blocks and there is a mask for each c of them: a linked
pair differs in RADIUS bits at most, so under some mask it differs in r bits at most, and
that mask's tree is searched within r. c grows with the number of fingerprints; every
choice is exact.

Shards are the trees' leaves and overlap at boundaries: a point belongs to the shard on its
side of each boundary, and if it lies on the inner side within the radius of a boundary, it
queries the outer shard as well. A pair with its points on both sides meets there, so points
of the outer side need not be copied. Vantage points and boundaries are chosen for the least
number of pairs that are left to compare.

Trees are built from a bounded sample and only route. In a shard the tree is carried on over
its own points, and the rest are compared in numpy. A shard
that holds too much (near copies agree on most masks) is split into chunks, and a task
gets each two of them. Linked points within a task are reported as stars, never as all
their pairs; components are found by contracting stars to their least member, round by
round, in tables of the shared folder. Hubs of stars and roots of large components are
bounded in number, so what is joined on them is broadcast apart from the rest.

Defined cases: null or empty text, or one without words, has fingerprint 0, which links
like any other; fewer than four words are one shingle; repeated doc_ids share a component
by their texts; a null doc_id is never a component's id unless the component has no other;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm.shared import join_on_hubs, map_arrow, sized, written

RADIUS = 4
#: Radius of a search under a mask.
MASKED_RADIUS = 1
SHINGLE = 4
SEED = 42
#: Distinct fingerprints that the trees are built from, at most.
SAMPLE = 32_768
#: Points that a shard should hold, and points that are compared with one another.
SHARD = 8192
LEAF = 512
#: A leaf of a tree holds one of so many parts of the sample, or more.
MAX_CUTS = 2048
#: Points that one task's group holds of either chunk at least.
CHUNK = 1024
#: Fingerprints that should agree on all of a mask by chance, at most.
BY_CHANCE = 4096
#: Points that are routed at a time.
ROUTED = 1 << 16
BITS = 64
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"]
        )

    return map_arrow(docs.select("doc_id", "text"), each, f"doc_id {kind}, fp bigint")


# Trees.


def masks_for(n: int, radius: int = MASKED_RADIUS) -> list[int]:
    """Masks such that a linked pair is within ``radius`` under one of them at least."""
    spare = RADIUS - radius
    agree = 1
    while agree < 4 and n >> (BITS * agree // (spare + agree)) > BY_CHANCE:
        agree += 1
    count = spare + agree
    cuts = [_bits(i, i + 1, count) for i in range(count)]
    return [sum(c) for c in combinations(cuts, agree)]


def _bits(first: int, last: int, blocks: int) -> int:
    a, b = BITS * first // blocks, BITS * last // blocks
    return (1 << b) - (1 << a)


class Tree:
    """Nodes (vantage point, boundary, inner child, outer child); leaves are ~shard."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: float):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list[list[int]] = []
        self.leaves = 0
        self.leaf = max(leaf, len(sample) / MAX_CUTS, 1.0)
        self.root = self._build(sample)

    def _build(self, points: np.ndarray) -> int:
        found = split(points, self.mask, self.radius) if len(points) > self.leaf else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        point, distances, boundary = found
        node = len(self.nodes)
        self.nodes.append([point, boundary, 0, 0])
        self.nodes[node][2] = self._build(points[distances <= boundary])
        self.nodes[node][3] = self._build(points[distances > boundary - self.radius])
        return node

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, the numbers of the points that belong to it or query it)."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            point, boundary, inner, outer = self.nodes[node]
            d = np.bitwise_count((points[rows] ^ np.uint64(point)) & self.mask).astype(np.int64)
            stack.append((inner, rows[d <= boundary]))
            stack.append((outer, rows[d > boundary - self.radius]))


def split(points: np.ndarray, mask: np.uint64, radius: int) -> tuple[int, np.ndarray, int] | None:
    """Vantage point, distances to it, and a boundary, such that fewest pairs are left on
    both sides, if there are fewer at all."""
    best, found = 0.95 * len(points) ** 2, None
    for at in (0, len(points) // 3, 2 * len(points) // 3, len(points) - 1):
        d = np.bitwise_count((points ^ points[at]) & mask).astype(np.int64)
        inner = np.cumsum(np.bincount(d, minlength=BITS + 1)).astype(float)
        outer = len(points) - np.concatenate([np.zeros(radius + 1), inner])[1 : len(inner) + 1]
        pairs = inner**2 + outer**2
        pairs[inner == 0] = np.inf
        boundary = int(pairs.argmin())
        if pairs[boundary] < best:
            best, found = pairs[boundary], (int(points[at]), d, boundary)
    return found


def groups(points: np.ndarray, mask: int, radius: int) -> Iterator[np.ndarray]:
    """The tree carried on in a shard: sets such that each linked pair shares one."""
    stack = [points]
    while stack:
        some = stack.pop()
        found = split(some, np.uint64(mask), radius) if len(some) > LEAF else None
        if found is None:
            yield some
        else:
            _, d, boundary = found
            stack += [some[d <= boundary], some[d > boundary - radius]]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS


def stars(points: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (a, b) that connect what is linked among the points, about one for each point.

    A vantage point takes in all points within the radius. Links among those add nothing;
    links from them to others can only reach points within twice the radius.
    """
    if 1 < len(points) <= LEAF:
        linked = near(points, points)
        points = points[linked.sum(axis=1) > 1]
    while len(points) > 1:
        center = points[0]
        d = np.bitwise_count(points ^ center)
        inside, ring = points[d <= RADIUS], points[(d > RADIUS) & (d <= 2 * RADIUS)]
        for x in inside[1:].tolist() if inside[0] == center else inside.tolist():
            yield int(center), x
        for at in range(0, len(inside) if len(ring) else 0, LEAF):
            some = inside[at : at + LEAF]
            for first in range(0, len(ring), 1 << 14):
                part = ring[first : first + (1 << 14)]
                link = near(some, part)
                for k in np.flatnonzero(link.any(axis=0)).tolist():
                    yield int(some[int(link[:, k].argmax())]), int(part[k])
        points = points[d > RADIUS]


class Union:
    """Least members of sets of numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.setdefault(root, root)) != root:
            root = above
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# The distributed search.


def links(prints: DataFrame, radius: int = MASKED_RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``prints`` (fp) that connect all
    that is linked; a is the least of those that one task linked."""
    spark = prints.sparkSession
    n = prints.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.repartition(max(1, min(parts, n // LEAF)))  # tables of few files, too
    masks = masks_for(n, radius)
    share = min(1.0, 2.0 * SAMPLE / max(n, 1))
    rows = prints.sample(share, seed=SEED).limit(SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    leaf = SHARD * max(len(sample), 1) / max(n, 1)
    trees = spark.sparkContext.broadcast([Tree(sample, m, radius, leaf) for m in masks])
    chunk = max(CHUNK, n * len(masks) // (4 * parts))

    def routed(points: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for k, tree in enumerate(trees.value):
            for shard, at in tree.shards(points):
                yield k, shard, points[at]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for points in gathered(batches):
            for k, shard, some in routed(points):
                held[k, shard] = held.get((k, shard), 0) + len(some)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in held], pa.int32()),
                pa.array([s for _, s in held], pa.int32()),
                pa.array(list(held.values()), pa.int64()),
            ],
            ["tree", "shard", "n"],
        )

    # Shards above a chunk: a few for each partition.
    full = (
        prints.mapInArrow(count, "tree int, shard int, n bigint")
        .groupBy("tree", "shard")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > chunk)
        .collect()
    )
    chunks = {(r["tree"], r["shard"]): -(-r["n"] // chunk) for r in full}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches):
            keys, trees_of, prints_of = [], [], []
            for k, shard, points in routed(part):
                c = chunks.get((k, shard), 1)
                own = mixed(points) % np.uint64(c)
                for other in range(c):
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    name = np.uint64((k << 32 | shard) * 2 + 1)
                    keys.append(mixed(mixed(low * np.uint64(c) + high) + name))
                    trees_of.append(np.full(len(points), k, np.int32))
                    prints_of.append(points)
            if keys:
                columns = [np.concatenate(x) for x in (keys, trees_of, prints_of)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0].view(np.int64)),
                        pa.array(columns[1]),
                        pa.array(columns[2].view(np.int64)),
                    ],
                    ["key", "tree", "fp"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Union()

        def close(pieces: list[np.ndarray], tree: int) -> None:
            points = np.unique(np.concatenate(pieces))
            for some in groups(points, masks[tree], radius):
                for a, b in stars(some):
                    sets.join(a, b)

        key, tree, pieces = None, 0, []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            points = batch.column("fp").to_numpy().view(np.uint64)
            kinds = batch.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != key:
                    if pieces:
                        close(pieces, tree)
                    key, tree, pieces = keys[a], int(kinds[a]), []
                pieces.append(points[a:b])
        if pieces:
            close(pieces, tree)
        pairs = [(sets.find(x), x) for x in list(sets.up)]
        pairs = np.array([p for p in pairs if p[0] != p[1]], np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"]
        )

    return (
        prints.mapInArrow(deal, "key bigint, tree int, fp bigint")
        .repartition(parts, "key")
        .sortWithinPartitions("key", "tree")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of batches in arrays of ``ROUTED``: a tree routes many as fast as few."""
    held, n = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= ROUTED:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), to spread numbers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); nodes of a component share a root.

    Each round contracts a node into the least of its neighbours and itself. Fingerprints
    are in no order that a chain of links follows, so rounds are few.
    """
    edges = written(edges.where("a <> b").distinct(), "simhash-links")
    labels = None
    while n := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(
            both.groupBy("a")
            .agg(F.min("b").alias("low"), F.count("*").alias("n"))
            .select(F.col("a").alias("node"), F.least("a", "low").alias("root"), "n"),
            "simhash-parents",
        )
        if labels is None:
            labels = parents.select("node", "root")
        else:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"), "n")
            members = labels.groupBy("root").agg(F.count("*").alias("members"))
            above = written(
                members.join(above, "root", "left").select(
                    "root", F.coalesce("above", "root").alias("above"), F.col("members").alias("n")
                ),
                "simhash-above",
            )
            labels = written(
                join_on_hubs(labels, above, "root", labels.count()).select(
                    "node", F.col("above").alias("root")
                ),
                "simhash-labels",
            )
        of_a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"), "n")
        of_b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"), "n")
        half = written(join_on_hubs(edges, of_a, "a", 2 * n), "simhash-half")
        edges = written(
            join_on_hubs(half, of_b, "b", 2 * n)
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "simhash-links",
        )
    return labels if labels is not None else edges.select(
        F.col("a").alias("node"), F.col("b").alias("root")
    )


def near_duplicates(docs: DataFrame, radius: int = MASKED_RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    found = written(fingerprints(docs), "simhash-docs")
    prints = written(
        found.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")),
        "simhash-prints",
    )
    labels = components(links(prints.select("fp"), radius))
    labels = sized(labels, labels.count(), 16)
    rooted = written(
        prints.join(labels, F.col("fp") == F.col("node"), "left")
        .select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root")),
        "simhash-rooted",
    )
    least = written(
        rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("n")),
        "simhash-least",
    )
    named = join_on_hubs(rooted, least, "root", rooted.count())
    named = written(named.select("fp", "component_id", "n"), "simhash-components")
    return join_on_hubs(found, named, "fp", found.count()).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """doc_id to (fingerprint, component) with every pair compared."""
    prints = {}
    for doc_id, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        size = min(SHINGLE, len(words))
        hashes = [
            xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED)
            for i in range(len(words) - size + 1 if words else 0)
        ]
        prints[doc_id] = sum(
            1 << k for k in range(BITS) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)
        )
    sets = Union()
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, doc_id in enumerate(ids):
        sets.find(doc_id)
        for j in np.flatnonzero(np.bitwise_count(values[: k + 1] ^ values[k]) <= RADIUS).tolist():
            sets.join(ids[j], doc_id)
    return {i: (f"{prints[i]:016x}", sets.find(i)) for i in ids}
