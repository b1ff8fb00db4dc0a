"""Mixing sources to target weights by a hypergeometric splitting tree, DataFrame functions only.

1. Sizes. Every document's words are counted in its row; (doc_id, source, size, hash of the
   text) is written to the shared folder and texts are not read again. Rows alike in these
   are counted and go on as one.
2. Targets. Sources in code point order, null last, weigh 3, 1, 2 in turn and share 150 %
   of all words; a target stops at twice its source's size and the excess is reshared by
   weight. That is water-filling: with sources in order of the level at which they are
   full, one running sum tells which are.
3. Stream. A source's documents are permuted by a keyed hash. Prefix sums of their words, in
   two steps (within hash buckets, then over bucket totals, both of about the square root
   of the source's documents), place each document in its source's stream, which holds the
   source as often as the mix may repeat it and is cut into blocks of ``BLOCK_WORDS``.
4. Splitting tree. A source's quota is the number of blocks that its target takes. The tree
   halves the output shards level by level, and each node draws how many blocks of each
   source go left from the multivariate hypergeometric distribution, one source after
   another.
5. Blocks. A keyed permutation (swap-or-not, exact for any number) puts a source's blocks
   into an order of drawing. Each shard draws a range of that order as long as its quota, so
   shards get disjoint blocks; blocks beyond the quota are not in the mix, and of the last
   one in the order only the words up to the target are. A document is taken as far as its
   words are in drawn blocks. Within its shard a piece has a place by hash (``order_key``).

With ``whole_documents`` no document is cut: the stream ends at the target, with the
document there taken if half of it or more is due, so all its blocks are drawn, and a
document goes to the shard that drew the block it starts in.

The tree holds a number for each source and shard: shards are at most ``MAX_SHARDS``, and
sources are few (tens to thousands). A shard too large for one file is cut by ranges of
order_key, each mixed like the whole. Documents are only ever grouped by (source, bucket).

Defined cases: null text has size 0 and is never taken; null is a source of its own; a
source of size 0 has target 0; repeated rows are documents of their own, next to each other
in the stream; an empty table gives an empty result; extra columns are ignored. ``SEED``
fixes all draws, so reruns agree, however the input is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.llm.quality_rules import let, word_list
from tidewarden.llm.shared import BROADCAST_BYTES, join_on_hubs, sized, written

WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all words that the mix has, in percent, and how often it may repeat a source.
TOTAL_PERCENT = 150
MAX_REPEATS = 2
BLOCK_WORDS = 4096
#: Blocks that a shard should hold, and shards at most, a power of two.
SHARD_BLOCKS = 16
MAX_SHARDS = 1024
#: Rounds of the permutation of blocks.
ROUNDS = 24
#: Rows alike that one task returns.
ALIKE = 1 << 16
SEED = 20240607
#: Draws further than so many deviations from the mean have a chance below 1e-20.
TAIL = 10


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of every row; tie is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        "source",
        F.size(word_list(text)).cast("bigint").alias("size"),
        F.xxhash64(text).alias("tie"),
    )


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_rank, n_docs, source_size, target) for every source of ``sizes``
    (source, size, n: rows alike)."""
    sources = sizes.groupBy("source").agg(
        F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    ranked = sources.withColumn(
        "source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    )
    weights = F.array(*(F.lit(w) for w in WEIGHTS))
    everything = W.partitionBy()
    by_level = W.orderBy("level", "source_rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    # The level is the words a unit of weight has got when the source is full.
    full = (
        ranked.withColumn(
            "weight", F.get(weights, F.pmod(F.col("source_rank") - 1, F.lit(len(WEIGHTS))))
        )
        .withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * (TOTAL_PERCENT / 100))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left") / F.sum("weight").over(after))
    )
    # Sources that are full come first; the first that isn't sets the share of the rest.
    is_full = F.col("level") <= F.col("share")
    share = F.min(F.when(~is_full, F.struct("level", "share"))).over(everything)["share"]
    return full.select(
        "source",
        "source_rank",
        "n_docs",
        "source_size",
        F.when(is_full, F.col("cap")).otherwise(F.col("weight") * share).alias("target"),
    )


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``good``, from a uniform ``u``.

    Weights follow from one another by a ratio, so a first walk over the support sums them
    and a second stops where the sum passes ``u``.
    """
    good, total, draws = (x.cast("double") for x in (good, total, draws))
    mean = draws * good / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(
        mean
        * (1 - good / F.greatest(total, F.lit(1.0)))
        * (total - draws)
        / F.greatest(total - 1, F.lit(1.0))
    )
    low = F.greatest(
        F.lit(0.0), draws - (total - good), F.floor(mean - TAIL * spread - 5).cast("double")
    )
    high = F.least(good, draws, F.ceil(mean + TAIL * spread + 5).cast("double"))

    def ratio(k: Column) -> Column:
        """Weight of k over that of k - 1."""
        return ((good - k + 1) * (draws - k + 1)) / (k * (total - good - draws + k))

    def walk(x: Column) -> Column:
        steps = F.when(
            x["high"] > x["low"],
            F.sequence((x["low"] + 1).cast("bigint"), x["high"].cast("bigint")),
        ).otherwise(F.array().cast("array<bigint>"))
        whole = F.aggregate(
            steps,
            F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")),
            lambda a, k: F.struct(
                (a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"] * ratio(k)).alias("sum")
            ),
            lambda a: a["sum"],
        )
        return let(
            whole,
            lambda z: F.aggregate(
                steps,
                F.struct(
                    F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), x["low"].alias("got")
                ),
                lambda a, k: F.struct(
                    (a["w"] * ratio(k)).alias("w"),
                    (a["sum"] + a["w"] * ratio(k)).alias("sum"),
                    F.when(a["sum"] < u * z, k.cast("double"))
                    .otherwise(a["got"])
                    .alias("got"),
                ),
                lambda a: a["got"],
            ),
        )

    return let(F.struct(low.alias("low"), high.alias("high")), walk).cast("bigint")


def split_quotas(quotas: Column, take: Column, node: Column) -> Column:
    """Left part of a node's quotas: ``take`` blocks, drawn source after source."""

    def draw(acc: Column, x: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.lit(SEED), node, x["at"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return let(
            hypergeometric(x["quota"], acc["total"], acc["take"], u),
            lambda got: F.struct(
                F.concat(acc["left"], F.array(got)).alias("left"),
                (acc["total"] - x["quota"]).alias("total"),
                (acc["take"] - got).alias("take"),
            ),
        )

    return F.aggregate(
        F.transform(quotas, lambda q, i: F.struct(q.alias("quota"), i.alias("at"))),
        F.struct(
            F.array().cast("array<bigint>").alias("left"),
            array_sum(quotas).alias("total"),
            take.alias("take"),
        ),
        draw,
        lambda acc: acc["left"],
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def shard_quotas(sources: DataFrame) -> DataFrame:
    """(shard, quotas: blocks of each source in order of rank), from the splitting tree.

    Nodes are numbered from 1 at the root, 2 n and 2 n + 1 below n; a leaf is a shard. The
    upper levels grow in one row, and the subtrees below them in as many tasks as there are.
    """
    total = sources.agg(F.sum("blocks")).first()[0] or 0
    depth = 0
    while (1 << depth) < MAX_SHARDS and (SHARD_BLOCKS << depth) < total:
        depth += 1
    quotas = F.transform(
        F.sort_array(F.collect_list(F.struct("source_rank", "blocks"))), lambda x: x["blocks"]
    )
    root = F.struct(F.lit(1).cast("bigint").alias("node"), quotas.alias("quotas"))
    nodes = sources.agg(F.array(root).alias("nodes"))
    upper = depth // 2
    if upper:
        parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        nodes = (
            nodes.select(F.explode(grown(F.col("nodes"), upper)).alias("x"))
            .repartition(parts, "x.node")
            .select(F.array("x").alias("nodes"))
        )
    if depth:
        nodes = nodes.select(grown(F.col("nodes"), depth - upper).alias("nodes"))
    return nodes.select(F.explode("nodes").alias("x")).select(
        (F.col("x.node") - (1 << depth)).alias("shard"), "x.quotas"
    )


def grown(nodes: Column, levels: int) -> Column:
    """What is below some nodes after so many levels."""

    def children(x: Column) -> Column:
        take = F.floor((array_sum(x["quotas"]) + 1) / 2)
        return let(
            split_quotas(x["quotas"], take, x["node"]),
            lambda left: F.array(
                F.struct((2 * x["node"]).alias("node"), left.alias("quotas")),
                F.struct(
                    (2 * x["node"] + 1).alias("node"),
                    F.zip_with(x["quotas"], left, lambda q, n: q - n).alias("quotas"),
                ),
            ),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(levels)), nodes, lambda some, _: F.flatten(F.transform(some, children))
    )


def source_plan(sizes: DataFrame, whole_documents: bool) -> DataFrame:
    """Targets, the stream's blocks and each shard's range of the order of drawing, a row for
    each source."""
    words, stream = F.col("words"), F.col("stream")
    block = F.lit(BLOCK_WORDS).cast("bigint")
    found = (
        targets(sizes)
        .withColumn("words", F.round("target").cast("bigint"))
        .withColumn("stream", words if whole_documents else MAX_REPEATS * F.col("source_size"))
        .withColumn("blocks", F.expr(f"(stream + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}"))
        # The stream's last block lacks some words; it comes at some place of the order.
        .withColumn("lacks", F.col("blocks") * block - stream)
        .withColumn("rounds", round_keys(F.col("source_rank"), F.col("blocks")))
        .withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("rounds")))
        .withColumn("ahead", (F.col("short_at") + 1) * block - F.col("lacks"))
        .withColumn(
            "drawn",
            F.ceil((words + F.when(words > F.col("ahead"), F.col("lacks")).otherwise(0)) / block),
        )
    )
    found = written(found, "mix-targets")
    ends = W.partitionBy("source_rank").orderBy("shard")
    per_source = (
        shard_quotas(found.select("source_rank", F.col("drawn").alias("blocks")))
        .select("shard", F.posexplode("quotas").alias("at", "quota"))
        .withColumn("source_rank", F.col("at") + 1)
        .withColumn("end", F.sum("quota").over(ends))
        .groupBy("source_rank")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("x"))
        .select("source_rank", F.col("x.end").alias("shard_ends"))
    )
    return written(found.join(per_source, "source_rank", "left"), "mix-plan")


def round_keys(source: Column, blocks: Column) -> Column:
    """Keys of the rounds that permute a source's blocks."""
    key = lambda i: F.pmod(F.xxhash64(F.lit(SEED), source, i), F.greatest(blocks, F.lit(1)))
    return F.transform(
        F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.struct(i.alias("round"), key(i).alias("key"))
    )


def permuted(block: Column, blocks: Column, rounds: Column) -> Column:
    """The place of a block in the order of drawing: swap-or-not. A round pairs x with
    key - x, and a bit of a hash of the pair tells whether it swaps, so each round, and all of
    them, map the blocks one to one."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(r["key"] - x, F.greatest(blocks, F.lit(1)))
        return let(
            other,
            lambda y: F.when(
                F.xxhash64(F.lit(SEED), r["round"], r["key"], F.greatest(x, y)) % 2 == 0, x
            ).otherwise(y),
        )

    return F.aggregate(rounds, block.cast("bigint"), swap)


def shard_of(place: Column) -> Column:
    """The shard whose range holds a place: how many ranges end before it, bit by bit."""
    bits = [MAX_SHARDS >> i for i in range(MAX_SHARDS.bit_length())]
    return F.aggregate(
        F.array(*map(F.lit, bits)),
        F.lit(0),
        lambda at, b: F.when(F.get("shard_ends", at + b - 1) <= place, at + b).otherwise(at),
    )


def stream_places(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document with ``start``, its first word's place in its source's stream, and what
    the plan has of its source."""
    n_sources = plan.count()
    names = plan.select("source", "source_rank", "n_docs")
    names = sized(names, n_sources, 100)
    buckets = F.greatest(F.ceil(F.sqrt("n_docs")).cast("int"), F.lit(1))
    keyed = (
        docs.withColumnRenamed("source", "own_source")
        .join(names, F.col("own_source").eqNullSafe(F.col("source")))
        .withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "size", "tie"))
        .select(
            "doc_id",
            "own_source",
            "size",
            "tie",
            F.col("n").alias("alike"),
            "source_rank",
            "key",
            F.pmod(F.xxhash64("key"), buckets).cast("int").alias("bucket"),
        )
    )
    all_words = F.col("size") * F.col("alike")
    totals = keyed.groupBy("source_rank", "bucket").agg(F.sum(all_words).alias("bucket_size"))
    by_bucket = W.partitionBy("source_rank").orderBy("bucket")
    totals = totals.withColumn(
        "bucket_start",
        F.coalesce(
            F.sum("bucket_size").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    within = W.partitionBy("source_rank", "bucket").orderBy("key", "doc_id", "size", "tie")
    inner = keyed.withColumn(
        "inner_start",
        F.coalesce(F.sum(all_words).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    placed = one_by_one(
        inner.join(totals, ["source_rank", "bucket"]).select(
            "doc_id",
            "own_source",
            "size",
            "alike",
            "source_rank",
            "key",
            (F.col("inner_start") + F.col("bucket_start")).alias("start"),
        ),
        docs.agg(F.max("n")).first()[0] or 0,
    )
    plan = plan.drop("source").withColumnRenamed("n_docs", "n")
    row_bytes = 600 + 8 * MAX_SHARDS
    if n_sources * row_bytes < BROADCAST_BYTES:
        return placed.join(F.broadcast(plan.drop("n")), "source_rank")
    placed = written(placed, "mix-placed")
    return join_on_hubs(placed, plan, "source_rank", placed.count())


def one_by_one(placed: DataFrame, most: int) -> DataFrame:
    """Rows alike, counted in ``alike``, as a row each (``copy`` tells them apart), their starts
    next to each other; groups of more than ``ALIKE`` are dealt to tasks first."""
    if most > ALIKE:
        parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        first = F.sequence(F.lit(0).cast("bigint"), F.col("alike") - 1, F.lit(ALIKE).cast("bigint"))
        placed = placed.withColumn("first", F.explode(first)).repartition(parts, "key", "first")
    else:
        placed = placed.withColumn("first", F.lit(0).cast("bigint"))
    last = F.least(F.col("alike"), F.col("first") + ALIKE) - 1
    return (
        placed.withColumn("copy", F.explode(F.sequence(F.col("first"), last)))
        .withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
        .drop("alike", "first")
    )


def mix(docs: DataFrame, whole_documents: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``.

    ``copies`` is an array of (words, block, shard, order_key): each piece of the document that
    the mix takes, with its number of words, and the place of its block in the order of
    drawing. With ``whole_documents`` a piece is the document.
    """
    return place(written(document_sizes(docs), "mix-sizes"), whole_documents)


def place(sizes: DataFrame, whole_documents: bool = False) -> DataFrame:
    """``mix`` of documents whose sizes are counted: (doc_id, source, size, tie)."""
    docs = written(
        sizes.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n")), "mix-documents"
    )
    placed = stream_places(docs, source_plan(docs, whole_documents))
    pieces = whole_pieces if whole_documents else drawn_pieces
    return placed.select(
        "doc_id",
        F.col("own_source").alias("source"),
        "size",
        "source_size",
        "target",
        F.filter(
            F.concat(*(pieces(r) for r in range(MAX_REPEATS))), lambda c: c["words"] > 0
        ).alias("copies"),
    )


def drawn_pieces(repeat: int) -> Column:
    """What drawn blocks hold of a document, this time that the stream has it."""
    first = repeat * F.col("source_size") + F.col("start")
    last = first + F.col("size")
    block_words = F.lit(BLOCK_WORDS).cast("bigint")

    def words(block: Column, place: Column) -> Column:
        before = place * block_words - F.when(place > F.col("short_at"), F.col("lacks")).otherwise(0)
        due = F.least(F.greatest(F.col("words") - before, F.lit(0).cast("bigint")), block_words)
        start = block * block_words
        return F.greatest(F.least(last, start + due) - F.greatest(first, start), F.lit(0).cast("bigint"))

    def of_block(block: Column) -> Column:
        return let(
            permuted(block, F.col("blocks"), F.col("rounds")),
            lambda place: piece_of(repeat, words(block, place), block, place),
        )

    # Words are counted from 0, so the last one is in the block of last - 1.
    own = F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words))
    return F.when(F.col("size") > 0, F.transform(own, of_block)).otherwise(no_pieces())


def whole_pieces(repeat: int) -> Column:
    """The document, if the stream has half of it or more before the target."""
    first = repeat * F.col("source_size") + F.col("start")
    due = F.least(F.col("size"), F.col("words") - first)
    # A document rounded up starts before the target, too.
    block = F.floor(first / BLOCK_WORDS)
    taken = (F.col("size") > 0) & (2 * due >= F.col("size"))
    one = F.transform(
        F.array(block),
        lambda b: let(
            permuted(b, F.col("blocks"), F.col("rounds")),
            lambda place: piece_of(repeat, F.col("size"), b, place),
        ),
    )
    return F.when(taken, one).otherwise(no_pieces())


def piece_of(repeat: int, words: Column, block: Column, place: Column) -> Column:
    return F.struct(
        words.alias("words"),
        place.alias("block"),
        F.when(words > 0, shard_of(place)).alias("shard"),
        F.xxhash64(F.lit(SEED), F.lit(repeat), "key", "copy", block).alias("order_key"),
    )


def no_pieces() -> Column:
    kind = "array<struct<words: bigint, block: bigint, shard: int, order_key: bigint>>"
    return F.expr(f"cast(array() as {kind})")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"]).alias("taken"),
        F.array_sort(F.array_distinct(F.transform("copies", lambda c: c["shard"]))).alias("shards"),
    )
