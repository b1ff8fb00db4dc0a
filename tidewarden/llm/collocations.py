"""Phrase collocations by hashed bucket counts, bitmaps and Apriori pruning (PCY / DHP).

Phrases of 2 to ``longest`` words that occur often enough in their language, with how much
more often than their parts would suggest. One pass over the texts for each length:

    pass 1      counts words, and adds each pair to one of BUCKETS counters by its hash
    pass k      counts phrases of k words exactly whose two parts of k - 1 words may be
                frequent and whose bucket is; adds the next length's phrases, if their parts
                may be frequent, to counters

A bucket counts at least what its phrases do, so none that is frequent is lost. What the next
pass needs is one bitmap a length: buckets with enough hits, and buckets of phrases that were
found frequent. Both are broadcast. There is a bucket for every two to three words, by the length
of all texts, but BUCKETS at most (8 MB a bitmap), which bounds what a task holds too. Counters
stop at the least frequency: a sum of numbers cut there reaches it if and only if the sum
itself does, so one byte a counter will do as long as the frequency fits one. Beyond some
billion words buckets fill and prune less; counts stay exact, and the exchange of exact counts
grows.

Texts are parted into words once: pass 1 writes each batch as its different words and their
numbers in a row, which later passes read. Exact counts are of words themselves: within a
task, words have numbers, and numbers of phrases are made of those of their parts. Tasks hand
on sums for each phrase, never rows for each place, so a word with a third of all places is a
row a task. Counters and sums cost a task the same however little it reads, so a pass has no
more tasks than keep all cores busy for WAVES rounds; its parts are read one after another.
Scores are joined by phrase, and each language's first rows are taken in two steps, by hashes of
phrases and then whole. Tables of passes are removed when they have been read.

Defined cases: a null text is empty, a null lang is ``und``; words are compared by their UTF-8
bytes; phrases of one score and frequency stand in order of these bytes; a language without
candidates has no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewarden.llm.shared import remove, scratch_path, small_batches, written

MIN_COUNT = 30
LONGEST = 4
#: Rows of each language's result.
FIRST = 2000
SCALE = 2_000_000
#: A longer candidate with so many hundredths of the places of one within it replaces it.
COVER = 80
#: Counters of a pass, and bits of a bitmap, at most; one for so many bytes of text.
BUCKETS = 1 << 26
BUCKET_BYTES = 16
#: Counters that tasks hand on at once, as one row.
BLOCK = 1 << 13
#: Words and phrases whose counts a task holds before it hands them on.
HELD = 400_000
#: Words that a task numbers before it starts anew.
NUMBERED = 700_000
#: Tasks of a pass for each core.
WAVES = 2
#: Tasks that share the buckets of a language in the first step of ranking.
SHARES = 16
#: Ends of pieces, and words; fixed values of the contract.
TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
STOPS = frozenset(b".,;:!?\x0a\x0b\x0c\x0d")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Words:
    """Numbers of words, with their hashes; 0 stands for the end of a piece."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1 << 10, np.uint64)

    def add(self, tokens: Iterable[bytes]) -> None:
        """Number those of tokens that have no number yet."""
        numbers, words = self.numbers, self.words
        for token in tokens:
            if not token or token[0] in STOPS:
                numbers[token] = 0
                continue
            numbers[token] = len(words)
            if len(words) == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[len(words)] = xxhash.xxh64_intdigest(token)
            words.append(token)

    def of(self, tokens: list[bytes]) -> np.ndarray:
        self.add(set(tokens).difference(self.numbers))
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))

    def pack(self, numbers: np.ndarray) -> tuple[bytes, bytes]:
        """Different words of a row of numbers, and their places among these, 0 for an end."""
        own, places = np.unique(np.append(numbers, 0), return_inverse=True)
        return b" ".join([self.words[i] for i in own.tolist()]), places[:-1].astype("<u4").tobytes()

    def unpack(self, words: bytes, places: bytes) -> np.ndarray:
        return self.of(words.split(b" "))[np.frombuffer(places, "<u4")]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Finish of a 64-bit hash: every bit depends on all."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (hashes >> np.uint64(32))


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))


def buckets(hashes: np.ndarray, k: int, lang: str, n: int) -> np.ndarray:
    """The bucket of each k words in a row, given hashes of words."""
    total = np.full(max(0, len(hashes) - k + 1), lang_hash(lang))
    for i in range(k):
        total += mixed(hashes[i : len(hashes) - k + 1 + i] * MULTIPLIERS[i])
    return (mixed(total) % np.uint64(n)).astype(np.int64)


def whole(numbers: np.ndarray, k: int) -> np.ndarray:
    """Whether k words in a row, from each place, have no end of a piece among them."""
    last = max(0, len(numbers) - k + 1)
    out = np.ones(last, bool)
    for i in range(k):
        out &= numbers[i : last + i] > 0
    return out


def bits(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0


def pieces(texts: list[str | None], stop: bytes = b"\n") -> list[bytes]:
    """Words of texts and marks where a piece ends."""
    return TOKEN.findall(stop.join((t or "").encode().lower() for t in texts) + stop)


class Pass:
    """One task's share of a pass: exact counts of phrases of k words, counters of the next."""

    def __init__(self, k: int, least: int, n_buckets: int, last: bool, maps: list[np.ndarray]):
        self.k, self.least, self.n, self.maps = k, least, n_buckets, maps
        self.counts: dict[str, Counter] = {}
        self.held = 0
        self.words = Words()
        kind = np.uint8 if least < 128 else np.uint32
        self.counters = None if last else np.zeros(n_buckets, kind)

    def add(self, lang: str, numbers: np.ndarray) -> None:
        """Count words of a language, by their numbers."""
        hashes = self.words.hashes[numbers]
        # Where k words may be a frequent phrase: by bits of their parts and of their bucket.
        may = whole(numbers, 1)
        for j in range(2, self.k + 1):
            place = buckets(hashes, j, lang, self.n)
            if j == 2:  # bits of words themselves
                may &= bits(self.maps[0], buckets(hashes, 1, lang, self.n))
            may = may[:-1] & may[1:]
            may &= bits(self.maps[j - 1], place)
        self.count(lang, numbers, np.flatnonzero(may))
        if self.counters is not None:
            after = whole(numbers, self.k + 1)
            if self.k > 1:  # parts of the next length
                after &= may[:-1] & may[1:]
            place = buckets(hashes, self.k + 1, lang, self.n)[after]
            place, hits = np.unique(place, return_counts=True)
            total = self.counters[place] + np.minimum(hits, self.least)
            self.counters[place] = np.minimum(total, self.least).astype(self.counters.dtype)

    def count(self, lang: str, numbers: np.ndarray, places: np.ndarray) -> None:
        """Add phrases of k words from each place, those alike once."""
        if not len(places):
            return
        key, first = numbers[places], places
        for i in range(1, self.k):  # a phrase's number is made of its first words' and the last's
            _, key = np.unique(key, return_inverse=True)
            key = key * len(self.words.words) + numbers[places + i]
        _, first, hits = np.unique(key, return_index=True, return_counts=True)
        own = self.counts.setdefault(lang, Counter())
        before = len(own)
        words, k = self.words.words, self.k
        starts = places[first]
        columns = [numbers[starts + i].tolist() for i in range(k)]
        for row, n in zip(zip(*columns, strict=True), hits.tolist(), strict=True):
            own[b" ".join([words[i] for i in row])] += n
        self.held += len(own) - before

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Counts held, and forget them."""
        for lang, own in self.counts.items():
            yield out_batch(lang=[lang] * len(own), phrase=[w.decode() for w in own], n=list(own.values()))
        self.counts, self.held = {}, 0
        if len(self.words.words) > NUMBERED:
            self.words = Words()

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """Counters in blocks, those without a hit left out."""
        for block in range(0 if self.counters is None else -(-self.n // BLOCK)):
            part = self.counters[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield out_batch(place=[block], block=[pa.compress(part, "zstd", asbytes=True)])


#: What a pass writes: counts, blocks of counters and, in the first, texts as numbers of words.
PASSED = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64()}
PASSED |= {"place": pa.int64(), "block": pa.binary(), "words": pa.binary(), "places": pa.binary()}
PASSED_SCHEMA = "lang string, phrase string, n bigint, place bigint, block binary, words binary, places binary"


def out_batch(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), t) for c, t in PASSED.items()], list(PASSED)
    )


def passed(
    rows: DataFrame, k: int, least: int, n_buckets: int, last: bool, maps: Broadcast | None
) -> tuple[DataFrame, str]:
    """What tasks find in pass k, written, and where: over texts (lang, text) in the first, then over the
    numbers of words (lang, words, places) that it wrote."""
    small_batches(rows.sparkSession)

    def texts(own: Pass, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, some in by_lang.items():
            numbers = own.words.of(pieces(some))
            own.add(lang, numbers)
            words, places = own.words.pack(numbers)
            yield out_batch(lang=[lang], words=[words], places=[places])

    def packed(own: Pass, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lang, *row in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "places")), strict=True):
            own.add(lang, own.words.unpack(*row))
            if own.held >= HELD:
                yield from own.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pass(k, least, n_buckets, last, maps.value if maps else [])
        for batch in batches:
            yield from (texts if k == 1 else packed)(own, batch)
            if own.held >= HELD or len(own.words.words) > NUMBERED:
                yield from own.rows()
        yield from own.rows()
        yield from own.blocks()

    path = scratch_path(rows.sparkSession, f"collocations-pass-{k}")
    rows = rows.coalesce(WAVES * rows.sparkSession.sparkContext.defaultParallelism)
    rows.mapInArrow(run, PASSED_SCHEMA).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(PASSED_SCHEMA).parquet(path), path


def folded(blocks: DataFrame, counters: bool, least: int, n_buckets: int) -> DataFrame:
    """(place, block): blocks of one place as one, counters as bits of those that reach ``least``,
    or bits united. A task holds those places alone that are its own."""
    kind = np.uint8 if least < 128 or not counters else np.uint32
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, block in zip(batch.column("place").to_pylist(), batch.column("block"), strict=True):
                size = min(BLOCK, n_buckets - place * BLOCK) * width if counters else -(-BLOCK // 8)
                part = np.frombuffer(pa.decompress(block.as_buffer(), size, "zstd"), kind)
                if place not in own:
                    own[place] = part.copy()
                elif counters:
                    own[place] = np.minimum(own[place] + part, least).astype(kind)
                else:
                    own[place] |= part
        for place, part in own.items():
            data = np.packbits(part >= least, bitorder="little") if counters else part
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["place", "block"]
            )

    return blocks.repartition("place").mapInArrow(run, "place bigint, block binary")


def bitmap(blocks: DataFrame, n_buckets: int) -> np.ndarray:
    """Blocks of bits as one bitmap on the driver, of n_buckets bits whatever the data."""
    out = np.zeros(-(-n_buckets // BLOCK) * BLOCK // 8, np.uint8)
    for place, block in blocks.collect():
        part = np.frombuffer(bytes(block), np.uint8)
        out[place * BLOCK // 8 : place * BLOCK // 8 + len(part)] = part
    return out


def marked(frequent: DataFrame, k: int, n_buckets: int) -> DataFrame:
    """Blocks of bits at the buckets of phrases (lang, phrase) of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, phrase in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")), strict=True):
                by_lang.setdefault(lang, []).append(phrase)
            for lang, phrases in by_lang.items():
                words = [w.encode() for p in phrases for w in p.split(" ")]
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                places = buckets(hashes, k, lang, n_buckets)[::k]
                for place in places.tolist():
                    block = own.setdefault(place // BLOCK, np.zeros(-(-BLOCK // 8), np.uint8))
                    block[place % BLOCK >> 3] |= 1 << (place & 7)
        for place, part in own.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int64()), pa.array([pa.compress(part, "zstd", asbytes=True)], pa.binary())], ["place", "block"]
            )

    return frequent.select("lang", "phrase").mapInArrow(run, "place bigint, block binary")


def buckets_for(docs: DataFrame, most: int) -> int:
    """A bucket for every BUCKET_BYTES of all texts, ``most`` at most."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(most, max(8, size // BUCKET_BYTES))


def counted(docs: DataFrame, least: int, longest: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, k, phrase, n) of 1 to ``longest`` words; words of each lang (lang, total)."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    n_buckets = buckets_for(docs, most)
    maps: list[np.ndarray] = []
    shared, totals, found, rows, paths = None, None, [], docs, []
    for k in range(1, longest + 1):
        made, path = passed(rows, k, least, n_buckets, k == longest, shared)
        paths.append(path)
        if shared:
            shared.destroy()
        sums = made.where("phrase is not null")
        if k == 1:
            rows = made.where("words is not null").select("lang", "words", "places")
            totals = written(sums.groupBy("lang").agg(F.sum("n").alias("total")), "collocations-totals")
        own = sums.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        own = written(own, f"collocations-frequent-{k}")
        found.append(own.withColumn("k", F.lit(k)))
        if k < longest:
            # maps[k - 1]: frequent phrases of k words; maps[k]: buckets of the next length.
            blocks = made.where("block is not null").select("place", "block")
            maps[k - 1 :] = [
                bitmap(folded(marked(own, k, n_buckets), False, 1, n_buckets), n_buckets),
                bitmap(folded(blocks, True, least, n_buckets), n_buckets),
            ]
            shared = context.broadcast(maps)
        if k > 1:
            remove(docs.sparkSession, paths.pop())
    remove(docs.sparkSession, paths.pop())
    out = found[0]
    for own in found[1:]:
        out = out.unionByName(own)
    return out, totals


def parts(phrase: str, first: str, last: str) -> str:
    """SQL for words first to last of a phrase."""
    return f"array_join(slice(split({phrase}, ' '), {first}, {last} - {first} + 1), ' ')"


def scored(frequent: DataFrame, cover: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates that no longer one replaces."""
    own = frequent.where("k > 1").selectExpr("lang", "phrase", "k", "n as a")
    side = frequent.selectExpr("lang as part_lang", "phrase as part", "n as part_n")

    def times(cuts: DataFrame, part: str, name: str) -> DataFrame:
        met = cuts.join(side, (F.col("lang") == F.col("part_lang")) & (F.col(part) == F.col("part")))
        return met.withColumnRenamed("part_n", name).drop("part_lang", "part", part)

    cuts = own.selectExpr("*", "explode(sequence(1, k - 1)) as cut").selectExpr(
        "lang", "phrase", "a", "cut", f"{parts('phrase', '1', 'cut')} as head", f"{parts('phrase', 'cut + 1', 'k')} as tail"
    )
    cuts = times(times(cuts, "head", "l"), "tail", "r")
    score = f"cast({SCALE} * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + r) as bigint)"
    lowest = (
        cuts.selectExpr("lang", "phrase", "a", f"struct({score} as score, cut, l, r) as way")
        .groupBy("lang", "phrase", "a")
        .agg(F.min("way").alias("way"))
    )
    # Places of the longer candidates that hold a phrase, the most of one.
    within = own.where("k > 2").selectExpr("lang", "phrase", "k", "a", "explode(sequence(2, k - 1)) as size")
    within = within.selectExpr("*", "explode(sequence(1, k - size + 1)) as at")
    within = within.selectExpr("lang as in_lang", f"{parts('phrase', 'at', 'at + size - 1')} as within", "a as longer")
    within = within.groupBy("in_lang", "within").agg(F.max("longer").alias("longer"))
    met = lowest.join(
        within, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("within")), "left"
    )
    covered = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(cover).cast("decimal(20,0)") * F.col("a")
    return met.where(F.col("longer").isNull() | ~covered).select("lang", "phrase", "a", "way.l", "way.r", "way.score")


def collocations(
    docs: DataFrame,
    least: int = MIN_COUNT,
    longest: int = LONGEST,
    first: int = FIRST,
    cover: int = COVER,
    most_buckets: int = BUCKETS,
) -> DataFrame:
    """Each language's first collocations of ``docs`` (lang, text): lang, rank, phrase, a (its
    places), l and r (those of its two parts at the cut), n (words of the language), score.

    ``longest`` is 2 to 4.
    """
    frequent, totals = counted(docs, least, longest, most_buckets)
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = scored(frequent, cover).withColumn("share", share)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order)))
    some = some.where(F.col("rank") <= first).drop("share", "rank")
    # At most SHARES * first rows a language.
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= first)
    return ranked.join(totals.withColumnRenamed("lang", "own"), F.col("lang") == F.col("own")).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations, over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM w, unnest([1, 2, 3, 4]) AS s(k), unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT c.lang, c.phrase, c.a, c.k, cut, l.f AS l, r.f AS r,
    CAST(2000000 AS HUGEINT) * c.a // (l.f + r.f) AS score
  FROM c, unnest(generate_series(1, c.k - 1)) AS s(cut)
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest([2, 3]) AS s(j), unnest(generate_series(1, c.k - j + 1)) AS t(i) WHERE j < k GROUP BY ALL),
z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank
  FROM y LEFT JOIN b ON b.lang = y.lang AND b.phrase = y.phrase
  WHERE b.longer IS NULL OR 100 * b.longer < 80 * y.a)
SELECT z.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
