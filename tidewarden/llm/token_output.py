"""Token ids as binary shards with Elias-Fano encoded document boundaries.

Documents are dealt to partitions by ranges of doc_id and sorted there, or stay in the order
they have (``keep_order``, without a shuffle); each partition encodes its texts and writes
shard files, so shards in the manifest's order hold all documents in that order. A shard is
one file:

    magic, counts and section lengths     HEADER, little-endian 64-bit integers
    document ids                          Elias-Fano if sorted, else packed in equal widths
    document boundaries                   Elias-Fano: low bits, high bits, select samples
    token ids                             concatenated, 16 bits each if the vocabulary fits

Boundary i is the end of document i in the id array. Elias-Fano keeps n numbers below u in
about n * (2 + log2(u / n)) bits; ``select`` finds number i from the sample before it and
a few words of the high bits, and ``run`` a run of numbers in the same way, so a reader
never builds a table of 64-bit offsets.

Files are written under a name of the attempt and moved into place, and a manifest names
those of the attempts that counted, so lost executors and repeated tasks leave no wrong
shard behind. A partition beyond ``SHARD_IDS`` or ``SHARD_DOCS`` rolls over to another shard.

Encoding: byte-level BPE never merges across pre-tokens, so ids of a text are the ids of
its pre-tokens in a row. Each worker remembers the ids of pre-tokens it has met of late, and
the tokenizers library's model encodes the others; other kinds of tokenizer encode whole
texts, and so are texts with an added token's string (such as ``<|endoftext|>``, one id) or
with characters too new for all parties to agree on their class.

Defined cases: null text is empty and has the end id alone; a null doc_id comes first;
repeated doc_ids stay, in order of a hash of their texts, and one id with any share of the
rows spreads over many partitions; an empty table writes no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewarden.llm.shared import scratch_path, small_batches, written

END_ID = 0
#: A shard is closed when it holds so many ids, or documents.
SHARD_IDS = 64 << 20
SHARD_DOCS = 1 << 20
#: Ids that a reader holds at once, but for a longer document.
READ_IDS = 4 << 20
#: Documents whose boundaries a reader holds at once.
READ_DOCS = 1 << 16
#: Pre-tokens whose ids a worker remembers, in two generations; none of more characters.
CACHE_WORDS = 500_000
CACHED_CHARS = 64
#: One of so many select samples.
SAMPLE = 256
MAGIC = int.from_bytes(b"TWSHARD2", "little")
HEADER = struct.Struct("<15q")
#: Pre-token pattern of byte-level BPE vocabularies, a fixed value.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of ASCII, accented Latin letters and common marks, which hold no other numbers and
#: no other white space, and the same pattern for these in plain classes: twice as fast.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
MARKS = "\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027"
LATIN = re.compile(f"[\0-\x7f{LETTERS}{MARKS}]*+")
LATIN_WORDS = re.compile(
    rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+", re.ASCII
)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of numbers, one after another, as bytes."""
    places = np.arange(bits, dtype=np.uint64)
    parts = [np.zeros(0, np.uint8)]
    for at in range(0, len(values) if bits else 0, 1 << 16):
        some = values[at : at + (1 << 16), None]
        parts.append(
            np.packbits(((some >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        )
    return np.concatenate(parts)


def unpack(data: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """Numbers first up to last of those that ``pack`` packed."""
    if not bits:
        return np.zeros(last - first, np.int64)
    a, b = first * bits, last * bits
    found = np.unpackbits(data[a // 8 : -(-b // 8)], bitorder="little")
    found = found[a % 8 : a % 8 + b - a].reshape(-1, bits).astype(np.int64)
    return found @ (1 << np.arange(bits, dtype=np.int64))


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        # High parts in unary: number i sets bit (high part + i).
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        high[ones] = 1
        high = np.packbits(high, bitorder="little").view("<u8")
        return cls(n, bits, pack(values, bits), high, ones[::SAMPLE].astype("<u8"))

    def _one(self, i: int) -> int:
        """Place of one bit i of the high bits, from the nearest sample before it."""
        at = int(self.samples[i // SAMPLE])
        rest = i % SAMPLE
        word = at // 64
        left = int(self.high[word]) >> (at % 64) << (at % 64)
        while (ones := left.bit_count()) <= rest:
            rest -= ones
            word += 1
            left = int(self.high[word])
        for _ in range(rest):
            left &= left - 1
        return word * 64 + (left & -left).bit_length() - 1

    def select(self, i: int) -> int:
        """Number i."""
        return (self._one(i) - i) << self.low_bits | int(unpack(self.low, self.low_bits, i, i + 1)[0])

    def run(self, first: int, last: int) -> np.ndarray:
        """Numbers first up to last: the words of the high bits between their two places."""
        if first >= last:
            return np.zeros(0, np.int64)
        a, b = self._one(first), self._one(last - 1)
        start = a // 64 * 64
        bits = np.unpackbits(self.high[a // 64 : b // 64 + 1].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits[a - start : b - start + 1]) + a
        return (ones - np.arange(first, last)) << self.low_bits | unpack(self.low, self.low_bits, first, last)

    def sections(self) -> list[bytes]:
        return [padded(x.tobytes()) for x in (self.low, self.high, self.samples)]


class Packed(EliasFano):
    """Numbers in any order, in equal widths."""

    @classmethod
    def of(cls, values: np.ndarray) -> Packed:
        bits = int(values.max()).bit_length() if len(values) else 0
        none = np.zeros(0, "<u8")
        return cls(len(values), bits, pack(values.astype(np.uint64), bits), none, none)

    def select(self, i: int) -> int:
        return int(self.run(i, i + 1)[0])

    def run(self, first: int, last: int) -> np.ndarray:
        return unpack(self.low, self.low_bits, first, last)


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, width: int) -> bytes:
    """All of a shard up to its token ids."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    base = int(known.min()) if len(known) else 0
    # Differences of 64-bit numbers fit 64 bits without a sign.
    above = known.view(np.uint64) - np.int64(base).view(np.uint64)
    ordered = doc_ids[:nulls] == [None] * nulls and bool((above[1:] >= above[:-1]).all())
    if ordered:
        ids = EliasFano.of(above)
    else:
        places = np.zeros(len(doc_ids), np.uint64)
        places[[x is not None for x in doc_ids]] = above + np.uint64(1)  # 0 is null
        ids = Packed.of(places)
    bounds = EliasFano.of(ends)
    a, b = ids.sections(), bounds.sections()
    header = HEADER.pack(
        MAGIC, len(doc_ids), nulls, int(ends[-1]) if len(ends) else 0, width, base, ordered,
        ids.low_bits, *map(len, a), bounds.low_bits, *map(len, b),
    )
    return b"".join([header, *a, *b])


class Shard:
    """A shard file opened for reading: ids and boundaries of documents on demand."""

    def __init__(self, path: str):
        fs, inner = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        head = HEADER.unpack(self.file.read(HEADER.size))
        if head[0] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.n_docs, self.nulls, self.n_ids, self.width, self.base, self.ordered = head[1:7]
        if self.ordered:
            self.docs = self._sequence(EliasFano, self.n_docs - self.nulls, head[7:11])
        else:
            self.docs = self._sequence(Packed, self.n_docs, head[7:11])
        self.ends = self._sequence(EliasFano, self.n_docs, head[11:15])
        self.start = self.file.tell()

    def _sequence(self, kind: type[EliasFano], n: int, head: tuple[int, ...]) -> EliasFano:
        low, high, samples = (np.frombuffer(self.file.read(size), "u1") for size in head[1:])
        return kind(n, head[0], low, high.view("<u8"), samples.view("<u8"))

    def doc_ids(self, first: int = 0, last: int | None = None) -> list[int | None]:
        last = self.n_docs if last is None else last
        if not self.ordered:
            return [x + self.base - 1 if x else None for x in self.docs.run(first, last).tolist()]
        own = self.docs.run(max(first - self.nulls, 0), max(last - self.nulls, 0))
        return [None] * (last - first - len(own)) + (own + self.base).tolist()

    def read(self, first: int, last: int) -> np.ndarray:
        """Token ids first up to last of the shard."""
        data = self.file.read_at((last - first) * self.width, self.start + first * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def end(self, i: int) -> int:
        """Where document i ends in the id array; 0 for the one before the first."""
        return self.ends.select(i) if i >= 0 else 0

    def document(self, i: int) -> np.ndarray:
        """Token ids of document i, its end id included."""
        return self.read(self.end(i - 1), self.end(i))


def unsettled(text: str) -> bool:
    """Whether a text has a character that this Python's Unicode tables lack: there the pattern
    and the tokenizers library, with tables of other versions, may part words differently."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


def byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write bytes as: printable ones of Latin-1 stand for
    themselves, the others follow from 256 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Words(dict):
    """Ids of pre-tokens, as bytes; those met in the last two generations are remembered."""

    def __init__(self, tokenizer: Tokenizer, dtype: str):
        super().__init__()
        self.model, self.dtype = tokenizer.model, dtype
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(shown)], self.dtype).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Texts to little-endian ids, by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_words = (
            spec["model"]["type"] == "BPE"
            and not any(spec.get(x) for x in ("normalizer", "truncation", "padding"))
            and not spec["model"].get("dropout")
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
        )
        #: Strings that the library finds before it parts words; the pattern knows none of them.
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.words = Words(self.tokenizer, self.dtype)
        self.pattern = regex.compile(BYTE_LEVEL)

    def encode(self, text: str) -> bytes:
        found = self._by_words(text) if self.by_words else None
        if found is None:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(ids, self.dtype).tobytes()
        return found

    def _by_words(self, text: str) -> bytes | None:
        """Ids by pre-tokens; None for a text that has to be encoded whole."""
        if any(t in text for t in self.added):
            return None
        latin = LATIN.fullmatch(text)
        if not latin and unsettled(text):
            return None
        pattern, ids_of = LATIN_WORDS if latin else self.pattern, self.words.__getitem__
        if len(text) < 1 << 22:
            return b"".join(map(ids_of, pattern.findall(text)))
        found = (m[0] for m in pattern.finditer(text))
        parts = []
        while words := list(islice(found, 1 << 20)):
            parts.append(b"".join(map(ids_of, words)))
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file; it outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_shards(docs: DataFrame, tokenizer: str, path: str, keep_order: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``path``; their manifest, in order.

    ``tokenizer`` is the place of a tokenizer file on every machine. Documents are written in
    order of doc_id, or with ``keep_order`` in the order of ``docs``: of its files by path and
    their rows if it is read from files, else of its partitions. The manifest has a row for
    each shard: origin and first (its place in the order), file, n_docs, n_ids, start (ids
    of all shards before it).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = kept_order(docs) if keep_order else id_order(docs)
    most_ids, most_docs = SHARD_IDS, SHARD_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        end = np.array([END_ID], encoder.dtype).tobytes()
        fs, inner = pafs.FileSystem.from_uri(path)
        own = f"{TaskContext.get().partitionId():08d}"
        origin, first, at = own, 0, 0  # of the open shard, and the next row's place
        doc_ids: list[int | None] = []
        ends: list[int] = []
        data: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            name = f"shard-{own}-{uuid.uuid4().hex}.bin"
            fs.create_dir(inner, recursive=True)
            with fs.open_output_stream(f"{inner}/.{name}") as out:
                out.write(shard_bytes(doc_ids, np.array(ends, np.uint64), encoder.width))
                for ids in data:
                    out.write(ids)
            fs.move(f"{inner}/.{name}", f"{inner}/{name}")
            row = [[origin], [first], [f"{path}/{name}"], [len(doc_ids)], [total]]
            doc_ids.clear(), ends.clear(), data.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, MANIFEST_ARROW, strict=True)], MANIFEST_NAMES
            )

        for batch in batches:
            for doc_id, text, source, place in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text", "origin", "place")), strict=True
            ):
                if source is not None and (source != origin or place != at):  # another part of files
                    if doc_ids:
                        yield close()
                    total, origin, first, at = 0, source, place, place
                ids = encoder.encode(text or "") + end
                total += len(ids) // encoder.width
                at += 1
                doc_ids.append(doc_id)
                ends.append(total)
                data.append(ids)
                if total >= most_ids or len(doc_ids) >= most_docs:
                    yield close()
                    total, first = 0, at
        if doc_ids:
            yield close()

    manifest = written(rows.mapInArrow(run, MANIFEST_SCHEMA), "token-manifest")
    # Ids before a shard: those of its own origin, and those of the origins before, of which
    # there are as many as files or partitions.
    before = W.unboundedPreceding, -1
    origins = manifest.groupBy("origin").agg(F.sum("n_ids").alias("ids"))
    origins = origins.select(
        F.col("origin").alias("source"),
        F.coalesce(F.sum("ids").over(W.orderBy("origin").rowsBetween(*before)), F.lit(0)).alias("base"),
    )
    own = F.sum("n_ids").over(W.partitionBy("origin").orderBy("first").rowsBetween(*before))
    return manifest.join(origins, F.col("origin") == F.col("source")).select(
        *MANIFEST_NAMES, (F.col("base") + F.coalesce(own, F.lit(0))).alias("start")
    )


NO_PLACE = "cast(null as string) as origin", "cast(null as bigint) as place"


def id_order(docs: DataFrame) -> DataFrame:
    """Rows in order of doc_id; those of one id by a hash of their texts, and rows alike in
    any order, so that no id is too large for a partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    return (
        docs.select(F.col("doc_id").cast("bigint"), "text", tie.alias("tie"))
        .repartitionByRange(parts, "doc_id", "tie", F.monotonically_increasing_id())
        .sortWithinPartitions("doc_id", "tie", "text")
        .selectExpr("doc_id", "text", *NO_PLACE)
    )


def kept_order(docs: DataFrame) -> DataFrame:
    """Rows where they lie, with their file and row number if they are read from files; files
    by the number of their part, which has six digits and more, then by path."""
    own = "cast(doc_id as bigint) as doc_id", "text"
    part = r"lpad(regexp_extract(_metadata.file_path, 'part-(\d+)[^/]*$', 1), 20, '0')"
    origin = f"concat({part.replace(chr(92), chr(92) * 2)}, ' ', _metadata.file_path) as origin"
    try:
        return docs.selectExpr(*own, origin, "_metadata.row_index as place")
    except AnalysisException:  # no files
        return docs.selectExpr(*own, *NO_PLACE)


MANIFEST_NAMES = ["origin", "first", "file", "n_docs", "n_ids"]
MANIFEST_ARROW = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
MANIFEST_SCHEMA = "origin string, first bigint, file string, n_docs bigint, n_ids bigint"
READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""

    def rows(file: str, start: int) -> Iterator[pa.RecordBatch]:
        shard = Shard(file)
        for low in range(0, shard.n_docs, READ_DOCS):
            high = min(low + READ_DOCS, shard.n_docs)
            bounds = np.concatenate([[shard.end(low - 1)], shard.ends.run(low, high)])
            doc_ids = shard.doc_ids(low, high)
            first = 0
            while first < len(doc_ids):
                last = int(np.searchsorted(bounds, bounds[first] + READ_IDS, "right")) - 1
                last = min(max(last, first + 1), len(doc_ids))
                own = bounds[first : last + 1]
                ids = shard.read(int(own[0]), int(own[-1])).astype("<u4")
                cuts = (own - own[0]).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[first:last], pa.int64()),
                        pa.array(own[:-1] + start),
                        pa.array(np.diff(own)),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows(row["file"], row["start"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(parts).mapInArrow(run, READ_SCHEMA)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and their checksum, read back from shards."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "token-shards")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), path))


def brute_force(
    rows: list[tuple[int | None, str | None]], tokenizer: str, keep_order: bool = False
) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) with whole texts encoded one by one."""
    own = Tokenizer.from_file(tokenizer)

    def place(row: tuple[int | None, str | None]) -> tuple:
        tie = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0] is not None, row[0] or 0, tie - (tie >> 63 << 64), row[1] or ""

    out, start = [], 0
    for doc_id, text in rows if keep_order else sorted(rows, key=place):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, END_ID]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
