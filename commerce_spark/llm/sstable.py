"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key. Its sections, each closed by one line feed, are:

  data blocks   zstd frames of entries: varints shared, unshared, length; the key's unshared bytes; the value. A key
                shares a prefix with the key before it; every RESTART-th entry starts afresh.
  index         for each block: last key (length byte, bytes), offset, length, entries (little-endian, 64, 32, 32 bits)
  Bloom filter  number of probes (1 byte), then the bits
  footer        FOOTER bytes: magic, shard, entries, ids, bytes an id, offsets and lengths of index and filter

A key is the doc_id in 8 big-endian bytes with its sign bit turned, so that byte order is number order; a missing
doc_id is the empty key and comes first. A value is the ids, little-endian. Sections are rows of a text sink,
so shards are written by Spark's own committer to any file system that it knows, and a lost executor's
attempt leaves nothing behind.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Grown, Names, batch_rows, chunks_of, cut, hashes, pieces, ranges, shared_dir, text_bytes

MAGIC = b"SSTOKEN1"
_FOOTER = struct.Struct("<8sqqqiqqqq")
FOOTER = _FOOTER.size
RESTART = 16
PROBES = 7


# The UTF-8 forms of white space beyond ASCII, of two and of three bytes, as numbers.
_SPACES_2 = np.array([0xC285, 0xC2A0])
_SPACES_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def spaces(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text is part of white space (or an ASCII control sign)."""
    out = data <= 32
    two = np.flatnonzero(data == 0xC2)
    two = two[np.isin(0xC200 + data[two + 1].astype(np.int64), _SPACES_2)]
    three = np.flatnonzero((data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    three = three[np.isin((data[three].astype(np.int64) << 16) + (data[three + 1].astype(np.int64) << 8) + data[three + 2], _SPACES_3)]
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            out[at + k] = True
    return out


# ASCII signs by class: letters 1, digits 2, others 3 but for white space, control signs and the apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 0


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of UTF-8 text before which byte-level pre-tokenisation always cuts: blanks that have other signs than white
    space on both sides; and, besides, line feeds of that kind, what follows them, and changes between letters (ASCII and
    U+00C0 to U+00FF), digits and other ASCII signs. Apostrophes, which start contractions, are never next to the latter."""
    space = spaces(data)
    alone = np.zeros(len(data), bool)
    alone[1:-1] = ~space[:-2] & ~space[2:]
    blank = (data == 32) & alone
    kind = _CLASS[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
    kind[second] = kind[second - 1] = 1
    fine = np.zeros(len(data), bool)
    fine[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    feed = (data == 10) & alone
    fine |= feed
    fine[1:] |= feed[:-1]
    return blank, fine


class Encoder:
    """A tokenizers file with a bounded cache of chunks.

    Texts are cut where the library's pre-tokenisation always cuts (see `cuts`; texts that may hold the name of a special
    token only at blanks), and the library encodes each new chunk once: many in one call, with line feeds between them, as
    what it makes of them then falls apart at their ends again. A chunk's ids are a range of one array, so a batch of texts
    is put together as arrays. Chunks of over LONG bytes aren't kept; `room` bounds the others, beyond what one batch adds.
    """

    LONG = 200

    def __init__(self, path: str, room: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        size = self.tool.get_vocab_size(with_added_tokens=True)
        self.wide = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.length = np.array([len(self.tool.id_to_token(i) or "") for i in range(size)], np.int64)  # one sign a byte
        self.room = room
        self._clear()

    def _clear(self) -> None:
        self.known, self.start, self.many, self.pool = Names(), Grown(np.int64), Grown(np.int32), Grown(self.wide)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tool.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that hold those of each chunk, where each one's start, and how many they are."""
        data, at = text_bytes(new)
        space = spaces(data)
        first, last, full = data[np.minimum(at[:-1], len(data) - 1)], at[1:] - 1, np.diff(at) > 0
        inner = at[:-1] + (first == 32)  # a chunk may start with one blank, but not with other white space, nor end with any
        apart = ~full | (inner > last) | space[np.minimum(inner, len(data) - 1)] | space[last] | pc.match_substring(new, "<|").to_numpy(zero_copy_only=False)
        many, start, parts, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
        alone = np.flatnonzero(apart)
        for i, text in zip(alone.tolist(), new.take(pa.array(alone)).to_pylist(), strict=True):
            parts.append(self._library(text))
            start[i], many[i] = held, len(parts[-1])
            held += len(parts[-1])
        run = np.flatnonzero(~apart)
        data, at = text_bytes(new.take(pa.array(run)))
        joined, at = np.full(len(data) + len(run), 10, np.uint8), at + np.arange(len(at))  # each with a line feed behind it
        body = np.ones(len(joined), bool)
        body[at[1:] - 1] = False
        joined[body] = data
        begin = 0
        while begin < len(run):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + (1 << 14))) - 1)
            ids = self._library(joined[at[begin] : at[end]].tobytes().decode())
            ends = np.searchsorted(np.cumsum(self.length[ids]), at[begin + 1 : end + 1] - at[begin], side="left") + 1
            start[run[begin:end]] = held + np.concatenate(([0], ends[:-1]))
            many[run[begin:end]] = np.diff(ends, prepend=0) - 1
            parts.append(ids)
            held += len(ids)
            begin = end
        return np.concatenate(parts).astype(self.wide), start, many

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's; a null text has none."""
        if len(self.known) > self.room:
            self._clear()
        data, offsets = text_bytes(texts)
        cut, fine = cuts(data)
        for i in np.flatnonzero(pc.match_substring(pc.fill_null(texts, ""), "<|").to_numpy(zero_copy_only=False)).tolist():
            fine[offsets[i] : offsets[i + 1]] = False
        cut |= fine
        keys, counts = chunks_of(data, offsets, cut, keep=True)
        coded = keys.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary
        octets, at = text_bytes(names)
        h = hashes(names)
        place = self.known.find(octets, at, h)
        long = np.diff(at) > self.LONG
        kept = None
        for kind in (False, True):  # long ones come behind all others, and are forgotten at the end
            missing = np.flatnonzero((place < 0) & (long == kind))
            if not len(missing):
                continue
            new = names.take(pa.array(missing))
            ids, start, many = self._learn(new)
            if kind:
                kept = self.start.n, self.many.n, self.pool.n
                place[missing] = self.start.n + np.arange(len(missing))
            else:
                place[missing] = self.known.add(*text_bytes(new), h[missing])
            self.start.add(self.pool.n + start)
            self.many.add(many)
            self.pool.add(ids)
        chosen = place[index]
        many = self.many.a[chosen].astype(np.int64)
        out = self.pool.a[ranges(self.start.a[chosen], many)]
        if kept:
            self.start.n, self.many.n, self.pool.n = kept
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(counts)))]
        return out, np.diff(ends)


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & ((1 << 64) - 1) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Turns entries in key order into the sections of one shard."""

    def __init__(self, shard: int, wide: int, block_bytes: int = 1 << 16):
        self.shard, self.wide, self.block_bytes = shard, wide, block_bytes
        self.at = self.entries = self.ids = 0
        self.index, self.keys = [], []
        self.pack = zstandard.ZstdCompressor(level=1)
        self._clear()

    def _clear(self) -> None:
        self.block, self.size, self.n, self.last = [], 0, 0, b""

    def add(self, key: bytes, value: bytes) -> list[bytes]:
        """Takes an entry; returns the sections that it completes."""
        shared = 0
        if self.n % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [head, value]
        self.size += len(head) + len(value)
        self.n, self.last = self.n + 1, key
        self.entries, self.ids = self.entries + 1, self.ids + len(value) // self.wide
        self.keys.append(key)
        return [self._flush()] if self.size >= self.block_bytes else []

    def _flush(self) -> bytes:
        data = self.pack.compress(b"".join(self.block))
        self.index.append((self.last, self.at, len(data), self.n))
        self.at += len(data) + 1
        self._clear()
        return data

    def close(self) -> list[bytes]:
        out = [self._flush()] if self.n else []
        index = b"".join(bytes([len(k)]) + k + struct.pack("<qii", at, size, n) for k, at, size, n in self.index)
        bits = max(64, -(-len(self.keys) * 10 // 64) * 64)
        field = np.zeros(bits, np.uint8)
        field[[p for k in self.keys for p in _probes(k, bits)]] = 1
        bloom = bytes([PROBES]) + np.packbits(field).tobytes()
        at = self.at + len(index) + 1
        footer = _FOOTER.pack(MAGIC, self.shard, self.entries, self.ids, self.wide, self.at, len(index), at, len(bloom))
        return [*out, index, bloom, footer]


class Reader:
    """One shard, from anything with seek and read. A look-up reads footer, index and filter once, then one block."""

    def __init__(self, file, size: int):
        self.file = file
        magic, self.shard, self.entries, self.ids, wide, index_at, index_size, bloom_at, bloom_size = _FOOTER.unpack(self._read(size - FOOTER - 1, FOOTER))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.kind = np.dtype(f"<u{wide}")
        raw, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(raw):
            n = raw[at]
            self.index.append((raw[at + 1 : at + 1 + n], *struct.unpack_from("<qii", raw, at + 1 + n)))
            at += 1 + n + 16
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom_at + 1, bloom_size - 1), np.uint8))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, size, _ = self.index[block]
        raw = zstandard.ZstdDecompressor().decompress(self._read(offset, size))
        at, key = 0, b""
        while at < len(raw):
            head = []
            for _ in range(3):
                n = shift = 0
                while True:
                    b = raw[at]
                    at += 1
                    n |= (b & 127) << shift
                    shift += 7
                    if b < 128:
                        break
                head.append(n)
            shared, unshared, length = head
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(raw, self.kind, length // self.kind.itemsize, at)
            at += length

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.index)):
            for key, ids in self._entries(block):
                yield key_number(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, by Bloom filter, binary search of the index and one block; None if it isn't here."""
        key = key_bytes(doc_id)
        if not self.bloom[_probes(key, len(self.bloom))].all():
            return None
        block = bisect.bisect_left([i[0] for i in self.index], key)
        if block == len(self.index):
            return None
        return next((ids for k, ids in self._entries(block) if k == key), None)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: int = 24 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, with end_id after each, as shards under `path` in ascending doc_id order.

    Null and empty texts have the end id alone; rows without doc_id come first; rows that share a doc_id
    are entries of their own, in the order of their texts' hashes. An empty table gives no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(max(1, -(-total // shard_bytes)), F.asc_nulls_first("doc_id"), "salt")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "salt", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(tokenizer)
        end = np.array([end_id], tool.wide).tobytes()
        out = Writer(TaskContext.get().partitionId(), tool.wide.itemsize)
        for b in pieces(batches, "text", rows=4096, mb=4):
            done, at = [], 0
            ids, many = tool.encode(b.column(1))
            raw = ids.tobytes()
            for i, n in zip(b.column(0).to_pylist(), (many * tool.wide.itemsize).tolist(), strict=True):
                done += out.add(key_bytes(i), raw[at : at + n] + end)
                at += n
            if done:
                yield pa.record_batch([pa.array(done, pa.binary())], ["section"])
        if out.entries:
            yield pa.record_batch([pa.array(out.close(), pa.binary())], ["section"])

    ordered.mapInArrow(run, "section binary").select(F.col("section").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry under `path`, from the shards' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found, start = [], 0
                table = Reader(pa.BufferReader(b.column(0)[k].as_buffer()), len(b.column(0)[k].as_buffer()))
                for i, ids in table:
                    found.append((i, table.shard, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    with batch_rows(spark, 1):
        entries = cut(files.mapInArrow(run, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long"))
    before = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = before.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return entries.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """What `read` gives of a table that `write` made in the shared folder; the shards go afterwards."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    try:
        return read(spark, path)
    finally:
        drop(spark, path)
