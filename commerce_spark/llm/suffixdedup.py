"""Exact removal of repeated byte strings by difference-cover suffix sorting.

A string of `length` bytes that starts at two or more places is repeated; every byte that a repeated string covers goes.

Sorting all suffixes of a corpus takes many times its size on disk, so the sort is kept to places that can matter:

1. Every window of `length` bytes names an anchor by its content: of its GRAM-byte grams the one with the least hash,
   the leftmost on ties. Equal windows have equal anchors, so a window whose anchor's gram occurs once is unique. Runs of
   windows with one anchor are the unit: about two in every 137 bytes.
2. Runs whose gram occurs again are told apart by the hash of their bytes (the context). If all of a gram's
   contexts are equal, all their windows are repeated: copies and the insides of shared passages end here.
3. What is left is the edges of shared passages. The distinct contexts of a gram go to one task, as one text of bounded
   size, and are suffix-sorted by the difference cover {1, 2} mod 3: triples at sampled places are sorted
   and named, the names' suffixes are sorted by recursion, the remaining suffixes by a sign and a rank, both
   are merged, and neighbours in the order are compared over `length` bytes.
4. Grams with too many contexts for one task are counted window by window instead, by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, members, mix64, not_members, only_members, pieces, spare, text_bytes

GRAM = 64
_BYTE = mix64(np.arange(256, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(7))
_POWER = mix64(np.arange(6, dtype=U64) + U64(99)) | U64(1)  # one for each doubling up to GRAM
_PLACES = U64((1 << 24) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash for each substring of GRAM bytes, by doubling."""
    h = _BYTE[data]
    k = 1
    for factor in _POWER:
        more = h[:-k] * factor
        more += h[k:]
        h, k = more, 2 * k
    return h


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[begin:end], each of `length` bytes or more: runs of windows with one anchor, as text, first
    window, last window, gram, context."""
    w = length - GRAM + 1
    h = _grams(data)
    n = len(h)
    blocks = -(-n // w)
    grid = np.full((blocks, w), np.iinfo(U64).max, U64)
    value = grid.ravel()
    np.bitwise_and(h, ~_PLACES, out=value[:n])
    value[:n] |= np.arange(n, dtype=U64)
    fore = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(data) - length + 1
    anchor = np.minimum(back[:m], fore[w - 1 : w - 1 + m])
    anchor &= _PLACES
    new = np.ones(m + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:m])
    new[begins] = True
    new[ends - length + 1] = True
    at = np.flatnonzero(new)
    first, last = at[:-1], at[1:] - 1
    text = np.searchsorted(begins, first, side="right") - 1
    inside = first <= ends[text] - length
    first, last, text = first[inside], last[inside], text[inside]
    context = (last - first).astype(U64)
    for k in range(-(-(length + w - 1) // GRAM)):  # grams that cover the context
        context = mix64(context ^ h[np.minimum(first + k * GRAM, last + length - GRAM)])
    return text, first, last, mix64(h[anchor[first].astype(np.int64)]).view(np.int64), context.view(np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of positive integers in order, by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, np.zeros(3, np.int64))).astype(np.int64)
    top = int(t.max()) + 1
    cover = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    if top**3 < 1 << 62:
        key = (t[cover] * top + t[cover + 1]) * top + t[cover + 2]
    else:
        key = np.unique(t[cover] * top + t[cover + 1], return_inverse=True)[1] * top + t[cover + 2]
    order = np.argsort(key, kind="stable")
    name = np.empty(len(cover), np.int64)
    ordered = key[order]
    name[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
    if name.max() < len(cover):
        order = suffix_array(name)
    sampled = cover[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * (n + 3) + rank[rest + 1], kind="stable")]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[ones] * (n + 3) + rank[ones + 1], t[rest] * (n + 3) + rank[rest + 1])
    if top * top * (n + 3) < 1 << 62:
        two, mine = ((t[x] * top + t[x + 1]) * (n + 3) + rank[x + 2] for x in (twos, rest))
    else:
        pair = np.unique(np.concatenate((t[twos] * top + t[twos + 1], t[rest] * top + t[rest + 1])), return_inverse=True)[1]
        two, mine = pair[: len(twos)] * (n + 3) + rank[twos + 2], pair[len(twos) :] * (n + 3) + rank[rest + 2]
    before = before + np.searchsorted(two, mine)
    out = np.full(n, -1, np.int64)
    out[np.arange(len(rest)) + before] = rest
    out[out < 0] = sampled
    return out


def repeated(contexts: list[bytes], twice: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context: ranges (first, last) of windows that occur in another context, or anywhere if it is there twice."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    s = raw.astype(np.int64) + 2
    s[begins + sizes] = 1
    order = suffix_array(s)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    room = np.zeros(len(s), bool)
    mark = np.zeros(len(s) + 1, np.int64)
    fits = sizes >= length
    np.add.at(mark, begins[fits], 1)
    np.add.at(mark, (begins + sizes)[fits] - length + 1, -1)
    room = np.cumsum(mark)[: len(s)] > 0
    order = order[room[order]]
    hit = np.zeros(len(s), bool)
    hit[twice[owner] & room] = True
    left, right = order[:-1], order[1:]
    left, right = left[differ := owner[left] != owner[right]], right[differ]
    words = np.lib.stride_tricks.as_strided(np.concatenate((raw, np.zeros(8, np.uint8))), (len(raw), 8), (1, 1)).copy().view(np.uint64).ravel()
    for step in [*range(0, length - 7, 8), length - 8]:
        if not len(left):
            break
        same = words[left + step] == words[right + step]
        left, right = left[same], right[same]
    hit[left] = hit[right] = True
    out: list[list[tuple[int, int]]] = []
    for b, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        at = np.flatnonzero(hit[b : b + n])
        ends = np.flatnonzero(np.diff(at) > 1) if len(at) else at
        out.append(list(zip(at[np.append(0, ends + 1)].tolist(), at[np.append(ends, len(at) - 1)].tolist(), strict=True)) if len(at) else [])
    return out


def _ref() -> F.Column:
    """Names a row by its doc_id and text; rows that repeat both share the name, and the outcome."""
    return F.xxhash64("doc_id", "text")


def _runs(rows: DataFrame, length: int) -> DataFrame:
    most = 1 << 20  # a longer text goes in parts that overlap by length - 1 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", rows=1024, mb=0.25):
            refs = b.column(0)
            data, at = text_bytes(b.column(1))
            for shift in range(0, len(data) - length + 1, most) if b.num_rows == 1 else (0,):
                part, ends = (data[shift : shift + most + length - 1], None) if b.num_rows == 1 else (data, at[1:])
                ends = np.array([len(part)]) if ends is None else ends
                begins = np.concatenate(([0], ends[:-1]))
                text, first, last, gram, context = runs(part, begins, ends, length)
                if len(text):
                    yield pa.record_batch([pa.array(gram), pa.array(context), refs.take(pa.array(text)), pa.array((first - begins[text] + shift).astype(np.int32)), pa.array((last - first + length).astype(np.int32))], ["gram", "context", "ref", "at", "size"])

    return rows.mapInArrow(run, "gram long, context long, ref long, at int, size int")


def spans(docs: DataFrame, length: int = 200, group_bytes: int = 1 << 20) -> DataFrame:
    """ref (see `_ref`) and spans (start, end in bytes, unmerged) of the rows of docs that have repeated strings.

    docs: doc_id, text. Occurrences in all rows count, in the same text too; matches never cross texts.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    texts = docs.where(F.octet_length("text") >= length).select(_ref().alias("ref"), F.col("text").cast("string").alias("text"))
    found = _runs(texts, length)
    again = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))  # so that the join can be split
    placed = cut(found.join(again, "gram"))
    contexts = placed.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ref", "at", "size")).alias("one"))
    per = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("one.size").cast("long")).alias("bytes"))
    known = cut(contexts.join(per, "gram"))
    mixed = known.where("kinds > 1").select("gram", "context", "n", "bytes", "one.ref", "one.at", "one.size")
    holders = only_members(texts, members(mixed.select("ref").distinct()))
    cutouts = cut(mixed.join(holders, "ref").select("gram", "context", (F.col("n") > 1).alias("twice"), "bytes", F.substring(F.col("text").cast("binary"), F.col("at") + 1, F.col("size")).alias("data")))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            ranges = repeated([h[3] for h in held], np.array([h[2] for h in held]), length)
            flat = [(h[0], h[1], lo, hi) for h, r in zip(held, ranges, strict=True) for lo, hi in r]
            return pa.record_batch([pa.array([x[k] for x in flat], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["gram", "context", "lo", "hi"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= min(group_bytes, 1 << 18) // 2 and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield done()

    small = cutouts.where(F.col("bytes") <= group_bytes).select("gram", "context", "twice", "data").repartition("gram").sortWithinPartitions("gram", "context")
    ranges = small.mapInArrow(sort, "gram long, context long, lo int, hi int").unionByName(_by_window(cutouts.where(F.col("bytes") > group_bytes), length))
    parts = placed.join(ranges, ["gram", "context"]).select("ref", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("hi") + length).alias("end"))
    whole = placed.join(known.where("kinds = 1").select("gram"), "gram").select("ref", F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    return whole.unionByName(parts)


def _by_window(cutouts: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows of contexts, by counting the windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, context, twice, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                at = range(len(data) - length + 1)
                names = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in at]
                yield pa.record_batch([pa.array([gram] * len(at), pa.int64()), pa.array([context] * len(at), pa.int64()), pa.array(list(at), pa.int32()), pa.array([twice] * len(at)), pa.array(names, pa.binary())], ["gram", "context", "lo", "twice", "name"])

    windows = cutouts.select("gram", "context", "twice", "data").mapInArrow(run, "gram long, context long, lo int, twice boolean, name binary")
    counts = windows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any")).where("n > 1 or any")
    return windows.join(counts.select("name"), "name").select("gram", "context", "lo", F.col("lo").alias("hi"))


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _applied(docs: DataFrame, length: int, change, schema: str) -> DataFrame:
    """change(text bytes, merged spans) -> values after doc_id, for every row of docs (ref, text and what it carries)."""
    found = cut(spans(docs, length).groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    bits = members(found.select("ref"))
    rows = docs.select(_ref().alias("ref"), "doc_id", F.col("text").cast("string").alias("text"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(not_members(bits, batches))  # one Python worker for both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in pieces(batches, "text", mb=1):
            lists = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            out = [change((t or "").encode(), merge([(s["start"], s["end"]) for s in x or []])) for t, x in zip(b.column(2).to_pylist(), lists, strict=True)]
            kinds = kinds or [pa.int64() if isinstance(v, int) else pa.string() for v in out[0]]
            yield pa.record_batch([b.column(1), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", *[c.split()[0] for c in schema.split(", ")]])

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}"
    hit = only_members(rows, bits).join(found, "ref", "left").select("ref", "doc_id", "text", "spans")
    return hit.mapInArrow(run, shape).unionByName(rows.mapInArrow(others, shape))


def digest(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row: what goes, and the hash of what stays.

    Null texts count as empty; texts shorter than `length` lose nothing; rows that repeat a longer text lose
    all of it; an empty table gives no rows.
    """

    def change(raw: bytes, cuts: list[tuple[int, int]]) -> tuple:
        return len(raw), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(_without(raw, cuts)).hexdigest()

    return _applied(docs.select("doc_id", "text"), length, change, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in cuts:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def strip(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents without their repeated strings, columns as they were, n_chars made anew.

    A character that a cut would split goes with it. Documents that held nothing but repeated strings and white
    space go; documents without repeated strings stay as they are.
    """

    def change(raw: bytes, cuts: list[tuple[int, int]]) -> tuple:
        wide = []
        for s, e in cuts:
            while s and raw[s] & 0xC0 == 0x80:
                s -= 1
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                e += 1
            wide.append((s, e))
        return (_without(raw, merge(wide)).decode(),)

    found = cut(spans(docs.select("doc_id", "text"), length).groupBy("ref").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    columns, ref, held = docs.columns, spare(docs, "_ref"), spare(docs, "_spans")
    named = docs.withColumn(ref, _ref())
    joined = named.join(found.withColumnsRenamed({"ref": ref, "spans": held}), ref, "left").select(*columns, held)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", mb=1):
            lists = b.column(b.num_columns - 1).to_pylist()
            new = [t if not x else change(t.encode(), merge([(s["start"], s["end"]) for s in x]))[0] for t, x in zip(b.column(at).to_pylist(), lists, strict=True)]
            keep = pa.array([not x or bool(t.strip()) for t, x in zip(new, lists, strict=True)])
            out = b.select(columns).set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            yield out.filter(keep)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns) if "n_chars" in columns else out
