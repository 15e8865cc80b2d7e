"""SentencePiece BPE with seeded merge-dropout, and its decoder.

A text gets a blank in front, blanks become U+2581, and pieces never cross from a sign to a blank, so a text is
encoded in chunks of blanks and the signs after them. In a chunk the agenda takes the best-scored neighbouring
pair again and again (the leftmost on ties); each candidate it takes is skipped, for good, with chance `dropout`.
Which ones are, is drawn for every occurrence of a chunk: a keyed hash of (seed, text, the chunk's place in it) gives
the numbers of the takes to skip, by geometric gaps. Signs without a piece become byte pieces, and so does a
U+2581 of the text itself; so whatever is skipped, the pieces spell the text.

What an agenda makes depends on the chunk and on the takes it skips alone. So each worker grows a forest: a
root is a chunk without skips, and a node's child by take t is the agenda that skips t too. A node holds its pieces and how
many takes it has; an occurrence walks from the root by its own draws until the next one comes after the last take. All
occurrences of a batch walk at once, as arrays, and nodes that don't exist yet are made by the agenda for many chunks in
step. The forest is bounded and starts anew when it is full. Chunks of over LONG signs are no nodes: each goes through
the agenda by heap. Both give the same.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Grown, Names, chunks_of, hashes, mix64, pieces, ranges, text_bytes, trim

BLANK = "▁"
NONE = np.iinfo(np.int32).max
EVERY = 1 << 22  # more than all pieces and all code points together
LONG = 64
_M = (1 << 64) - 1
_SPREAD = U64(0x9E3779B97F4A7C15)


def gaps(x: np.ndarray, k: int | np.ndarray, dropout: float) -> np.ndarray:
    """Takes between the skip before and skip `k` of the occurrences with hashes x: geometric, so that each take is
    skipped with chance `dropout` whatever came before."""
    if dropout >= 1:
        return np.zeros(np.broadcast(x, k).shape, np.int64)
    with np.errstate(over="ignore"):
        u = ((mix64(x + np.asarray(k, U64) * U64(0x9FB21C651E98DF25)) >> U64(11)).astype(np.float64) + 0.5) * (1 / (1 << 53))
    return np.minimum(np.log(u) * (1 / np.log1p(-dropout)), 1 << 30).astype(np.int64)


class Codec:
    """A vocabulary with its merges, a dropout rate, a seed, and the forest of agendas. `room` bounds the forest's
    nodes and `room` times 16 its pieces, takes and signs, beyond what one batch adds."""

    def __init__(self, model_path: str, dropout: float = 0.1, seed: int = 0, room: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_ = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_) != 256:
            raise ValueError("the model has no byte pieces, so texts can't be decoded as they were")
        normal = {names[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("the model has pieces across words")
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        ranks = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        merges = [(normal[p[:k]], normal[p[k:]], i, ranks[sp.get_score(i)]) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self.size = n
        self.sign = np.arange(n, n + 0x110000, dtype=np.int32)
        for c, i in self.chars.items():
            if c != BLANK:
                self.sign[ord(c)] = i
        self.sign[ord(" ")] = self.chars.get(BLANK, n + ord(" "))
        self.wide = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.spelled = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.spelled_len = np.array(list(map(len, self.spelled)), np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled_all = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.merges = {(a, b): (c, r) for a, b, c, r in merges}
        self._hashed(np.array(merges, np.int64).reshape(-1, 4))
        self.dropout, self.seed, self.room = dropout, seed, room
        self.clear()

    # ---- merges by arrays

    def _hashed(self, merges: np.ndarray) -> None:
        """A perfect hash table of the merges, for look-ups by arrays: the keys of a bucket are moved by the bucket's
        offset to free slots, largest buckets first. A slot holds the pair and the rank of its merge in one number."""
        by_rank, kinds = np.unique(np.unique(merges[:, 3:1:-1], axis=0)[:, 0], return_counts=True)
        self.made = np.full(int(merges[:, 3].max(initial=0)) + 1, -1, np.int32)  # by rank; -1 where pieces share one
        self.made[merges[:, 3]] = merges[:, 2]
        self.made[by_rank[kinds > 1]] = -1
        size = 1 << max(8, int(4 * len(merges)).bit_length())
        buckets = size >> 3
        self.bucket_shift, self.mask = U64(64 - (buckets.bit_length() - 1)), U64(size - 1)
        key = merges[:, 0] * EVERY + merges[:, 1]
        h = key.view(U64) * _SPREAD
        bucket = (h >> self.bucket_shift).astype(np.int64)
        places = ((h >> U64(20)) & self.mask).astype(np.int64)
        self.moved, self.slots = np.zeros(buckets, U64), np.full(size, -1, np.int64)
        free = np.ones(size, bool)
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
        for g in sorted(groups, key=len, reverse=True):
            mine, by = places[g], 0
            if len(set(mine.tolist())) < len(mine):
                raise ValueError("two merges have the same place")
            while not free[at := (mine + by) & (size - 1)].all():
                by += 1
                if by > size:
                    raise ValueError("no room for a bucket of merges")
            free[at] = False
            self.moved[bucket[g[0]]] = by
            self.slots[at] = (key[g] << 20) | merges[g, 3]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the merges of left and right; NONE where they make none. Symbols that are no pieces never do."""
        key = left * np.int64(EVERY)
        key += right
        h = key.view(U64) * _SPREAD
        at = self.moved.take((h >> self.bucket_shift).view(np.int64))
        h >>= U64(20)
        at += h
        at &= self.mask
        found = self.slots.take(at.view(np.int64))
        key ^= found >> 20
        found &= (1 << 20) - 1
        found[key != 0] = NONE
        return found

    # ---- agendas

    def stepped(self, sym: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda for many chunks at once (a row each, under 120 signs, filled up with -1): take t is the best
        candidate of every chunk that has one, and is skipped where the row of skips has t. Of the result's rows the
        values from 0 on count; with them come the numbers of takes.

        Inside, a chunk is a column with a border at both ends, and a candidate is its rank and place in one number.
        """
        n, wide = sym.shape
        takes, final = np.zeros(n, np.int64), sym.copy()
        if wide < 2:
            return final, takes
        signs = np.full((wide + 2, n), -1, np.int32)
        signs[1:-1] = sym.T
        place = np.arange(wide + 2, dtype=np.int32)[:, None]
        best = np.full(signs.shape, NONE, np.int32)
        best[1:-2] = self._candidates(self._ranks(signs[1:-2].ravel(), signs[2:-1].ravel()), np.repeat(place[1:-2, 0], n)).reshape(wide - 1, n)
        after, before = np.repeat(place + 1, n, axis=1).ravel(), np.repeat(place - 1, n, axis=1).ravel()
        signs, best = signs.ravel(), best.ravel()
        mine, t, skips = np.arange(n), 0, skips.T
        while True:
            top = best.reshape(wide + 2, n).min(axis=0)
            live = np.flatnonzero(top != NONE)
            if len(live) < 0.75 * n:  # leave out the columns that are done
                done = top == NONE
                final[mine[done]] = signs.reshape(wide + 2, n)[1:-1, done].T
                takes[mine[~done]] = t
                signs, best, after, before = (x.reshape(wide + 2, n)[:, live].ravel() for x in (signs, best, after, before))
                mine, skips, top, n = mine[live], skips[:, live], top[live], len(live)
                live = np.arange(n)
                if not n:
                    break
            takes[mine[live]] = t + 1
            column, chosen = live, top[live]
            place = chosen & 127
            at = place.astype(np.int64) * n + column
            best[at] = NONE
            for row in skips:
                if (skip := row.take(column) == t).any():
                    go = ~skip
                    column, at, chosen, place = column[go], at[go], chosen[go], place[go]
            t += 1
            next_ = after.take(at).astype(np.int64) * n + column
            made = self.made.take(chosen >> 7)
            if len(tied := np.flatnonzero(made < 0)):
                made[tied] = [self.merges[pair][0] for pair in zip(signs[at[tied]].tolist(), signs[next_[tied]].tolist(), strict=True)]
            beyond = after.take(next_)
            right = beyond.astype(np.int64) * n + column
            back = before.take(at)
            left = back.astype(np.int64) * n + column
            signs[at], signs[next_], best[next_], after[at], before[right] = made, -1, NONE, beyond, place
            best[at] = self._candidates(self._ranks(made, signs.take(right)), place)
            best[left] = self._candidates(self._ranks(signs.take(left), made), back)
        return final, takes

    @staticmethod
    def _candidates(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        found = (rank << 7) + place
        found[rank == NONE] = NONE
        return found

    def heaped(self, sym: list[int], skips: Iterable[int]) -> tuple[list[int], int]:
        """The agenda for one chunk, by heap."""
        n, get, skips, takes = len(sym), self.merges.get, set(skips), 0
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (found := get((sym[i], sym[after[i]]))):
                heap.append((found[1], i, sym[i], sym[after[i]], found[0])) if filling else heapq.heappush(heap, (found[1], i, sym[i], sym[after[i]], found[0]))

        filling = True
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        filling = False
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            takes += 1
            if takes - 1 in skips:
                continue
            sym[i], sym[j], after[i] = c, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in sym if s >= 0], takes

    def signs(self, chunk: str) -> list[int]:
        """Pieces of single signs; a sign without one is the vocabulary's size plus its code point. Blanks come as ' '."""
        return self.sign[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()

    # ---- the forest

    def clear(self) -> None:
        self.words = Names()  # chunks without their first blank
        # of chunks: root, start and number of their signs, start and number of their bytes
        self.root, self.sign_at, self.sign_n, self.byte_at, self.byte_n = (Grown(np.int32) for _ in range(5))
        self.all_signs, self.all_bytes = Grown(np.int32), Grown(np.uint8)
        # of nodes: chunk, parent, the take it skips more than its parent, takes, first slot of its children less its first
        # free take, start and number of pieces, whether they spell the chunk
        self.word, self.parent, self.skipped, self.takes, self.base, self.start, self.many = (Grown(np.int32) for _ in range(7))
        self.good, self.child, self.pool = Grown(bool), Grown(np.int32), Grown(self.wide)

    def _skips(self, parent: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """A row for each new node: the takes skipped on the way up to its root, filled up with -1."""
        columns, at = [], np.flatnonzero(parent >= 0)
        skips, up = skipped[at], parent[at]
        while len(at):
            columns.append((at, skips))
            skips, up = self.skipped.a[up], self.parent.a[up]
            live = skips >= 0
            at, skips, up = at[live], skips[live], up[live]
        table = np.full((len(parent), len(columns)), -1, np.int64)
        for k, (rows, s) in enumerate(columns):
            table[rows, k] = s
        return table

    def _with_bytes(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with byte pieces for signs that have none, and how many each made."""
        many = np.ones(len(flat), np.int64)
        odd = np.flatnonzero(flat >= self.size)
        if not len(odd):
            return flat, many
        points, which = np.unique(flat[odd], return_inverse=True)
        spelt = [[self.bytes_[x] for x in chr(p - self.size).encode()] for p in points.tolist()]
        sizes = np.array(list(map(len, spelt)))
        many[odd] = sizes[which]
        out = np.repeat(flat, many)
        out[ranges((np.cumsum(many) - many)[odd], many[odd])] = np.concatenate(spelt)[ranges((np.cumsum(sizes) - sizes)[which], many[odd])]
        return out, many

    def _grow(self, word: np.ndarray, parent: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """New nodes, by chunk, parent (-1: none) and the take to skip."""
        new = self.word.n + np.arange(len(word))
        table = self._skips(parent, skipped)
        sizes, begins = self.sign_n.a[word], self.sign_at.a[word]
        many, takes, start = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 24), (24, 40), (40, LONG)):
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            for s in range(0, len(mine), 1 << 14):
                rows = mine[s : s + (1 << 14)]
                sym = np.full((len(rows), int(sizes[rows].max())), -1, np.int32)
                sym[np.arange(sym.shape[1]) < sizes[rows][:, None]] = self.all_signs.a[ranges(begins[rows], sizes[rows])]
                found, takes[rows] = self.stepped(sym, table[rows])
                real = found >= 0
                flat, made = self._with_bytes(found[real])
                here = real.sum(axis=1)
                many[rows] = np.add.reduceat(made, np.cumsum(here) - here)
                start[rows] = self.pool.n + np.cumsum(many[rows]) - many[rows]
                self.pool.add(flat)
        free = np.where(parent >= 0, skipped + 1, 0)
        slots = np.maximum(takes - free, 0)
        self.word.add(word)
        self.parent.add(parent)
        self.skipped.add(np.where(parent >= 0, skipped, -1))
        self.takes.add(takes)
        self.base.add(self.child.n + np.cumsum(slots) - slots - free)
        self.start.add(start)
        self.many.add(many)
        self.good.add(self._spells(word, start, many))
        self.child.add(np.full(int(slots.sum()), -1, np.int32))
        return new

    def _spells(self, word: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Whether the pieces from `start` on spell the chunk."""
        ids = self.pool.a[ranges(start, many)]
        lengths = self.spelled_len[ids]
        total, want = np.add.reduceat(lengths, np.cumsum(many) - many), self.byte_n.a[word]
        good = total == want
        if not good.all():  # compare those alone that have the right length
            some = np.flatnonzero(good)
            if len(some):
                good[some] = self._spells(word[some], start[some], many[some])
            return good
        same = self.spelled_all[ranges(self.spelled_at[ids], lengths)] == self.all_bytes.a[ranges(self.byte_at.a[word], want)]
        return np.logical_and.reduceat(same, np.cumsum(total) - total)

    def _rooted(self, names: pa.Array) -> np.ndarray:
        """The roots of chunks (given without their first blank); -1 for long ones."""
        data, at = text_bytes(names)
        h = hashes(names)
        word = self.words.find(data, at, h)
        node = np.where(word >= 0, self.root.a[word], -1).astype(np.int64)
        missing = np.flatnonzero((word < 0) & (pc.utf8_length(names).to_numpy(zero_copy_only=False) < LONG))
        if len(missing):
            data, at = text_bytes(names.take(pa.array(missing)))
            new = self.words.add(data, at, h[missing])
            spaced, at = np.full(len(data) + len(new), 32, np.uint8), at + np.arange(len(at))  # each with its blank
            body = np.ones(len(spaced), bool)
            body[at[:-1]] = False
            spaced[body] = data
            points = np.frombuffer(spaced.tobytes().decode().encode("utf-32-le"), np.uint32)
            lead = np.cumsum((spaced & 0xC0) != 0x80)  # code points up to each byte
            begin = np.append(lead[at[:-1]] - 1, len(points))
            self.sign_at.add(self.all_signs.n + begin[:-1])
            self.sign_n.add(np.diff(begin))
            self.byte_at.add(self.all_bytes.n + at[:-1])
            self.byte_n.add(np.diff(at))
            self.all_signs.add(self.sign[points])
            self.all_bytes.add(spaced)
            none = np.full(len(new), -1, np.int64)
            node[missing] = self._grow(new, none, none)
            self.root.add(node[missing])
        return node

    def walk(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """From the roots to the nodes that occurrences with hashes x end at."""
        node = node.copy()
        if not self.dropout or not len(node):
            return node
        skip, k = gaps(x, 0, self.dropout), 0
        left = np.flatnonzero(skip < self.takes.a[node])
        skip = skip[left]
        while len(left):
            k += 1
            slot = self.base.a[node[left]] + skip
            child = self.child.a[slot]
            if (missing := np.flatnonzero(child < 0)).size:
                slots, one = np.unique(slot[missing], return_index=True)
                one = missing[one]
                up = node[left[one]]
                self.child.a[slots] = self._grow(self.word.a[up], up, skip[one])
                child = self.child.a[slot]
            node[left] = child
            skip = skip + 1 + gaps(x[left], k, self.dropout)
            more = skip < self.takes.a[child]
            left, skip = left[more], skip[more]
        return node

    def drawn(self, x: int, takes: int) -> list[int]:
        """The takes below `takes` that the occurrence with hash x skips."""
        out: list[int] = []
        at, k = -1, 0
        while self.dropout and at < takes:
            some = at + np.cumsum(1 + gaps(np.full(256, x, U64), k + np.arange(256), self.dropout))
            out += some.tolist()
            at, k = out[-1], k + 256
        return [s for s in out if s < takes]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, the number of each text's, and whether they spell it. A null or empty text
        has none."""
        if max(self.word.n, (self.child.n + self.pool.n + self.all_signs.n) // 16) > self.room:
            self.clear()
        data, offsets = text_bytes(texts)
        keys, counts = chunks_of(data, offsets)
        coded = keys.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary
        node = self._rooted(names)[index]
        whole = np.array([xxhash.xxh3_64_intdigest(data[a:b], self.seed & _M) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], U64)
        first = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            place = np.arange(len(node)) - np.repeat(first, counts)
            x = mix64(place.astype(U64) * U64(0xD1342543DE82EF95) + np.repeat(whole, counts))
        long = np.flatnonzero(node < 0)
        short = np.flatnonzero(node >= 0) if len(long) else slice(None)
        node[short] = self.walk(node[short], x[short])
        many, good = self.many.a[node], self.good.a[node]
        own = {}
        for i in long.tolist():
            chunk = " " + names[int(index[i])].as_py()
            ids = self.heaped(self.signs(chunk), self.drawn(int(x[i]), 3 * len(chunk)))[0]
            own[i] = self._with_bytes(np.array(ids, np.int64))[0].astype(self.wide)
            many[i], good[i] = len(ids), self.spell(own[i]) == chunk.encode()
        ends = np.cumsum(many, dtype=np.int64)
        if own:
            pool, start = np.concatenate([self.pool.a[: self.pool.n], *own.values()]), self.start.a[node].astype(np.int64)
            start[list(own)] = self.pool.n + np.cumsum([0, *map(len, own.values())])[:-1]
        else:
            pool, start = self.pool.a, self.start.a[node]
        ids = pool[ranges(start, many)]
        sums = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        bad = np.concatenate(([0], np.cumsum(~good)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(sums), np.diff(bad) == 0

    def pieces(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text that the pieces spell: what `encode` was given, whatever the dropout."""
        whole = self.spell(ids)
        return (whole[1:] if whole[:1] == b" " else whole).decode("utf-8", "replace")


_made: dict[tuple, Codec] = {}


def codec(*key) -> Codec:
    """One codec for each worker and parameters."""
    if key not in _made:
        _made.clear()
        _made[key] = Codec(*key)
    return _made[key]


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers) and lossless (whether
    the pieces of every chunk spell it, and so the text) of every whole text. model_path is read by every worker. Null
    and empty texts have no pieces and are lossless; equal texts get equal pieces; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path, dropout, seed)
        try:
            for b in pieces(batches, "text", rows=4096, mb=2):
                ids, many, good = tool.encode(b.column(1))
                ids = ids.astype("<i4")
                ends = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.record_batch([b.column(0), pa.array(many.astype(np.int64)), lists, pa.array(crc, pa.int64()), pa.array(good)], ["doc_id", "n_pieces", "ids", "ids_crc32", "lossless"])
        finally:
            tool.clear()  # a worker outlives the task, and other stages need its memory
            trim()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path, 0.0)
        for b in batches:
            texts = [None if x is None else tool.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
