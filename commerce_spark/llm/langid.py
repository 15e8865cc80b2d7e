"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the whole text (A-Z lowered, other ASCII signs and digits as blanks), as shares
of the text's trigrams. Every classifier is linear in them, so a text's margin is the mean of its trigrams' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

BITS = 13
STEP = 1 << 16  # trigrams that are weighed at a time
#: Families of language codes; a code that is not listed is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "hu": "uralic", "et": "uralic",
}
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts end to end: each trigram's bucket, whether it counts (its middle is no blank), and where texts begin."""
    raw = [t.encode() for t in texts]
    data = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)]
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])[:-1])).astype(np.int64)
    mixed = data[:-2] * np.uint32(0x9E3779B1)
    mixed ^= data[1:-1] * np.uint32(0x85EBCA77)
    mixed ^= data[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS)).astype(np.uint16), data[1:-1] != 32, begins


def features(texts: list[str]) -> np.ndarray:
    """A row of trigram shares for each text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, t in enumerate(texts):
        codes, counts, _ = _trigrams([t])
        if n := int(counts.sum()):
            out[i] = np.bincount(codes[counts], minlength=1 << BITS) / n
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, classes weighed alike); y is +-1."""
    used = np.flatnonzero(x.any(axis=0))
    full, x, y = np.zeros(x.shape[1]), np.ascontiguousarray(x[:, used]), y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb, turn = w.copy(), b, 1.0
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    turned = np.ascontiguousarray(x.T)
    step = 1.0 / (1.0 + 2 * c * (float((x * x).sum(axis=1).max(initial=0)) + 1))
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * each * y
        new_w, new_b = vw - np.float32(step) * (vw - np.float32(2 * c) * (turned @ slack)), vb + step * 2 * c * slack.sum()
        new = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        vw, vb = new_w + np.float32((turn - 1) / new) * (new_w - w), new_b + (turn - 1) / new * (new_b - b)
        w, b, turn = new_w, new_b, new
    full[used] = w
    return full, float(b)


@dataclass
class Model:
    """families: family -> languages. Column k of `weights` (and `bias`) belongs to the pair `pairs[k]`."""

    families: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def _vote(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among names by votes, then by summed margins; and its smallest margin."""
        total, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
        votes = np.zeros_like(total)
        at = {p: k for k, p in enumerate(self.pairs)}
        for i, j in combinations(range(len(names)), 2):
            m = margins[:, at[names[i], names[j]]]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.argmax(votes + np.tanh(total / max(1, len(names))) * 0.49, axis=1)
        return best, least[np.arange(len(margins)), best]

    def _sums(self, codes: np.ndarray, counts: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The weights of each text's trigrams, summed by pair in steps of 2^16 trigrams: memory grows with neither texts nor
        languages times signs."""
        out = np.zeros((len(begins), len(self.pairs)))
        for a in range(0, len(codes) if self.pairs else 0, STEP):
            b = min(a + STEP, len(codes))
            first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
            starts = np.maximum(begins[first:last] - a, 0)
            out[first:last] += np.add.reduceat(np.where(counts[a:b, None], self.weights[codes[a:b]], 0), starts, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; und and 0 for a text that is null or has no letter."""
        if not texts or not self.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        whole = [t or "" for t in texts]
        codes, counts, begins = _trigrams(whole)
        n = np.add.reduceat(counts, begins, dtype=np.int64)
        margins = self._sums(codes, counts, begins) / np.maximum(n, 1)[:, None] + self.bias
        names = sorted(self.families)
        family, sure = self._vote(names, margins)
        picked, score = np.empty(len(texts), object), _squash(sure)
        for k, f in enumerate(names):
            own = np.flatnonzero(family == k)
            lang, margin = self._vote(self.families[f], margins[own])
            picked[own] = np.array(self.families[f], object)[lang]
            score[own] = score[own] * _squash(margin)
        for i, t in enumerate(whole):
            if not any(map(str.isalpha, t)):
                picked[i], score[i] = "und", 0.0
        return picked.tolist(), np.where(picked == "und", 0.0, score)


def _squash(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))


def fit(docs: DataFrame, per_language: int = 200, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Train on a sample of at most `per_language` rows a language: those whose doc_id hashes lowest.

    The bound is this parameter times the number of languages; the sampled rows' features are made from whole
    texts on the executors. Rows whose language or text is null, or whose text has no letter, don't count.
    """
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text rlike '\\\\p{L}'")
    # the ranks are taken over narrow rows; texts are only fetched for the sample
    best = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_language)
    sample = rows.join(F.broadcast(best.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one row an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            x = features(b.column(0).to_pylist())
            cells = [np.flatnonzero(r) for r in x]
            yield pa.record_batch([b.column(1), b.column(2), pa.array([c.astype(np.int32).tobytes() for c in cells]), pa.array([r[c].tobytes() for r, c in zip(x, cells, strict=True)])], ["lang", "doc_id", "at", "share"])

    found = sorted(sample.select("text", "lang", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(run, "lang string, doc_id string, at binary, share binary").collect(), key=lambda r: (r.lang, r.doc_id, r.at))
    langs = np.array([r.lang for r in found], object)
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.at, np.int32)] = np.frombuffer(r.share, np.float32)
    scale = 1 / max(float(np.sqrt((x * x).sum(axis=1)).mean()), 1e-9) if len(x) else 1.0
    x *= scale
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(FAMILY.get(lang, lang), []).append(lang)
    family = np.array([FAMILY.get(lang, lang) for lang in langs], object)
    pairs, weights, bias = [], [], []
    for label, names in [(family, sorted(families)), *[(langs, f) for f in families.values()]]:
        for a, b in combinations(names, 2):
            own = (label == a) | (label == b)
            wt, bs = _svm(x[own], np.where(label[own] == a, 1.0, -1.0))
            pairs.append((a, b))
            weights.append(wt * scale)
            bias.append(bs)
    return Model(families, pairs, np.array(weights, np.float32).reshape(len(pairs), 1 << BITS).T.copy(), np.array(bias))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row from its whole text alone. Null and empty texts and texts without a letter are
    und with score 0; rows may share an id or have none, and repeated rows get equal results; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", mb=4):
            lang, score = model.predict(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is in some language, columns as they were: a null lang becomes the predicted one, and
    rows predicted und (null texts, texts without a letter) go. A table without lang stays one."""

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", mb=4):
            k = b.schema.get_field_index("lang")
            lang, _ = model.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            keep = pa.array([x != "und" for x in lang])
            if k < 0:
                yield b.filter(keep)
                continue
            filled = pa.array([old if old is not None else new for old, new in zip(b.column(k).to_pylist(), lang, strict=True)], b.schema.field(k).type)
            yield b.set_column(k, b.schema.field(k), filled).filter(keep)

    return docs.mapInArrow(run, docs.schema).select(columns)
