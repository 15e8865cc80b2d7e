"""Embedding columns as binary rows, and small helpers for work on blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(df: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vec (doubles as bytes) of the rows that can take part: id and vector not null, the vector not
    empty and of non-null finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = v.values
                if i is None or values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, vec binary")


def main_width(vecs: DataFrame) -> int:
    """The most frequent number of components (the smaller on a tie; 0 without rows)."""
    found = vecs.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n // 8 if found else 0


def stacked(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)
