from __future__ import annotations

import duckdb
import pytest


@pytest.fixture(scope="session")
def texts(data):
    """All documents of the small table: doc_id -> text."""
    return dict(duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty, blank and very long texts, ties, and an extra column."""
    long = " ".join(f"palavra{i % 977}" for i in range(40_000))
    same = "the quick brown fox jumps over the lazy dog " * 12
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (6, same + "x"), (7, long), (8, "12 34 !!"), (9, "日本語のテキスト ▁ é"), (9, "日本語のテキスト ▁ é"), (None, "nameless text of some words"), (10, "a")]
    return spark.createDataFrame([(i, t, "en" if t and i != 5 else None, f"s{(i or 0) % 3}" if i != 8 else None, len(t) if t is not None else None, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
