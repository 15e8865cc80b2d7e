"""Extra columns whose names the operators use themselves: columns stay, values too."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commerce_spark.llm import langid, mixing, simhash, suffixdedup
from commerce_spark.llm.common import spare

CLASH = "_at _AT_ _id _slot _place _ref _spans ref spans start end rank slot place fp component_id a b turn lane size cycle served name one".split()


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.drop("fp").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})


def kept(df, clashing):
    """df has the columns, and in every row the values that belong to its doc_id."""
    assert df.columns == clashing.columns
    rows = df.collect()
    assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH)
    return rows


def test_spare_names(spark):
    assert spare(spark.range(1), "x") == "x" and spare(spark.range(1).selectExpr("id as X", "id as x_"), "x") == "x__"


@pytest.mark.parametrize("stage", ["langid", "simhash", "suffixdedup", "mixing"])
def test_stages_keep_clashing_columns(clashing, odd, stage):
    run = {"langid": lambda d: langid.keep_known(d, langid.fit(d)), "simhash": simhash.keep_first, "suffixdedup": suffixdedup.strip, "mixing": mixing.mixed}[stage]
    rows = kept(run(clashing), clashing)
    plain = run(odd.drop("fp")).collect()
    assert sorted(repr((r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r in rows) == sorted(repr(tuple(r)) for r in plain)


def test_a_table_without_languages(odd):
    model = langid.fit(odd)
    got = langid.keep_known(odd.select("doc_id", "text"), model)
    assert got.columns == ["doc_id", "text"] and {r.doc_id for r in got.collect()} == {r.doc_id for r in langid.keep_known(odd, model).collect()}
