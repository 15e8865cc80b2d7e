"""The checks K31-K42 find what was broken, and nothing in sound data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from commerce_spark.operators import ranks
from commerce_spark.plans import portfolio
from commerce_spark.plans.views import Tables
from commerce_spark.sources import generators


def tables(spark, **changed):
    t = Tables(spark, "", generators.demonstration_portfolio(spark))
    t.given |= {k: f(t.given[k]) for k, f in changed.items()}
    t.customer = spark.range(1, 121).withColumnRenamed("id", "c_custkey")
    return t


def ts(x):
    return F.lit(x).cast("timestamp")


def late(h):
    return h.withColumn("valid_from", F.when(F.col("id_cliente") == 5, ts("2025-04-01")).otherwise(F.col("valid_from")))


def twice(h):
    return h.unionByName(h.where("id_cliente = 7").withColumn("chave_cliente", F.lit("7-x")))


def empty(h):
    return h.unionByName(h.where("id_cliente = 8").withColumn("chave_cliente", F.lit("8-x")).withColumn("valid_to", F.col("valid_from")))


def shared(h):
    return h.withColumn("chave_cliente", F.when(F.col("id_cliente") == 1, F.lit("1-x")).otherwise(F.col("chave_cliente")))


def refund(i):
    wrong = F.col("id_pedido") == 2002
    return i.withColumn("valor_liquido", F.when(wrong, F.lit(-40000)).otherwise(F.col("valor_liquido")).cast("decimal(18,4)"))


CASES = [
    (portfolio.covers_customers, {"customer_history": late}, lambda r: len(r) == 3 and {x.id_cliente for x in r} == {5}),
    (portfolio.no_duplicates, {"customer_history": twice}, lambda r: len(r) == 12 and {x.id_cliente for x in r} == {7}),
    (portfolio.behaviour_in_range, {"items": refund}, lambda r: any(x.id_cliente == 0 for x in r)),
    (portfolio.items_reconcile, {"orders": lambda o: o.unionByName(o.where("id_pedido = 1002"))}, lambda r: {x.id_pedido for x in r} == {1002}),
    (portfolio.orders_in_validity, {"customer_history": shared}, lambda r: r and {x.id_pedido % 1000 for x in r if x.id_pedido < 900000} == {1}),
    (portfolio.one_current_version, {"customer_history": twice}, lambda r: [x.id_cliente for x in r] == [7]),
    (portfolio.versions_apart, {"customer_history": twice}, lambda r: [(x.id_cliente, x.outra_versao) for x in r] == [(7, "7-x")]),
    (portfolio.versions_valid, {"customer_history": empty}, lambda r: [x.chave_cliente for x in r] == ["8-x"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_checks_find_what_was_broken(spark, case):
    check, changed, found = CASES[case]
    assert check(tables(spark)).isEmpty()
    assert found(check(tables(spark, **changed)).collect())


def test_running_equals_a_plain_order(spark):
    rows = [(g, i, v) for g in ("a", "b") for i, v in enumerate([5.0, 0.0, 0.0, -3.0, 5.0, 1e9, 0.25, -700.0, 0.0, 4.999, 5.001] * 3)]
    df = spark.createDataFrame([(g, i, f"{v:.4f}") for g, i, v in rows], "g string, i long, v string").withColumn("v", F.col("v").cast("decimal(38,4)"))
    got = {(r.g, r.i): (r._pos, float(r._cum)) for r in ranks.running(df, "g", "v", "i", block=4).collect()}
    for g in ("a", "b"):
        total = 0.0
        for k, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))):
            total += v
            assert got[g, i] == (k + 1, pytest.approx(total))
