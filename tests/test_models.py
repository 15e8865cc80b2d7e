"""The graph of models, declared checks, exact comparisons, positions with ties, and what a refused batch leaves."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import fraction_at_most
from commerce_spark.operators import quality, ranks
from commerce_spark.operators.checks import SOURCES, Declared, checked, report, violations
from commerce_spark.plans import documents, kpi, lakehouse, portfolio, views
from commerce_spark.plans.graph import GRAPH, Graph, schema_name
from commerce_spark.plans.views import Tables
from commerce_spark.sources.store import Store


def small(spark, **given):
    class Given:
        pass

    t = Given()
    t.spark, t.given = spark, given
    return t


def test_order_and_circles(spark):
    g = Graph()
    for name, needs in {"d": ("b", "c"), "b": ("a",), "c": ("a", "b"), "a": ()}.items():
        f = lambda t, *frames: spark.range(1)
        f.__name__ = name
        g.model("comercial", *needs)(f)
    assert g.order("d") == ["a", "b", "c", "d"] and g.order("b") == ["a", "b"]
    f = lambda t: spark.range(1)
    f.__name__ = "a"
    with pytest.raises(ValueError, match="twice"):
        g.model("dm")(f)
    with pytest.raises(ValueError, match="layer"):
        g.model("elsewhere")
    with pytest.raises(KeyError, match="isn't declared"):
        g.order("x")
    for name, need in (("p", "q"), ("q", "p")):
        f.__name__ = name
        g.model("dm", need)(f)
        f = lambda t, *frames: spark.range(1)
    with pytest.raises(ValueError, match="p -> q -> p"):
        g.order("p")


def test_tables_with_several_readers_are_written_once(spark, tmp_path):
    g, built = Graph(), []

    @g.model("staging")
    def s(t):
        built.append("s")
        return spark.range(6)

    @g.model("comercial", "s", by=("p",))
    def fact(t, s):
        built.append("fact")
        return s.withColumn("p", F.col("id") % 2)

    @g.model("comercial", "fact")
    def one(t, fact):
        return fact.groupBy("p").count()

    @g.model("comercial", "fact", "one")
    def two(t, fact, one):
        return fact.join(one, "p")

    t = small(spark)
    assert g.run(t, "one")[0].count() == 2 and g.written == []  # one reader: a plan
    assert g.run(t, "two")[0].count() == 6 and len(g.written) == 1 and built == ["s", "fact"] * 2
    assert g.run(small(spark, fact=spark.range(1).withColumn("p", F.lit(7))), "one")[0].first().p == 7
    store = Store(spark, str(tmp_path / "s"))
    g.publish(t, store, "two")
    assert {*store.manifest()["tables"]} == {"comercial__fact", "comercial__one", "comercial__two"}
    assert store.read("comercial__fact", where={"p": [1]}).count() == 3 and store.read("comercial__two").count() == 6
    assert schema_name("historico") == "historico" and schema_name(None) == "comercial"
    with pytest.raises(ValueError, match="identifier"):
        schema_name("a.b")


ONCE = [portfolio.seller_months, portfolio.covers_customers, portfolio.revenue_reconciles, portfolio.behaviour_in_range, *documents.PLANS.values()]


@pytest.mark.parametrize("plan", ONCE, ids=lambda f: f.__name__)
def test_tables_are_scanned_once(spark, data, plan):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = plan(Tables(spark, data))
        plans = [df._jdf.queryExecution().sparkPlan().toString() for df in [*GRAPH.written, last]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(p.count("/lineitem.parquet") for p in plans) == 1
    assert sum(p.count("/orders.parquet") for p in plans) <= 2  # the customers' history is made of orders, too


def test_position_has_few_exchanges(spark, data):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan, most in ((documents.position, 16), (documents.inconsistencies, 17), (documents.quarantine, 18)):
            last = plan(Tables(spark, data))
            many = sum(df._jdf.queryExecution().executedPlan().toString().count("Exchange ") for df in [*GRAPH.written, last])
            print(plan.__name__, "exchanges", many)
            assert many <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# --- declared checks -----------------------------------------------------------------------------------------


def test_checks_equal_one_by_one(spark, data):
    t = Tables(spark, data)
    orders = t.orders.unionByName(t.orders.where("o_orderkey % 7 = 0")).withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_custkey")))
    parents = t.customer.where("c_acctbal >= 0")
    d = Declared("orders", "o_orderkey", unique=(("o_orderkey",), ("o_custkey", "o_orderdate")), not_null=("o_custkey", "o_orderdate"), accepted={"o_orderstatus": ("F", "O")}, refers={"o_custkey": ("customer", "c_custkey")}, holds={"caro": "o_totalprice < 100000", "nulo": "o_custkey > 0"})
    got = violations(d, {"orders": orders, "customer": parents})
    q = quality
    apart = q.all_of(
        q.unique(orders, "orders", ["o_orderkey"]), q.not_null(orders, "orders", "o_custkey", "o_orderkey"), q.not_null(orders, "orders", "o_orderdate", "o_orderkey"), q.accepted(orders, "orders", "o_orderstatus", ["F", "O"], "o_orderkey"),
        q.related(orders, "orders", "o_custkey", parents, "c_custkey", "o_orderkey"), q.holds(orders, "orders", F.expr("o_totalprice < 100000"), "caro", "o_orderkey"), q.holds(orders, "orders", F.expr("o_custkey > 0"), "nulo", "o_orderkey"),
    )
    by_rule = apart.groupBy("entity", "key", "rule").count()
    mine = {tuple(r) for r in got.where("rule <> 'unique o_custkey, o_orderdate' and rule not like 'unique%'").collect()}
    assert mine == {tuple(r)[:2] + (r.rule, r["count"]) for r in by_rule.where("rule not like 'unique%'").select("entity", "key", "rule", "count").collect()}
    assert {r.key for r in got.where("rule = 'unique o_orderkey'").collect()} == {r.key for r in apart.where("rule = 'unique o_orderkey'").collect()}
    pairs = orders.groupBy("o_custkey", "o_orderdate").count().where("count > 1").count()
    assert got.where("rule = 'unique o_custkey, o_orderdate'").count() == pairs
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("orders.parquet") == 2 and plan.count("customer.parquet") == 1  # the union has two; no rule adds one

    told = {r.rule: r for r in report(got, shown=5).collect()}
    assert all(len(r.sample) == min(5, r["keys"]) and list(r.sample) == sorted(r.sample) for r in told.values())
    assert told["not null o_custkey"].rows == orders.where("o_custkey is null").count()


def test_checks_tell_null_keys_apart(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None), (None, None)], "a long, b long")
    found = violations(Declared("t", "a", unique=(("a", "b"),)), {"t": df}).collect()
    assert [(r.key, r.rows) for r in found] == [("", 2)]
    assert violations(Declared("t", "a", not_null=("b",)), {"t": df.where("false")}).count() == 0
    with pytest.raises(ValueError, match="nothing is declared"):
        violations(Declared("t", "a"), {"t": df})


def test_source_declarations_hold(spark, data):
    t = Tables(spark, data)
    history = views.customer_history(t).where("valid_to is null").select("id_cliente", "id_vendedor", F.col("valid_from").alias("atualizado_em"))
    tables = {"clientes": history, "vendedores": portfolio.seller_dimension(t), "produtos": portfolio.product_dimension(t), "pedidos": views.orders(t), "itens_pedidos": views.items(t)}
    found = checked(SOURCES, tables)
    assert {r.rule for r in found.collect()} <= {"unique id_item", "related id_cliente", "related id_pedido", "related id_vendedor", "accepted status"}
    broken = tables | {"pedidos": tables["pedidos"].unionByName(tables["pedidos"].limit(1)).withColumn("status", F.lit("outro"))}
    rules = {(r.entity, r.rule) for r in checked(SOURCES, broken).collect()}
    assert {("pedidos", "unique id_pedido"), ("pedidos", "accepted status")} <= rules


# --- exact comparison ----------------------------------------------------------------------------------------

whole = st.integers(-(10**35), 10**35) | st.integers(-50, 50) | st.integers(-(10**19), 10**19)


def test_fractions_compare_exactly(spark):
    cases = []

    @settings(max_examples=150, deadline=None)
    @given(whole, whole, whole, whole, st.booleans())
    def collect(a, b, c, d, same):
        b, d = abs(b) + 1, abs(d) + 1
        cases.append((a, b, c, d))
        if same and abs(a) < 10**15 and b < 10**15:  # equal fractions, and neighbours of equal ones
            k = 10**18 + 7
            cases.extend([(a, b, a * k, b * k), (a, b, a * k - 1, b * k), (a, b, a * k + 1, b * k)])

    collect()
    df = spark.createDataFrame([tuple(map(str, c)) for c in cases], "a string, b string, c string, d string").select(*[F.col(x).cast("decimal(38,0)").alias(x) for x in "abcd"])
    got = df.select("a", "b", "c", "d", fraction_at_most(*[F.col(x) for x in "abcd"]).alias("ok")).collect()
    assert len(got) == len(cases) and all(r.ok == (Fraction(int(r.a), int(r.b)) <= Fraction(int(r.c), int(r.d))) for r in got)


def test_margin_erosion_of_any_size(spark, monkeypatch):
    """At 10^13 and 10^27: just at the threshold of three points counts, a ten-thousandth of a unit above it doesn't."""
    rows = []
    for k, size in enumerate((10**4, 10**13, 10**27)):
        for j, off in enumerate((0, 1)):  # in ten-thousandths; Python's decimals would round
            rows.append((10 * k + j, size, f"{size * 37 // 100}.{off:04d}", size, size * 40 // 100))
    df = spark.createDataFrame([(c, *map(str, m)) for c, *m in rows], "customer long, rev string, mar string, rev0 string, mar0 string")
    df = df.select("customer", *[F.col(c).cast("decimal(38,4)").alias(c) for c in ("rev", "mar", "rev0", "mar0")], F.lit("2026-02-01").cast("date").alias("month"), F.lit("2026-01-01").cast("date").alias("before"), F.lit(1).alias("gap"))
    monkeypatch.setattr(kpi, "_with_previous", lambda t: df)
    assert sorted(r.id_cliente for r in kpi.margin_erosion(None).collect()) == [0, 10, 20]


# --- positions -----------------------------------------------------------------------------------------------


def test_one_price_for_a_whole_month(spark):
    df = spark.range(20_000).select(F.lit("2026-01").alias("g"), F.col("id"), F.lit(Decimal("9.90")).cast("decimal(18,4)").alias("v")).unionByName(spark.range(50).select(F.lit("2026-02").alias("g"), "id", F.when(F.col("id") % 2 == 0, F.col("id").cast("decimal(18,4)")).alias("v")))
    found = ranks.running(df, "g", "v", "id", block=1000)
    rows = {r.id: r for r in found.where("g = '2026-01'").collect()}
    assert all(r._pos == i + 1 and r._cum == Decimal("9.90") * (i + 1) and r._n == 20_000 and r._total == Decimal("198000") for i, r in rows.items())
    second = sorted(found.where("g = '2026-02'").collect(), key=lambda r: r._pos)
    assert [r.id for r in second] == [*range(48, -1, -2), *range(1, 50, 2)] and second[-1]._cum == second[-1]._total  # nulls last
    dealt = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in found.inputFiles()})
    assert dealt.where("g = '2026-01'").groupBy("_lane").count().agg(F.max("count")).first()[0] < 3000
    assert ranks.running(df.where("false"), "g", "v", "id").count() == 0


# --- a refused batch -----------------------------------------------------------------------------------------


def test_a_refused_batch_leaves_nothing_in_memory(spark, tmp_path):
    engine = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    d = lambda c, rest: spark.createDataFrame([(1, "x")], f"{c} long, {rest} string")
    engine.load_dimensions({"clientes": d("id_cliente", "nome"), "vendedores": d("id_vendedor", "nome"), "produtos": d("id_produto", "nome")})
    event = dict.fromkeys(lakehouse.FIELDS) | {"id_evento": "e1", "entidade": "pedido", "id_registro": "1", "versao": "1", "atualizado_em": "2026-01-01T00:00:00Z", "id_cliente": "1", "id_vendedor": "1", "id_produto": "1", "quantidade": "2", "preco_unitario": "1.00", "data_documento": "2026-01-01", "data_prevista": "2026-02-01", "status": "aberto"}
    batch = lambda *events: spark.createDataFrame([tuple(e[c] for c in lakehouse.FIELDS) for e in events], lakehouse.EVENTS)
    assert engine.process(batch(event))["pedidos"] == 1
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    sold = event | {"id_evento": "e2", "entidade": "faturamento", "id_registro": "5", "id_referencia": "1", "quantidade": "3", "preco_unitario": None, "status": "faturado"}
    for bad in (event | {"quantidade": "9"}, event | {"id_evento": " "}, event | {"id_evento": "e9", "quantidade": "9"}, sold):
        with pytest.raises(ValueError):
            engine.process(batch(bad))
        assert kept() == before
    assert engine.runs().count() == 5
