"""What grows with months times customers, or with all events, isn't shuffled, sorted or kept: the plans at any size."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from commerce_spark.operators import changes, ranks, temporal
from commerce_spark.plans import documents, lakehouse, portfolio, views
from commerce_spark.plans.graph import GRAPH
from commerce_spark.plans.views import Tables


@pytest.fixture
def plain_plans(spark):
    """Plans as for tables too large to broadcast, and whole before they run."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def above(df, node: str) -> list[str]:
    """The operators from the first `node` of the plan up to its root."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    at = next(i for i, line in enumerate(lines) if node in line)
    found, reach = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < reach:
            found.append(line)
            reach = depth(line)
    return found


def test_months_are_made_last(spark, data, plain_plans):
    """no window or join of monthly rows; only of customers whose versions meet are months counted."""
    assert not [x for x in above(portfolio.monthly(Tables(spark, data)), "Generate ") if "Window" in x or "Join" in x]
    plan = portfolio.no_duplicates(Tables(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert any("Filter" in x and "_any" in x for x in plan.split("Generate ")[1].splitlines())


def test_inspection_holds_no_customers(spark, data, plain_plans):
    """months are counted by month alone; no aggregate has the customer in its key above the monthly rows."""
    over = above(portfolio.portfolio_inspection(Tables(spark, data)), "Generate ")
    assert not [x for x in over if "Window" in x or ("Aggregate" in x and "id_cliente" in x.split("functions=")[0])]


def test_checks_of_behaviour_keep_versions_only(spark, data):
    """what is written once for the three checks has a row a version, not one a month."""
    portfolio.behaviour_in_range(Tables(spark, data))
    assert [("compras" in df.columns, "competencia" in df.columns) for df in GRAPH.written] == [(True, False)]


def test_running_by_copies_equals_rows(spark):
    rows = [(g, v, n) for g in "ab" for v, n in ((5, 3), (0, 40), (-2, 1), (7, 2), (3, 9))]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    got = {(r.g, r.v): (r._pos, r._cum, r._n, r._total) for r in ranks.running(df, "g", "v", "n", block=3, copies="n").collect()}
    every = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    told = ranks.running(every, "g", "v", "k", block=7).groupBy("g", "v").agg(F.min("_pos").alias("p"), F.max(F.struct("_pos", "_cum")).alias("c"), F.max("_n").alias("n"), F.max("_total").alias("t"))
    assert got == {(r.g, r.v): (r.p, r.c._cum, r.n, r.t) for r in told.collect()}


def test_series_equal_windows(spark):
    """The portfolio and the behaviour by places in the series are those of windows over the rows, over a gap too."""
    ts = lambda c: F.col(c).cast("timestamp")
    history = [("1-a", 1, 10, "2025-01-01", "2025-04-10"), ("1-b", 1, 11, "2025-06-05", None), ("2-a", 2, 10, "2025-02-01", "2025-02-20"), ("2-b", 2, 12, "2025-02-20", None), ("3-a", 3, 12, "2024-01-01", "2025-09-01"), ("4-a", 4, 11, "2026-01-01", None)]
    h = spark.createDataFrame(history, "chave_cliente string, id_cliente long, id_vendedor long, valid_from string, valid_to string").withColumns({"valid_from": ts("valid_from"), "valid_to": ts("valid_to"), "regiao": F.lit("r"), "ativo": F.lit(True), "nome": F.lit("n")})
    sold = [(1, "2025-01-05"), (1, "2025-03-05"), (1, "2025-05-07"), (1, "2025-06-09"), (1, "2025-09-09"), (2, "2025-01-09"), (2, "2025-03-02"), (2, "2025-03-04"), (2, "2025-11-02"), (3, "2024-03-01"), (3, "2025-08-01"), (4, "2025-08-01")]
    fact = spark.createDataFrame([(c, d, 10 + k, "cancelado" if k == 6 else "faturado") for k, (c, d) in enumerate(sold)], "id_cliente long, d string, v long, status string")
    fact = fact.withColumn("competencia", F.trunc("d", "MM")).withColumn("receita", F.when(F.col("status") == "faturado", F.col("v")).otherwise(0).cast("decimal(38,4)"))
    t = Tables(spark, "", {"customer_history": h, "months": temporal.months(spark, "2025-01-01", "2025-12-01")})
    own = fact.groupBy("id_cliente", "competencia").agg(F.count_if(F.col("status") == "faturado").alias("n"), F.sum("receita").alias("r"))
    j = temporal.state_at_close(views.customer_history(t), views.months(t)).join(own, ["id_cliente", "competencia"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.coalesce("r", F.lit(0)))
    w = Window.partitionBy("id_cliente").orderBy("competencia")
    past, so_far, month = w.rowsBetween(-3, -1), w.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("n") > 0, F.col("competencia"))
    told = j.select("id_cliente", "competencia", "id_vendedor", "n", "r", F.coalesce(F.lag("n").over(w), F.lit(0)), F.min(month).over(Window.partitionBy("id_cliente")), F.count(F.lit(1)).over(past), F.max(month).over(so_far), F.sum("r").over(so_far), F.round(F.try_divide(F.sum("r").over(past).cast("double"), F.count(F.lit(1)).over(past)), 6))
    got = portfolio.comportamento(t, portfolio.carteira_versoes(t, fact)).select("id_cliente", "competencia", "id_vendedor", "pedidos_mes", "receita_mes", "pedidos_mes_anterior", "primeira_competencia", "meses_base", "ultima_competencia_compra", "receita_acumulada", "receita_media_3m_anteriores")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert [*map(list, key(got))] == [*map(list, key(told))]
    assert got.count() == 10 + 11 + 8


@pytest.mark.parametrize("plan", [portfolio.seller_months, portfolio.retention, portfolio.inspect_sellers], ids=lambda f: f.__name__)
def test_sellers_months_are_counted_where_they_are_made(spark, data, plain_plans, plan):
    """Monthly rows are whole sums before they are shuffled; versions went to their sellers before."""
    over = above(plan(Tables(spark, data)), "Generate ")
    first = next(i for i, x in enumerate(over) if "Exchange" in x)
    assert sum("HashAggregate" in x for x in over[:first]) == 2 and not [x for x in over if "Window" in x]


def test_conflicts_are_found_without_a_sort(spark):
    """contents are compared as numbers, which a hash aggregate holds; texts were sorted, and spilled."""
    df = spark.createDataFrame([(1, "a", None), (1, None, "a"), (2, "b", "c"), (2, "b", "c"), (3, None, None)], "k long, x string, y string")
    found = changes.conflicts(df, ["k"], ["x", "y"])
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString() and [r.k for r in found.collect()] == [1]


def test_repeats_of_ids(spark):
    """a batch of new ids isn't shuffled whole to leave out what came before; one that repeats an id is."""
    of = lambda *rows: spark.createDataFrame(rows, "id_evento string, hash_conteudo string")
    old, seen = of(("a", "1"), ("m", "2"), ("z", "3")), lakehouse.Lakehouse._repeats
    assert seen(old, of(("n", "1"), ("p", "1"))) == "new" and seen(old, of(("n", "1"), ("n", "1"))) == "again"
    assert seen(old, of(("m", "2"), ("b", "9"))) == "again" and seen(old, of(("z", "4"), ("b", "9"))) == "conflict" and seen(old, old.where("false")) == "new"


def test_events_are_not_joined_with_dimensions(spark):
    """dimensions too large to broadcast don't shuffle the events; only keys that they haven't meet them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        dims = {k: spark.range(1, 50_000).withColumnRenamed("id", f"id_{c}") for k, c in (("clientes", "cliente"), ("vendedores", "vendedor"), ("produtos", "produto"))}
        event = dict.fromkeys(lakehouse.FIELDS) | {"entidade": "pedido", "id_registro": "1", "versao": "1", "atualizado_em": "2026-01-01T00:00:00Z", "id_vendedor": "2", "id_produto": "3", "quantidade": "2", "preco_unitario": "1.00", "data_documento": "2026-01-01", "data_prevista": "2026-02-01", "status": "aberto"}
        rows = [event | {"id_evento": c, "id_cliente": c} for c in ("7", "0", "49999", "50000", None)]
        df = lakehouse.evaluate(spark.createDataFrame([tuple(r[c] for c in lakehouse.FIELDS) for r in rows], lakehouse.EVENTS), dims)
        assert "SortMergeJoin" not in df._jdf.queryExecution().sparkPlan().toString()
        assert {r.id_evento: r.reason for r in df.collect()} == {"7": None, "0": "pedido_invalido", "49999": None, "50000": "pedido_invalido", None: "pedido_invalido"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_events_of_tables_stay_typed(spark, data, plain_plans):
    """no text is made and parsed again, current events are sorted by numbers first, only what the quarantine asks is written."""
    last = documents.quarantine(Tables(spark, data))
    assert [df.columns for df in GRAPH.written[1:]] == [["id_evento", "entidade", "status", "chave", "revisao", "documento", "referencia", "reason"]] * 2
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*GRAPH.written, last]]
    assert not any("date_format" in p for p in plans)
    sorts = [x.split("Sort [")[1] for p in plans for x in p.splitlines() if "Sort [" in x and "revisao" in x]
    assert sorts and all(x.startswith("chave") for x in sorts)


def test_typed_events_equal_their_texts(spark):
    """events judged as they are, and after a way through texts as the engine takes them: keys, dates, quantities, prices
    that are missing, zero or unknown too."""
    day = "1999-02-27 00:00:00"
    rows = [(1, 1, "P", 10.5, day, "1-URGENT", 3, 1, 1, 2, day, 1, "1999-03-01 00:00:00"), (0, 1, "O", 1.0, day, "2-HIGH", 3, 1, 1, 3, day, 3, day), (2, 9, "O", 1.0, day, "5-LOW", 3, 1, 1, None, None, None, None), (3, 1, "P", None, day, "5-LOW", 3, 1, 1, 3, day, None, None)]
    rows += [(4, 1, "F", 0.0, day, None, 3, None, 1, 0, day, -1, day), (5, None, "F", 2.0, None, "1-URGENT", None, 1, 1, 3, None, 3, None), (None, 1, None, 2.0, day, "1-URGENT", 3, 1, 9, 3, day, 3, day), (6, 1, "F", 2.0, day, "5-LOW", None, None, None, None, None, None, None)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string, q long, seller long, product long, fq long, fd string, rq long, rd string"
    orders = spark.createDataFrame(rows, names).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("o_orderdate", "fd", "rd")})
    dims = {k: spark.range(1, 5).withColumnRenamed("id", f"id_{c}") for k, c in (("clientes", "cliente"), ("vendedores", "vendedor"), ("produtos", "produto"))}
    direct, texts = lakehouse.judge(documents.events(orders), dims), lakehouse.evaluate(lakehouse.raw(documents.events(orders)), dims)
    assert direct.dtypes == texts.dtypes
    got = sorted(map(tuple, direct.collect()), key=repr)
    assert got == sorted(map(tuple, texts.collect()), key=repr) and len(got) == 24
    assert {r.reason for r in direct.collect()} == {None, "identificador_versao_ou_data_invalida", "quantidade_invalida", "pedido_invalido"}
