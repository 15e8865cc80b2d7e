"""Published totals of the demonstration data."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from commerce_spark.plans import kpi, lakehouse, portfolio
from commerce_spark.plans.views import Tables
from commerce_spark.sources import generators


def test_demonstration_sales(spark):
    s = generators.demonstration_sales(spark)
    ok = s.where("status = 'invoiced'")
    r = ok.agg(F.sum("revenue"), F.sum("margin"), F.count_distinct("month"), F.count(F.lit(1))).first()
    assert (s.count(), r[3], r[2], r[0], r[1]) == (848, 827, 18, Decimal("3282277.00"), Decimal("1363789.70"))


def test_position_totals(spark):
    dims, every = generators.event_dimensions(spark), generators.event_batches(spark)
    bronze = every[0].unionByName(every[1]).unionByName(every[2]).dropDuplicates()
    at = lakehouse.Position(bronze, dims)
    orders, invoices, returns = (rows for _, rows in at.silver().values())
    p = lakehouse.order_position(orders, invoices, returns, "2026-09-30").cache()
    r = p.agg(*[F.sum(c) for c in ("valor_aberto", "valor_faturado", "valor_devolvido", "receita_apos_devolucao")], F.count(F.lit(1))).first()
    assert tuple(r) == (Decimal("17250.00"), Decimal("4170.00"), Decimal("195.00"), Decimal("3975.00"), 48)
    assert lakehouse.inconsistencies(p).isEmpty() and lakehouse.seller_summary(p).count() == 4
    rates = {r.categoria: (r.devolucoes, r.faturamento) for r in lakehouse.returns_by_category(p, dims["produtos"]).collect()}
    assert rates == {"Limpeza": (Decimal("130.00"), Decimal("2240.00")), "Alimentos": (Decimal("65.00"), Decimal("1930.00"))}
    top = lakehouse.open_orders(p, dims["clientes"], dims["vendedores"]).first()
    assert (top.id_pedido, top.valor_aberto, top.dias_atraso) == (39, Decimal("770.00"), 10)
    assert lakehouse.backlog_split(p).agg(F.sum("saldo_parcial")).first()[0] == Decimal("4935.00")
    assert at.quarantine().count() == 1 and bronze.count() == 90
    assert lakehouse.return_facts(orders, invoices, returns).count() == 6 and orders.count() == 48
    p.unpersist()


# Revenue, gross margin, active customers and entries of each month from 2025-04 on.
MONTHS = """
197737.5 84887.4 20 50
216213.5 93438.1 20 53
202839.5 85461.8 20 49
210898   82352.7 20 53
191046   77054.9 20 51
193350.5 85153.7 20 50
212277   88853   20 53
178401   76259.4 19 46
195301.5 80304.3 19 48
192802   72661.8 19 50
156943.5 66397.9 19 41
180876   77354   19 45
162660.5 66346.9 19 43
173352.5 74392   17 41
147966.5 55698.7 17 39
164649   70575.9 17 40
159672   62239.4 17 39
145290.5 64357.8 17 36
"""


def test_monthly_indicators_of_the_demonstration_sales(spark):
    """All columns of all 18 months: four as published, the others from them by their definitions."""
    t = Tables(spark, "", {"sales": generators.demonstration_sales(spark), "targets": generators.demonstration_targets(spark)})
    rows = sorted((r.asDict() for r in kpi.executive(t).collect()), key=lambda r: r["mes_referencia"])
    want = [tuple(map(float, line.split())) for line in MONTHS.strip().splitlines()]
    assert len(rows) == 18
    for i, (r, (rev, mar, cust, ent)) in enumerate(zip(rows, want, strict=True)):
        goal, before, year = 530000 + 10000 * i, want[i - 1][0] if i else None, want[i - 12][0] if i >= 12 else None
        assert r["mes_referencia"].isoformat() == f"{2025 + (i + 3) // 12}-{(i + 3) % 12 + 1:02}-01"
        assert (r["faturamento"], r["margem_bruta"], r["clientes_ativos"], r["quantidade_lancamentos"], r["valor_meta"], r["gap_meta"]) == (rev, mar, cust, ent, goal, goal - rev)
        assert (r["faturamento_mes_anterior"], r["faturamento_ano_anterior"], r["status_meta"]) == (before, year, "Risco")
        near = lambda x, y: x is None and y is None or abs(x - y) < 1e-6
        assert near(r["percentual_margem"], mar / rev) and near(r["ticket_medio"], rev / ent) and near(r["percentual_atingimento_meta"], rev / goal)
        assert near(r["crescimento_mom"], before and rev / before - 1) and near(r["crescimento_yoy"], year and rev / year - 1)


def test_demonstration_portfolio(spark):
    """Totals, sellers, states and alerts as published."""
    given = generators.demonstration_portfolio(spark)
    t = Tables(spark, "", given)
    facts = portfolio._fact(t).cache()
    assert (given["orders"].count(), given["items"].count(), given["customer_history"].count(), facts.where("status = 'cancelado'").count()) == (1234, 2466, 123, 46)
    assert facts.agg(F.sum("receita")).first()[0] == Decimal("849439.8000")
    by = {r.id_vendedor: str(r.v) for r in facts.groupBy("id_vendedor").agg(F.sum("receita").cast("decimal(18,2)").alias("v")).collect()}
    assert [by[i] for i in range(1, 7)] == ["162187.50", "159141.05", "144264.40", "129864.80", "117290.30", "136691.75"]
    months = portfolio._portfolio(t).cache()
    states = {r.situacao_compra: r["count"] for r in months.groupBy("situacao_compra").count().collect()}
    assert states == {"novo": 120, "recorrente": 871, "reativado": 196, "sem_compra": 253} and months.where("retido").count() == 871
    assert {r.id_pedido: r.id_vendedor for r in facts.where("id_pedido > 900000").collect()} == {900001: 1, 900002: 2}
    top = {r.competencia.month: round(100 * r.participacao_top_20pct, 2) for r in portfolio.revenue_concentration(t).collect()}
    assert (top[9], top[12]) == (49.18, 59.66)
    december = portfolio._behaviour(t).where("competencia = date'2025-12-01' and sinal_atencao = 'queda_receita'")
    assert (december.count(), december.where("pedidos_mes > 0").count()) == (34, 14)
    for df in (facts, months):
        df.unpersist()
