"""Commercial indicators: executive series, concentration, life cycle, ABC, sellers, forecasts, early warnings, targets.

Rules are parameters whose defaults are the demonstration values. Thresholds are compared on exact decimals, by
cross-multiplication; results carry doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import fraction_at_most, lower_bound_at_zero, months_between, ratio, real
from commerce_spark.operators import ranks, temporal

from . import views
from .views import Tables

WIDE = "decimal(38,4)"


def _counted(s: DataFrame, by: list[str]) -> DataFrame:
    """Revenue, margin, customers and entries by some columns. An entry has one customer, so both are counted by
    narrowing aggregates, without the copies of rows that several distinct counts in one aggregate make."""
    e = s.groupBy(*by, "customer", "entry").agg(F.sum("revenue").alias("rev"), F.sum("margin").alias("mar"))
    c = e.groupBy(*by, "customer").agg(F.sum("rev").alias("rev"), F.sum("mar").alias("mar"), F.count(F.lit(1)).alias("ent"))
    return c.groupBy(*by).agg(F.sum("rev").cast(WIDE).alias("rev"), F.sum("mar").cast(WIDE).alias("mar"), F.count(F.lit(1)).alias("cust"), F.sum("ent").alias("ent"))


def executive(t: Tables, met: int = 100, near: int = 90) -> DataFrame:
    """K1: the monthly executive series against its targets, with month-on-month and year-on-year growth."""
    v = _counted(views.invoiced(t), ["month"])
    goal = views.targets(t).groupBy("month").agg(F.sum("target").alias("goal"))
    w = Window.orderBy("month")  # one row a month
    s = v.join(goal, "month", "left").withColumn("m1", F.lag("rev", 1).over(w)).withColumn("m12", F.lag("rev", 12).over(w))
    share = F.col("rev") * 100
    return s.select(
        F.col("month").alias("mes_referencia"), real(F.col("rev")).alias("faturamento"), real(F.col("mar")).alias("margem_bruta"), ratio(F.col("mar"), F.col("rev")).alias("percentual_margem"),
        F.col("cust").alias("clientes_ativos"), F.col("ent").alias("quantidade_lancamentos"), ratio(F.col("rev"), F.col("ent"), 9).alias("ticket_medio"), real(F.col("goal")).alias("valor_meta"),
        ratio(F.col("rev"), F.col("goal")).alias("percentual_atingimento_meta"), real((F.col("goal") - F.col("rev")).cast(WIDE)).alias("gap_meta"), real(F.col("m1")).alias("faturamento_mes_anterior"),
        real(F.col("m12")).alias("faturamento_ano_anterior"), ratio((F.col("rev") - F.col("m1")).cast(WIDE), F.col("m1")).alias("crescimento_mom"), ratio((F.col("rev") - F.col("m12")).cast(WIDE), F.col("m12")).alias("crescimento_yoy"),
        F.when(share >= F.col("goal") * met, "Meta atingida").when(share >= F.col("goal") * near, "Atenção").otherwise("Risco").alias("status_meta"),
    )


def _by_customer(t: Tables) -> DataFrame:
    return views.invoiced(t).groupBy("month", "customer").agg(F.sum("revenue").cast(WIDE).alias("rev"), F.sum("margin").cast(WIDE).alias("mar"))


def concentration(t: Tables, small: int = 5, large: int = 10) -> DataFrame:
    """K2: the share of the largest customers of each month."""
    r = _by_customer(t)
    w = Window.partitionBy("month").orderBy(F.desc("rev"), "customer")
    first = r.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= large)  # partitions send their first rows only
    top = lambda n: F.sum(F.when(F.col("pos") <= n, F.col("rev")))
    tops = first.groupBy("month").agg(top(small).alias("small"), top(large).alias("large"))
    m = r.groupBy("month").agg(F.sum("rev").alias("total")).join(tops, "month")
    return m.select(F.col("month").alias("mes_referencia"), ratio(F.col("small"), F.col("total")).alias("participacao_top5"), ratio(F.col("large"), F.col("total")).alias("participacao_top10"))


def management_signals(t: Tables) -> DataFrame:
    """K3: a signal with severity and text for each month that has a target."""
    e = executive(t).where("valor_meta is not null")
    severity = F.when(F.col("status_meta") == "Risco", "ALTO").when(F.col("status_meta") == "Atenção", "MEDIO").otherwise("OK")
    share = F.round((F.col("percentual_atingimento_meta") * 100).cast("decimal(18,4)"), 1).cast("decimal(18,1)").cast("string")
    return e.select("mes_referencia", F.lit("META").alias("tipo_sinal"), severity.alias("severidade"), F.concat(F.lit("Atingimento da meta: "), share, F.lit("%")).alias("descricao"))


def _with_previous(t: Tables) -> DataFrame:
    w = Window.partitionBy("customer").orderBy("month")
    s = _by_customer(t)
    return s.withColumn("before", F.lag("month").over(w)).withColumn("rev0", F.lag("rev").over(w)).withColumn("mar0", F.lag("mar").over(w)).withColumn("gap", months_between(F.col("month"), F.col("before")))


def life_cycle(t: Tables, dormant: int = 3) -> DataFrame:
    """K4: new, reactivated (after `dormant` months or more) or active customers by month."""
    state = F.when(F.col("before").isNull(), "NOVO").when(F.col("gap") >= dormant, "REATIVADO").otherwise("ATIVO")
    return _with_previous(t).select(F.col("month").alias("mes_referencia"), F.col("customer").alias("id_cliente"), real(F.col("rev")).alias("faturamento"), real(F.col("mar")).alias("margem_bruta"), state.alias("status_cliente"), F.col("gap").alias("meses_desde_ultima_compra"), ratio((F.col("rev") - F.col("rev0")).cast(WIDE), F.col("rev0")).alias("variacao_ultima_compra"))


def inactive(t: Tables, days: int = 90) -> DataFrame:
    """K5: customers whose last purchase lies `days` or more before the last sale of all."""
    s = views.invoiced(t)
    last = s.agg(F.max("sale_date").alias("ref"))
    c = s.groupBy("customer").agg(F.max("sale_date").alias("last"), F.sum("revenue").alias("rev")).crossJoin(F.broadcast(last))  # one row
    return c.withColumn("dias", F.datediff("ref", "last")).where(F.col("dias") >= days).select(F.col("customer").alias("id_cliente"), F.col("last").alias("data_ultima_compra"), F.col("dias").alias("dias_sem_compra"), real(F.col("rev")).alias("faturamento_historico"))


def abc(t: Tables, a: int = 80, b: int = 95) -> DataFrame:
    """K6: ABC class of each customer and month by cumulative share; the customer that crosses a border is past it."""
    r = ranks.running(_by_customer(t), "month", "rev", "customer").withColumn("cum", F.col("_cum")).withColumn("total", F.col("_total").cast(WIDE))
    mark = F.when(F.col("cum") * 100 <= F.col("total") * a, "A").when(F.col("cum") * 100 <= F.col("total") * b, "B").otherwise("C")
    return r.select(F.col("month").alias("mes_referencia"), F.col("customer").alias("id_cliente"), real(F.col("rev")).alias("faturamento_cliente"), ratio(F.col("rev"), F.col("total")).alias("participacao"), ratio(F.col("cum"), F.col("total")).alias("participacao_acumulada"), mark.alias("curva_abc"))


def sellers(t: Tables) -> DataFrame:
    """K7: sellers' months with targets and dense ranks of revenue and margin."""
    v = _counted(views.invoiced(t), ["month", "seller"])
    r = v.join(views.targets(t), ["month", "seller"], "left").withColumn("pct", ratio(F.col("mar"), F.col("rev")))
    w = Window.partitionBy("month")
    return r.select(
        F.col("month").alias("mes_referencia"), F.col("seller").alias("id_vendedor"), real(F.col("rev")).alias("faturamento"), real(F.col("mar")).alias("margem_bruta"), F.col("pct").alias("percentual_margem"), F.col("cust").alias("clientes_ativos"),
        F.col("ent").alias("quantidade_lancamentos"), ratio(F.col("rev"), F.col("ent"), 9).alias("ticket_medio"), real(F.col("target")).alias("valor_meta"), ratio(F.col("rev"), F.col("target")).alias("percentual_atingimento_meta"), real((F.col("target") - F.col("rev")).cast(WIDE)).alias("gap_meta"),
        F.dense_rank().over(w.orderBy(F.desc_nulls_last("rev"))).alias("ranking_faturamento"), F.dense_rank().over(w.orderBy(F.desc_nulls_last("pct"))).alias("ranking_margem"),
    )


def forecast_accuracy(t: Tables) -> DataFrame:
    """K8: forecasts against complete months; the last month of any status is incomplete."""
    s = views.sales(t)
    last = s.agg(F.max("month").alias("last"))
    real_ = s.where("status = 'invoiced'").groupBy("month").agg(F.sum("revenue").cast(WIDE).alias("rev"))
    r = views.forecasts(t).join(real_, "month").crossJoin(F.broadcast(last)).where("month < last")  # one row
    error = F.abs((F.col("forecast") - F.col("rev")).cast(WIDE))
    ape = ratio(error, F.col("rev"))
    return r.select(F.col("issued").alias("data_previsao"), F.col("month").alias("mes_referencia"), F.col("horizon").alias("horizonte_dias"), real(F.col("forecast")).alias("valor_previsto"), real(F.col("rev")).alias("valor_realizado"), real(error).alias("erro_absoluto"), ape.alias("erro_percentual_absoluto"), F.round(lower_bound_at_zero(1 - ape), 6).alias("acuracia_previsao"))


def shrinking(t: Tables, percent: int = 20) -> DataFrame:
    """K9: consecutive months in which a customer's revenue fell by `percent` or more."""
    r = _with_previous(t).where((F.col("gap") == 1) & (F.col("rev0") > 0) & (F.col("rev") * 100 <= F.col("rev0") * (100 - percent)))
    return r.select(F.col("month").alias("mes_referencia"), F.col("customer").alias("id_cliente"), real(F.col("rev")).alias("faturamento"), real(F.col("mar")).alias("margem_bruta"), F.col("before").alias("mes_anterior"), real(F.col("rev0")).alias("faturamento_anterior"), real(F.col("mar0")).alias("margem_anterior"), ratio((F.col("rev") - F.col("rev0")).cast(WIDE), F.col("rev0")).alias("variacao_faturamento"), ratio((F.col("mar") - F.col("mar0")).cast(WIDE), F.col("mar0")).alias("variacao_margem"))


def margin_erosion(t: Tables, points: int = 3) -> DataFrame:
    """Consecutive months with steady or more revenue and a margin lower by `points` percent points or more."""
    rate, rate0 = ratio(F.col("mar"), F.col("rev")), ratio(F.col("mar0"), F.col("rev0"))
    drop = rate.cast("decimal(18,6)") - rate0.cast("decimal(18,6)")
    parts = lambda c: (F.col(c).cast(WIDE) * 10_000).cast("decimal(38,0)")
    fell = fraction_at_most(parts("mar") * 100 + parts("rev") * points, parts("rev"), parts("mar0") * 100, parts("rev0"))
    r = _with_previous(t).where((F.col("gap") == 1) & (F.col("rev0") > 0) & (F.col("rev") >= F.col("rev0")) & fell)
    return r.select(F.col("month").alias("mes_referencia"), F.col("customer").alias("id_cliente"), real(F.col("rev")).alias("faturamento"), rate.alias("percentual_margem"), F.col("before").alias("mes_anterior"), real(F.col("rev0")).alias("faturamento_anterior"), rate0.alias("margem_anterior"), real(drop).alias("variacao_pontos_margem"))


def _tenths(c: Column) -> Column:
    return F.round(F.abs(c.cast("decimal(18,6)") * 100), 1).cast("decimal(18,1)").cast("string")


def intelligence(t: Tables) -> DataFrame:
    """Shrinking customers and eroding margins as one list of signals."""
    a = shrinking(t).select("mes_referencia", F.col("id_cliente").cast("string").alias("entidade"), F.lit("RETRACAO").alias("tipo_sinal"), F.lit("ALTO").alias("severidade"), F.concat(F.lit("Faturamento caiu "), _tenths(F.col("variacao_faturamento")), F.lit("% versus a compra/mês anterior.")).alias("descricao"))
    b = margin_erosion(t).select("mes_referencia", F.col("id_cliente").cast("string").alias("entidade"), F.lit("EROSAO_MARGEM").alias("tipo_sinal"), F.lit("MEDIO").alias("severidade"), F.concat(F.lit("Margem caiu "), _tenths(F.col("variacao_pontos_margem")), F.lit(" p.p. com receita estável/crescente.")).alias("descricao"))
    return a.unionByName(b)


def totals(t: Tables) -> DataFrame:
    """Counts, invoiced totals and the range of dates of all sales."""
    ok = F.col("status") == "invoiced"
    return views.sales(t).agg(F.count(F.lit(1)).alias("lancamentos"), F.count_if(ok).alias("lancamentos_faturados"), real(F.sum(F.when(ok, F.col("revenue")))).alias("faturamento"), real(F.sum(F.when(ok, F.col("margin")))).alias("margem_bruta"), F.min("sale_date").alias("primeira_venda"), F.max("sale_date").alias("ultima_venda"))


def calendar(t: Tables) -> DataFrame:
    """The daily calendar."""
    return temporal.days(t.spark, "2025-01-01", "2028-12-31")


def entries(t: Tables) -> DataFrame:
    """One sale a line with revenue, cost and margin."""
    s = views.sales(t)
    return s.select(F.col("entry").alias("id_lancamento"), "l_linenumber", F.col("sale_date").alias("data_venda"), F.col("customer").alias("id_cliente"), F.col("product").alias("id_produto"), F.col("seller").alias("id_vendedor"), F.col("quantity").alias("quantidade"), real(F.col("revenue")).alias("valor_faturamento"), real(F.col("cost")).alias("valor_custo"), real(F.col("margin")).alias("valor_margem_bruta"), ratio(F.col("margin"), F.col("revenue")).alias("percentual_margem_bruta"), "status")


def revenue_and_targets(t: Tables) -> DataFrame:
    """Each seller's months of sales or targets, both aggregated before they meet."""
    s = views.invoiced(t).groupBy("month", "seller").agg(F.sum("revenue").alias("rev"))
    j = s.join(views.targets(t), ["month", "seller"], "full").join(t.supplier.select(F.col("s_suppkey").alias("seller"), "s_name"), "seller")
    rev = F.coalesce("rev", F.lit(0))
    return j.select(F.col("seller").alias("id_vendedor"), F.col("s_name").alias("nome"), F.col("month").alias("competencia"), real(rev).alias("receita_liquida"), real(F.col("target")).alias("valor_meta"), ratio(rev, F.col("target")).alias("atingimento_meta"))


def _vintage(t: Tables) -> DataFrame:
    """Months of sellers: entries, cancelled, revenue, and returns booked in the month of their sale; last 12 months."""
    s = views.sales(t).groupBy("month", "seller").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.sum(F.when(F.col("status") == "invoiced", F.col("revenue")).otherwise(0)).cast(WIDE).alias("rev"))
    back = views.returns(t).where("not cancelled").groupBy("month", "seller").agg(F.sum("value").cast(WIDE).alias("back"))
    s = s.join(back, ["month", "seller"], "left").withColumn("after", (F.col("rev") - F.coalesce("back", F.lit(0))).cast(WIDE))
    j = s.join(views.targets(t), ["month", "seller"], "full").join(t.supplier.select(F.col("s_suppkey").alias("seller"), "s_name", "s_nationkey"), "seller")
    j = j.join(F.broadcast(t.nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return temporal.half_open(j, "month", "2000-08-01", "2001-08-01")


def performance(t: Tables) -> DataFrame:
    """Vintage performance; attainment is null without sales."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _vintage(t).select(F.col("month").alias("competencia"), F.col("s_name").alias("nome"), F.col("n_name").alias("regiao"), zero("n").alias("lancamentos"), zero("cancelled").alias("cancelados"), real(zero("rev")).alias("receita_liquida_ativa"), real(zero("back")).alias("valor_devolvido"), real(zero("after")).alias("receita_apos_devolucoes"), real(F.col("target")).alias("valor_meta"), ratio(F.col("after"), F.col("target")).alias("atingimento_meta"))


def performance_percent(t: Tables) -> DataFrame:
    """As K16 with attainment in percent, 0 without sales."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    pct = F.round(ratio(zero("after"), F.col("target"), 12) * 100, 2)
    return _vintage(t).select(F.col("month").alias("competencia"), F.col("s_name").alias("nome"), zero("n").alias("lancamentos"), real(zero("after")).alias("receita_apos_devolucoes"), real(F.col("target")).alias("valor_meta"), pct.alias("atingimento_meta_pct"))


def base_counts(t: Tables) -> DataFrame:
    """Rows of each entity."""
    named = {"vendedores": t.supplier, "clientes": t.customer, "produtos": t.part, "vendas": t.lineitem, "devolucoes": views.returns(t), "metas": views.targets(t)}
    parts = [df.agg(F.count(F.lit(1)).alias("registros")).select(F.lit(k).alias("entidade"), "registros") for k, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def base_totals(t: Tables) -> DataFrame:
    """Entries, distinct keys, cancelled, active revenue, returned value."""
    back = views.returns(t).agg(real(F.sum("value")).alias("valor_devolvido"))
    s = views.sales(t).agg(F.count(F.lit(1)).alias("lancamentos"), F.count_distinct("entry").alias("chaves_distintas"), F.count_if(F.col("status") == "cancelled").alias("cancelados"), real(F.sum(F.when(F.col("status") == "invoiced", F.col("revenue")))).alias("receita_liquida_ativa"))
    return s.crossJoin(F.broadcast(back))  # one row each
