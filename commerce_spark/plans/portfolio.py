"""Customer portfolio: facts with as-of attribution, the dense monthly portfolio, retention, cohorts, alerts, checks.

The models say what they need (`graph`), so that a fact with several readers in a query is built once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import months_between, ratio, real
from commerce_spark.operators import ranks, temporal

from . import views
from .graph import GRAPH
from .views import FIRST_MONTH, LAST_MONTH, Tables

WIDE = "decimal(38,4)"
CLOSE = "2001-07-01"


def _money(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, for results."""
    return df.select(*[real(F.col(c)).alias(c) if k.startswith("decimal") else F.col(c) for c, k in df.dtypes])


@GRAPH.model("intermediario")
def int_pedidos(t: Tables) -> DataFrame:
    """Orders with the sums of their items."""
    i = views.items(t).groupBy("id_pedido").agg(F.count(F.lit(1)).alias("itens"), F.sum("quantidade").alias("quantidade"), *[F.sum(c).cast(WIDE).alias(c) for c in ("valor_bruto", "valor_desconto", "valor_liquido")])
    return views.orders(t).join(i, "id_pedido")


def orders(t: Tables) -> DataFrame:
    """Orders with the sums of their items; orders without items aren't there."""
    return _money(int_pedidos(t)).select("id_pedido", "id_cliente", F.col("emitido_em").cast("timestamp_ntz").alias("emitido_em"), "status", "itens", "quantidade", "valor_bruto", "valor_desconto", "valor_liquido")


@GRAPH.model("comercial", "int_pedidos", by=("competencia",), sort=("id_cliente",))
def fato_pedidos(t: Tables, orders: DataFrame) -> DataFrame:
    """Orders with the seller and region in force, their month and revenue."""
    f = temporal.as_of(orders, views.customer_history(t), "id_cliente", "emitido_em", ["chave_cliente", "id_vendedor", "regiao"])
    return f.withColumn("competencia", F.trunc("emitido_em", "MM")).withColumn("receita", F.when(F.col("status") == "faturado", F.col("valor_liquido")).otherwise(0).cast(WIDE))


def _fact(t: Tables) -> DataFrame:
    return GRAPH.run(t, "fato_pedidos")[0]


def order_facts(t: Tables) -> DataFrame:
    """Orders with the seller and region in force when they were issued; cancelled orders earn nothing."""
    return _money(_fact(t)).select("id_pedido", "id_cliente", "chave_cliente", "id_vendedor", "regiao", F.col("emitido_em").cast("timestamp_ntz").alias("emitido_em"), "competencia", "status", "itens", "quantidade", "valor_bruto", "valor_desconto", "valor_liquido", "receita")


@GRAPH.model("comercial", "fato_pedidos", by=("competencia",), sort=("id_pedido",))
def fato_itens(t: Tables, fact: DataFrame) -> DataFrame:
    """Items with their order's attribution."""
    f = fact.select("id_pedido", "id_cliente", "id_vendedor", "competencia", "emitido_em", "status")
    return views.items(t).join(f, "id_pedido").withColumn("receita", F.when(F.col("status") == "faturado", F.col("valor_liquido")).otherwise(0).cast("decimal(18,4)"))


def _items(t: Tables) -> DataFrame:
    return GRAPH.run(t, "fato_itens")[0]


def item_facts(t: Tables) -> DataFrame:
    """Items with their order's attribution."""
    return _money(_items(t)).select("id_item", "id_pedido", "id_cliente", "id_vendedor", "competencia", "status", "id_produto", "quantidade", "valor_bruto", "valor_desconto", "valor_liquido", "receita")


@GRAPH.model("dm", "fato_pedidos", sort=("id_cliente",))
def carteira_versoes(t: Tables, fact: DataFrame) -> DataFrame:
    """One row a customer version that is in force at some close: its months from inicio to fim, the customer's rows in
    the series before them (antes), and all the customer's months with invoiced orders (compras), each with its place in the
    series (linha) and the revenue so far.

    The monthly rows are made from this (`_months`) where they are read: they are many times as many, and shuffling,
    sorting or keeping them is what a task has no room for.
    """
    own = fact.where("status = 'faturado' and competencia is not null").groupBy("id_cliente", "competencia").agg(F.count(F.lit(1)).alias("pedidos"), F.coalesce(F.sum("receita").cast(WIDE), F.lit(0).cast(WIDE)).alias("receita"))
    own = own.groupBy("id_cliente").agg(F.collect_list(F.struct("competencia", "pedidos", "receita")).alias("_own"))  # a row a month at most
    h = temporal.spans_at_close(views.customer_history(t), views.months(t)).select("id_cliente", "chave_cliente", "id_vendedor", "regiao", "ativo", "inicio", "fim")
    whole = Window.partitionBy("id_cliente")
    earlier = whole.orderBy("inicio", "fim", "chave_cliente").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("antes", F.coalesce(F.sum(months_between(F.col("fim"), F.col("inicio")) + 1).over(earlier), F.lit(0)).cast("int"))
    inside = F.filter("_own", lambda x: x["competencia"].between(F.col("inicio"), F.col("fim")))
    placed = F.transform(inside, lambda x: F.struct((F.col("antes") + months_between(x["competencia"], F.col("inicio")) + 1).alias("linha"), x["competencia"].alias("competencia"), x["pedidos"].alias("pedidos"), x["receita"].alias("receita")))
    v = h.join(own, "id_cliente", "left").withColumn("_mine", placed).withColumn("_all", F.array_sort(F.flatten(F.collect_list("_mine").over(whole)))).drop("_own", "_mine")
    so_far = lambda x: F.aggregate(F.filter("_all", lambda y: y["linha"] <= x["linha"]), F.lit(0).cast(WIDE), lambda a, y: (a + y["receita"]).cast(WIDE))
    v = v.withColumn("compras", F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in ("linha", "competencia", "pedidos", "receita")], so_far(x).alias("acumulada"))))
    return v.withColumn("primeira_competencia", F.array_min(F.transform("_all", lambda x: x["competencia"]))).drop("_all")


def _months(versions: DataFrame) -> DataFrame:
    """The months of each version, with their place in the customer's series (_linha) and its purchases by place (_por_linha)."""
    by_place = F.map_from_entries(F.transform("compras", lambda x: F.struct(x["linha"], F.struct(x["pedidos"].alias("pedidos"), x["receita"].alias("receita")))))
    e = versions.withColumn("_por_linha", by_place).select("*", F.posexplode(F.sequence("inicio", "fim", F.expr("interval 1 month"))).alias("_i", "competencia"))
    return e.withColumn("_linha", F.col("antes") + F.col("_i") + 1)


def _at(place: Column, name: str, kind: str) -> Column:
    return F.coalesce(F.col("_por_linha")[place][name], F.lit(0)).cast(kind)


def _dense(months: DataFrame, *more: str) -> DataFrame:
    """The rows of the portfolio by `_months`, and `more` of its columns."""
    j = months.withColumns({"pedidos_mes": _at(F.col("_linha"), "pedidos", "long"), "receita_mes": _at(F.col("_linha"), "receita", WIDE), "pedidos_mes_anterior": _at(F.col("_linha") - 1, "pedidos", "long")})
    now, before = F.col("pedidos_mes") > 0, F.col("pedidos_mes_anterior") > 0
    state = F.when(~now, "sem_compra").when(F.col("primeira_competencia") == F.col("competencia"), "novo").when(before, "recorrente").otherwise("reativado")
    return j.select(
        "id_cliente", "competencia", "chave_cliente", "id_vendedor", "regiao", "ativo", "pedidos_mes", "receita_mes", "pedidos_mes_anterior", "primeira_competencia", state.alias("situacao_compra"), (now & before).alias("retido"), *more
    )


@GRAPH.model("comercial", "carteira_versoes", by=("competencia",), sort=("id_cliente",))
def carteira_mensal(t: Tables, versions: DataFrame) -> DataFrame:
    """Customer x month by state at close, with invoiced orders of this month and the last: the row before in the customer's
    series."""
    return _dense(_months(versions))


def _portfolio(t: Tables) -> DataFrame:
    return GRAPH.run(t, "carteira_mensal")[0]


def monthly(t: Tables) -> DataFrame:
    """The dense monthly portfolio."""
    return _portfolio(t).select("id_cliente", "chave_cliente", "id_vendedor", "regiao", "ativo", "competencia", "pedidos_mes", "pedidos_mes_anterior", "primeira_competencia", "situacao_compra", "retido")


@GRAPH.model("comercial", "carteira_versoes", "fato_pedidos", by=("competencia",), sort=("id_vendedor",))
def carteira_vendedores(t: Tables, versions: DataFrame, fact: DataFrame) -> DataFrame:
    """Sellers' portfolios at close, with what they sold. Versions go to their sellers before they become months."""
    c = F.count_if
    own = versions.select("id_cliente", "chave_cliente", "id_vendedor", "regiao", "ativo", "inicio", "fim", "antes", "compras", "primeira_competencia").repartition("id_vendedor")
    p = _dense(_months(own)).groupBy("competencia", "id_vendedor").agg(
        F.count(F.lit(1)).alias("clientes_carteira"), c("ativo").alias("clientes_cadastro_ativo"), *[c(F.col("situacao_compra") == k).alias(n) for k, n in (("novo", "clientes_novos"), ("recorrente", "clientes_recorrentes"), ("reativado", "clientes_reativados"), ("sem_compra", "clientes_sem_compra"))],
        c("retido").alias("clientes_retidos"), c(F.col("pedidos_mes_anterior") > 0).alias("clientes_com_compra_anterior"),
    )
    sold = fact.groupBy("competencia", "id_vendedor").agg(F.sum("receita").cast(WIDE).alias("receita"), c(F.col("status") == "faturado").alias("pedidos_faturados"))
    names = t.supplier.select(F.col("s_suppkey").alias("id_vendedor"), F.col("s_name").alias("nome"))
    return p.join(names, "id_vendedor").join(sold, ["competencia", "id_vendedor"], "left").withColumn("receita", F.coalesce("receita", F.lit(0)).cast(WIDE)).withColumn("pedidos_faturados", F.coalesce("pedidos_faturados", F.lit(0))).withColumn("retencao_pct", F.round(F.try_divide(F.col("clientes_retidos") * 100.0, F.col("clientes_com_compra_anterior")), 2))


def seller_months(t: Tables) -> DataFrame:
    """sellers' portfolios at close, with the revenue that they sold."""
    return _money(GRAPH.run(t, "carteira_vendedores")[0])


@GRAPH.model("comercial", "carteira_versoes", by=("competencia",), sort=("id_cliente",))
def comportamento(t: Tables, versions: DataFrame) -> DataFrame:
    """Trailing means, recency and one alert for each customer and month."""
    place = F.col("_linha")
    d = _dense(_months(versions), "_linha", "_por_linha", "compras")
    before = sum((_at(place - k, "receita", WIDE) for k in (2, 3)), _at(place - 1, "receita", WIDE))
    d = d.withColumn("_last", F.try_element_at(F.filter("compras", lambda x: x["linha"] <= place), F.lit(-1)))
    d = d.withColumn("_sum3", F.when(place > 1, before.cast(WIDE))).withColumn("meses_base", F.least(place - 1, F.lit(3)).cast("long")).withColumn("ultima_competencia_compra", F.col("_last.competencia")).withColumn("receita_acumulada", F.coalesce(F.col("_last.acumulada"), F.lit(0)).cast(WIDE)).drop("_linha", "_por_linha", "compras", "_last")
    idle = months_between(F.col("competencia"), F.col("ultima_competencia_compra"))
    mean = F.round(F.try_divide(F.col("_sum3").cast("double"), F.col("meses_base").cast("double")), 6)
    alert = (
        F.when(~F.col("ativo"), "cadastro_inativo").when(F.col("meses_base") < 3, "historico_insuficiente").when(F.col("ultima_competencia_compra").isNull(), "sem_compra_observada").when(idle >= 2, "ausencia_prolongada")
        .when((F.col("_sum3") > 0) & (F.col("receita_mes") * F.col("meses_base") * 2 < F.col("_sum3")), "queda_receita").otherwise("sem_alerta")
    )
    change = F.round(F.try_divide(F.col("receita_mes").cast("double") * F.col("meses_base"), F.col("_sum3").cast("double")) - 1, 6)
    return d.withColumn("receita_media_3m_anteriores", mean).withColumn("ticket_medio", ratio(F.col("receita_mes"), F.col("pedidos_mes"), 9)).withColumn("variacao_vs_base", change).withColumn("meses_sem_compra", idle).withColumn("sinal_atencao", alert).drop("_sum3")


def _behaviour(t: Tables) -> DataFrame:
    return GRAPH.run(t, "comportamento")[0]


def behaviour(t: Tables) -> DataFrame:
    """Trailing means, recency and one alert by fixed precedence for each customer and month."""
    return _money(_behaviour(t)).drop("regiao", "primeira_competencia", "situacao_compra", "retido", "pedidos_mes_anterior")


def cohorts(t: Tables) -> DataFrame:
    """Buyers of each first-purchase cohort by month."""
    return _cohorts(_portfolio(t))


def _cohorts(portfolio: DataFrame) -> DataFrame:
    b = portfolio.where("competencia >= primeira_competencia")
    g = b.groupBy(F.col("primeira_competencia").alias("coorte"), "competencia").agg(F.count(F.lit(1)).alias("clientes_coorte"), F.count_if(F.col("pedidos_mes") > 0).alias("compradores"), F.sum("receita_mes").alias("receita"))
    return _money(g.withColumn("idade_coorte_meses", months_between(F.col("competencia"), F.col("coorte"))).withColumn("taxa_compra", ratio(F.col("compradores"), F.col("clientes_coorte"))))


def revenue_concentration(t: Tables, tenths: int = 2) -> DataFrame:
    """The share of the top 20 % of customers, and the Herfindahl index; null in a month without revenue."""
    return _concentration(_portfolio(t), tenths)


def _concentration(portfolio: DataFrame, tenths: int = 2) -> DataFrame:
    """Customers of one revenue are one row with their number: most bought nothing, and which of equal ones comes first
    changes no sum."""
    own = portfolio.groupBy("competencia", "receita_mes").agg(F.count(F.lit(1)).alias("clientes"))
    p = ranks.running(own, "competencia", "receita_mes", "clientes", copies="clientes")
    first = F.least(F.col("clientes"), F.expr(f"(_n * {tenths} + 9) div 10") - F.col("_pos") + 1)  # how many of them are among the first tenths
    top = F.sum(F.when(first > 0, F.col("receita_mes") * first))
    share = F.try_divide(F.col("receita_mes").cast("double"), F.col("_total").cast("double"))
    return _money(p.groupBy("competencia").agg(F.max("_total").alias("receita_total"), F.max("_n").alias("clientes_carteira"), top.cast(WIDE).alias("receita_top_20pct"), ratio(top, F.max("_total")).alias("participacao_top_20pct"), F.round(F.sum(share * share * F.col("clientes")), 6).alias("indice_concentracao")))


def customer_versions(t: Tables) -> DataFrame:
    """The customer history."""
    return views.customer_history(t).select("chave_cliente", "id_cliente", "nome", "id_vendedor", "regiao", "ativo", F.col("valid_from").cast("timestamp_ntz").alias("vigencia_inicio"), F.col("valid_to").cast("timestamp_ntz").alias("vigencia_fim"))


def month_dimension(t: Tables) -> DataFrame:
    return views.months(t).withColumn("fim_exclusivo", F.col("fim_exclusivo").cast("timestamp_ntz"))


def product_dimension(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id_produto"), F.col("p_name").alias("nome"), F.col("p_type").alias("categoria"))


def seller_dimension(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id_vendedor"), F.col("s_name").alias("nome"))


def staged_orders(t: Tables) -> DataFrame:
    """Orders as staged."""
    return views.orders(t).withColumn("emitido_em", F.col("emitido_em").cast("timestamp_ntz"))


def staged_items(t: Tables) -> DataFrame:
    return _money(views.items(t))


def staged_customers(t: Tables) -> DataFrame:
    """Customers as their source has them now."""
    h = views.customer_history(t).where("valid_to is null")
    return h.select("id_cliente", "nome", "id_vendedor", "regiao", "ativo", F.col("valid_from").cast("timestamp_ntz").alias("atualizado_em"))


# --- checks: violations, none in sound data -----------------------------------------------------------------


def covers_customers(t: Tables) -> DataFrame:
    """Customer months that the portfolio lacks, by counting a dense series instead of crossing both sides."""
    p, again = GRAPH.run(t, "carteira_mensal", "carteira_mensal")
    n = views.months(t).agg(F.count(F.lit(1)).alias("n"))
    have = p.groupBy("id_cliente").agg(F.count_distinct("competencia").alias("have"))
    short = t.customer.select(F.col("c_custkey").alias("id_cliente")).join(have, "id_cliente", "left").crossJoin(F.broadcast(n)).where(F.coalesce("have", F.lit(0)) < F.col("n")).select("id_cliente")
    missing = short.crossJoin(F.broadcast(views.months(t).select("competencia")))
    return missing.join(again.select("id_cliente", "competencia"), ["id_cliente", "competencia"], "left_anti")


def no_duplicates(t: Tables) -> DataFrame:
    """Only customers with versions that meet can have a month twice, so only theirs become months and are counted."""
    v = GRAPH.run(t, "carteira_versoes")[0]
    ordered = Window.partitionBy("id_cliente").orderBy("inicio", "fim").rowsBetween(Window.unboundedPreceding, -1)
    met = v.withColumn("_met", F.max("fim").over(ordered) >= F.col("inicio")).withColumn("_any", F.max("_met").over(Window.partitionBy("id_cliente"))).where("_any")
    return _months(met).groupBy("id_cliente", "competencia").agg(F.count(F.lit(1)).alias("n")).where("n <> 1").select("id_cliente", "competencia")


def dates_inside(t: Tables, first: str = FIRST_MONTH, end: str = "2001-01-01") -> DataFrame:
    """Orders outside the accounted period."""
    at = F.col("emitido_em")
    return views.orders(t).where(at.isNull() | (at < F.lit(first)) | (at >= F.lit(end))).select("id_pedido")


def revenue_reconciles(t: Tables) -> DataFrame:
    """Months whose revenue differs between orders and sellers' portfolios."""
    fact, sellers = GRAPH.run(t, "fato_pedidos", "carteira_vendedores")
    a = fact.groupBy("competencia").agg(F.sum("receita").alias("a"))
    b = sellers.groupBy("competencia").agg(F.sum("receita").alias("b"))
    return a.join(b, "competencia", "full").where(~F.coalesce("a", F.lit(0)).eqNullSafe(F.coalesce("b", F.lit(0)))).select("competencia")


def behaviour_in_range(t: Tables) -> DataFrame:
    """Indicators outside their ranges."""
    v, again, third = GRAPH.run(t, *["carteira_versoes"] * 3)  # written once; months are made by each check
    b = comportamento(t, v).where("meses_sem_compra < 0 or meses_base not between 0 and 3 or (meses_base < 3 and ativo and sinal_atencao <> 'historico_insuficiente')").select("id_cliente", "competencia")
    zero = F.lit(0).cast("long").alias("id_cliente")
    c = _cohorts(carteira_mensal(t, again)).where("taxa_compra not between 0 and 1 or compradores > clientes_coorte").select(zero, "competencia")
    d = _concentration(carteira_mensal(t, third)).where("participacao_top_20pct not between 0 and 1 or indice_concentracao not between 0 and 1").select(zero, "competencia")
    return b.unionByName(c).unionByName(d)


def items_valid(t: Tables, most: int = 49) -> DataFrame:
    """Items with impossible amounts (over `most` pieces count as such in this mapping)."""
    return views.items(t).where(F.col("quantidade").isNull() | (F.col("quantidade") <= 0) | (F.col("quantidade") > most) | (F.col("valor_bruto") < 0) | (F.col("valor_desconto") < 0) | (F.col("valor_desconto") > F.col("valor_bruto"))).select("id_item")


def items_reconcile(t: Tables) -> DataFrame:
    """Orders that differ from the sum of their items."""
    items, fact = GRAPH.run(t, "fato_itens", "fato_pedidos")
    i = items.groupBy("id_pedido").agg(F.sum("receita").alias("r"), F.sum("valor_liquido").alias("v"))
    return fact.join(i, "id_pedido").where((F.col("r") != F.col("receita")) | (F.col("v") != F.col("valor_liquido"))).select("id_pedido")


def orders_in_validity(t: Tables) -> DataFrame:
    """Orders attributed to a version that wasn't in force."""
    h = views.customer_history(t).select("chave_cliente", F.col("id_cliente").alias("c"), F.col("id_vendedor").alias("v"), "valid_from", "valid_to")
    at = F.col("emitido_em")
    return _fact(t).join(h, "chave_cliente").where((F.col("id_cliente") != F.col("c")) | (F.col("id_vendedor") != F.col("v")) | (at < F.col("valid_from")) | (F.col("valid_to").isNotNull() & (at >= F.col("valid_to")))).select("id_pedido")


def orders_without_items(t: Tables) -> DataFrame:
    """K39."""
    return views.orders(t).join(t.lineitem.select(F.col("l_orderkey").alias("id_pedido")), "id_pedido", "left_anti").select("id_pedido")


def one_current_version(t: Tables) -> DataFrame:
    """K40."""
    return views.customer_history(t).groupBy("id_cliente").agg(F.count_if(F.col("valid_to").isNull()).alias("n")).where("n <> 1").select("id_cliente")


def versions_apart(t: Tables) -> DataFrame:
    """Overlapping versions."""
    return temporal.overlaps(views.customer_history(t), "id_cliente", "chave_cliente").withColumnRenamed("other", "outra_versao")


def versions_valid(t: Tables) -> DataFrame:
    """K42."""
    return views.customer_history(t).where("valid_from is null or valid_to <= valid_from").select("chave_cliente")


# --- analyses ----------------------------------------------------------------------------------------------


def category_mix(t: Tables) -> DataFrame:
    """Each month's revenue, buyers and share by category."""
    g = _items(t).join(product_dimension(t).select("id_produto", "categoria"), "id_produto").groupBy("competencia", "categoria").agg(F.sum("receita").cast(WIDE).alias("receita"), F.count_distinct(F.when(F.col("status") == "faturado", F.col("id_cliente"))).alias("compradores"))
    total = F.sum("receita").over(Window.partitionBy("competencia"))
    return _money(g.withColumn("participacao", ratio(F.col("receita"), total)))


def contacts(t: Tables, close: str = CLOSE) -> DataFrame:
    """Active customers to contact at a closing month."""
    b = _behaviour(t).where((F.col("competencia") == F.lit(close).cast("date")) & F.col("ativo") & F.col("sinal_atencao").isin("queda_receita", "ausencia_prolongada"))
    names = views.customer_history(t).select("chave_cliente", F.col("nome"))
    return _money(b.join(names, "chave_cliente").join(seller_dimension(t).withColumnRenamed("nome", "vendedor"), "id_vendedor").select("id_cliente", "nome", "vendedor", "sinal_atencao", "meses_sem_compra", "receita_mes", "receita_media_3m_anteriores", "receita_acumulada"))


def signal_summary(t: Tables, close: str = CLOSE) -> DataFrame:
    """Customers by alert at a closing month."""
    b = _behaviour(t).where(F.col("competencia") == F.lit(close).cast("date"))
    return _money(b.groupBy("competencia", "sinal_atencao").agg(F.count(F.lit(1)).alias("clientes"), F.count_if(F.col("pedidos_mes") > 0).alias("clientes_com_compra"), F.sum("receita_mes").alias("receita_mes")))


def retention(t: Tables) -> DataFrame:
    """The retention columns of K25."""
    return seller_months(t).select("competencia", "nome", "clientes_carteira", "clientes_novos", "clientes_recorrentes", "clientes_reativados", "clientes_sem_compra", "retencao_pct", "receita")


def moved_portfolio(t: Tables) -> DataFrame:
    """Orders of customers that changed seller: the seller then and now."""
    h = views.customer_history(t)
    now = h.groupBy("id_cliente").agg(F.min("id_vendedor").alias("_a"), F.max("id_vendedor").alias("_b"), F.max(F.when(F.col("valid_to").isNull(), F.col("id_vendedor"))).alias("vendedor_atual")).where("_a <> _b").drop("_a", "_b")
    return _money(_fact(t).join(now, "id_cliente").select("id_pedido", F.col("emitido_em").cast("timestamp_ntz").alias("emitido_em"), F.col("id_vendedor").alias("vendedor_na_venda"), "vendedor_atual", "receita"))


def portfolio_inspection(t: Tables) -> DataFrame:
    """Rows, customers and revenue of the portfolio by month."""
    v = GRAPH.run(t, "carteira_versoes")[0]
    ordered = Window.partitionBy("id_cliente").orderBy("inicio", "fim").rowsBetween(Window.unboundedPreceding, -1)
    p = _dense(_months(v.withColumn("_seen", F.max("fim").over(ordered))), "_seen")
    new = F.col("_seen").isNull() | (F.col("_seen") < F.col("competencia"))  # a month that no version before has: each customer counts once
    return _money(p.groupBy("competencia").agg(F.count(F.lit(1)).alias("linhas"), F.count_if(new).alias("clientes"), F.sum("receita_mes").alias("receita")))


def inspect_versions(t: Tables) -> DataFrame:
    """Where each customer was, from when to when."""
    h = views.customer_history(t)
    return h.select("id_cliente", "id_vendedor", "regiao", "ativo", F.col("valid_from").cast("timestamp_ntz").alias("vigencia_inicio"), F.col("valid_to").cast("timestamp_ntz").alias("vigencia_fim")).orderBy("id_cliente", "vigencia_inicio")


def inspect_orders(t: Tables) -> DataFrame:
    """Each customer's orders with the seller and region that they count for."""
    return _money(_fact(t).select("id_cliente", "id_pedido", F.col("emitido_em").cast("timestamp_ntz").alias("emitido_em"), "id_vendedor", "regiao", "receita")).orderBy("id_cliente", "emitido_em", "id_pedido")


def inspect_sellers(t: Tables) -> DataFrame:
    """sellers' months, in order."""
    return seller_months(t).select("competencia", "id_vendedor", "nome", "receita", "clientes_novos", "clientes_recorrentes", "clientes_reativados", "clientes_sem_compra", "retencao_pct").orderBy("competencia", "id_vendedor")
