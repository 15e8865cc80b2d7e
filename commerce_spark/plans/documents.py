"""Document events of the driver's tables, and the queries K49-K57 over them.

Every order is a document with one version, a cancelled one with two. What it shipped (lines with status F) is its
invoice, which urgent orders have reversed in a second version; what came back (lines with flag R) is its return. An order
with key 0 has no valid identifier, one without lines no quantity, invoices dated before their order and returns without a standing invoice have no parent: they
are the quarantine. A return takes lines that weren't shipped too, so some return more than was invoiced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import lenient, ratio, real
from commerce_spark.plans import lakehouse
from commerce_spark.plans.graph import GRAPH
from commerce_spark.plans.views import Tables
from commerce_spark.sources.scratch import folder

CUTOFF = "2001-12-31"


@GRAPH.model("dm", sort=("o_orderkey",))
def doc_pedidos(t: Tables) -> DataFrame:
    """Orders with what their lines ordered, shipped and took back."""
    q, shipped, back = F.col("l_quantity").cast("long"), F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(q).alias("q"), F.min("l_suppkey").alias("seller"), F.min("l_partkey").alias("product"), F.sum(F.when(shipped, q)).alias("fq"), F.max(F.when(shipped, F.col("l_shipdate"))).alias("fd"), F.sum(F.when(back, q)).alias("rq"), F.max(F.when(back, F.col("l_shipdate"))).alias("rd")
    )
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def events(orders: DataFrame, only: str | None = None) -> DataFrame:
    """The events, in the columns of lakehouse.KINDS with id, entity and status: each order is exploded into its own, so orders
    are read once. The tables have types, so nothing is written as text and parsed again. only: the events of one entity."""

    def of(when: Column, entity: str, version: int, date: str, quantity: str, status: str) -> tuple[str, Column]:
        order, key, day = entity == "pedido", F.col("o_orderkey"), F.col(date)
        none = F.lit(None)
        made = {
            "chave": key, "revisao": F.lit(version), "qtd": F.col(quantity), "preco": F.col("o_totalprice").cast("decimal(12,2)") if order else none, "documento": day, "previsao": day + F.expr("interval 30 days") if order else none,
            "atualizado": day + F.expr(f"interval {version} days"), "cliente": F.col("o_custkey") if order else none, "vendedor": F.col("seller") if order else none, "produto": F.col("product") if order else none, "referencia": none if order else key,
        }
        head = [F.concat(F.lit(f"{entity}-"), key.cast("string"), F.lit(f"-{version}")).alias("id_evento"), F.lit(entity).alias("entidade"), F.lit(status).alias("status")]
        return entity, F.when(when, F.struct(*head, *[lenient(kind, made[k]).alias(k) for k, (_, kind) in lakehouse.KINDS.items()]))

    invoiced, returned = F.col("fq").isNotNull(), F.col("rq").isNotNull()
    each = [
        of(F.lit(True), "pedido", 1, "o_orderdate", "q", "aberto"), of(F.col("o_orderstatus") == "P", "pedido", 2, "o_orderdate", "q", "cancelado"), of(invoiced, "faturamento", 1, "fd", "fq", "faturado"),
        of(invoiced & (F.col("o_orderpriority") == "1-URGENT"), "faturamento", 2, "fd", "fq", "estornado"), of(returned, "devolucao", 1, "rd", "rq", "confirmada"),
    ]
    return orders.select(F.inline(F.array_compact(F.array(*[made for entity, made in each if only in (None, entity)]))))


def dimensions(t: Tables) -> dict[str, DataFrame]:
    return {
        "clientes": t.customer.select(F.col("c_custkey").alias("id_cliente"), F.col("c_name").alias("nome")),
        "vendedores": t.supplier.select(F.col("s_suppkey").alias("id_vendedor"), F.col("s_name").alias("nome")),
        "produtos": t.part.select(F.col("p_partkey").alias("id_produto"), F.col("p_name").alias("nome"), F.col("p_brand").alias("categoria")),
    }


def _references(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_custkey").alias("cliente"), F.col("seller").alias("vendedor"), F.col("product").alias("produto"))


@GRAPH.model("comercial", "doc_pedidos", "doc_pedidos")
def eventos_avaliados(t: Tables, orders: DataFrame, again: DataFrame) -> DataFrame:
    return lakehouse.judge(events(orders), dimensions(t), _references(again))


@GRAPH.model("comercial", "eventos_avaliados")
def eventos_correntes(t: Tables, evaluated: DataFrame) -> DataFrame:
    return lakehouse.current(evaluated)


def _of(current: DataFrame, entity: str) -> DataFrame:
    return current.where(F.col("entidade") == entity)


@GRAPH.model("comercial", "eventos_avaliados")
def eventos_julgados(t: Tables, evaluated: DataFrame) -> DataFrame:
    """What the quarantine asks of events; it is written, so the rest isn't."""
    return evaluated.select("id_evento", "entidade", "status", "chave", "revisao", "documento", "referencia", "reason")


@GRAPH.model("comercial", "eventos_julgados")
def julgados_correntes(t: Tables, judged: DataFrame) -> DataFrame:
    return lakehouse.current(judged)


@GRAPH.model("comercial", "eventos_correntes", "eventos_correntes")
def faturas_resolvidas(t: Tables, current: DataFrame, orders: DataFrame) -> DataFrame:
    return lakehouse.resolved(_of(current, "faturamento"), _of(orders, "pedido"))


@GRAPH.model("comercial", "eventos_correntes", "faturas_resolvidas")
def devolucoes_resolvidas(t: Tables, current: DataFrame, invoices: DataFrame) -> DataFrame:
    return lakehouse.resolved(_of(current, "devolucao"), invoices.where("status = 'faturado'"))


@GRAPH.model("comercial", "eventos_correntes")
def prata_pedidos(t: Tables, current: DataFrame) -> DataFrame:
    return lakehouse.silver_table("pedidos", _of(current, "pedido"))


@GRAPH.model("comercial", "faturas_resolvidas")
def prata_faturamentos(t: Tables, invoices: DataFrame) -> DataFrame:
    return lakehouse.silver_table("faturamentos", invoices)


@GRAPH.model("comercial", "devolucoes_resolvidas")
def prata_devolucoes(t: Tables, returns: DataFrame) -> DataFrame:
    return lakehouse.silver_table("devolucoes", returns)


@GRAPH.model("comercial", "prata_pedidos", "prata_faturamentos", "prata_devolucoes")
def posicao_pedidos(t: Tables, orders: DataFrame, invoices: DataFrame, returns: DataFrame) -> DataFrame:
    return lakehouse.order_position(orders, invoices, returns, CUTOFF)


def _built(t: Tables, *names: str) -> list[DataFrame]:
    return GRAPH.run(t, *names)


def _plain(df: DataFrame) -> DataFrame:
    """Money as doubles, instants without a zone."""
    made = {c: real(F.col(c)) if k.startswith("decimal") else F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k.startswith("decimal") or k == "timestamp"}
    return df.withColumns(made) if made else df


def silver_orders(t: Tables) -> DataFrame:
    """The current valid orders."""
    return _plain(_built(t, "prata_pedidos")[0])


def silver_invoices(t: Tables) -> DataFrame:
    """The current valid invoices whose order is known and not later."""
    return _plain(_built(t, "prata_faturamentos")[0])


def silver_returns(t: Tables) -> DataFrame:
    """The current valid returns of standing invoices."""
    return _plain(_built(t, "prata_devolucoes")[0])


def _position(t: Tables) -> DataFrame:
    return _built(t, "posicao_pedidos")[0]


def position(t: Tables) -> DataFrame:
    """The position of every order."""
    return _plain(_position(t).drop("quantidade", "atualizado"))


def return_facts(t: Tables) -> DataFrame:
    """K51."""
    return _plain(lakehouse.return_facts(*_built(t, "prata_pedidos", "prata_faturamentos", "prata_devolucoes")))


def seller_summary(t: Tables) -> DataFrame:
    """K52."""
    return _plain(lakehouse.seller_summary(_position(t)))


def open_orders(t: Tables) -> DataFrame:
    """K53."""
    d = dimensions(t)
    return _plain(lakehouse.open_orders(_position(t), d["clientes"], d["vendedores"]))


def returns_by_category(t: Tables) -> DataFrame:
    """K54."""
    g = lakehouse.returns_by_category(_position(t), dimensions(t)["produtos"])
    return _plain(g.withColumn("taxa_devolucao_valor", ratio(F.col("devolucoes"), F.col("faturamento"))))


def backlog_split(t: Tables) -> DataFrame:
    """K55."""
    return _plain(lakehouse.backlog_split(_position(t)))


def inconsistencies(t: Tables) -> DataFrame:
    """K56."""
    return lakehouse.inconsistencies(_built(t, "posicao_pedidos", "posicao_pedidos")[0])


def quarantine(t: Tables) -> DataFrame:
    """K57."""
    judged, current, orders = _built(t, "eventos_julgados", "julgados_correntes", "julgados_correntes")
    invoices = lakehouse.resolved(_of(current, "faturamento"), _of(orders, "pedido"))
    return lakehouse.held(judged, (_of(current, "faturamento"), _of(orders, "pedido")), (_of(current, "devolucao"), invoices.where("status = 'faturado'")))


def runs(t: Tables) -> DataFrame:
    """The log of the engine's runs, newest first: orders, invoices and returns come as a batch each; the returns are
    refused where more came back than was invoiced, and the log says so."""
    engine = lakehouse.Lakehouse(t.spark, folder(t.spark, "lakehouse"))
    engine.load_dimensions(dimensions(t))
    rows = GRAPH.run(t, *["doc_pedidos"] * 3)  # one scan for the three batches: orders are fewer and narrower than their events
    for entity, orders in zip(lakehouse.STATES, rows, strict=True):
        try:
            engine.process(lakehouse.raw(events(orders, entity)), CUTOFF, name=entity)
        except lakehouse.Refused:
            continue
    return engine.runs().select(F.col("arquivo").alias("lote"), "data_corte", "status", "eventos_bronze", "quarentena", "erro")


PLANS = {
    "k58_runs": runs,
    "k49_silver_orders": silver_orders, "k49_silver_invoices": silver_invoices, "k49_silver_returns": silver_returns, "k50_position": position, "k51_return_facts": return_facts, "k52_seller_summary": seller_summary,
    "k53_open_orders": open_orders, "k54_returns_by_category": returns_by_category, "k55_backlog_split": backlog_split, "k56_inconsistencies": inconsistencies, "k57_quarantine": quarantine,
}

_BASE = """WITH l AS (SELECT l_orderkey AS k, SUM(CAST(l_quantity AS BIGINT)) AS q, MIN(l_suppkey) AS seller, MIN(l_partkey) AS product, SUM(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus='F') AS fq, MAX(l_shipdate) FILTER (l_linestatus='F') AS fd,
    SUM(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag='R') AS rq, MAX(l_shipdate) FILTER (l_returnflag='R') AS rd FROM lineitem GROUP BY 1),
o AS (SELECT * FROM orders LEFT JOIN l ON o_orderkey=k),
ped AS (SELECT o_orderkey AS id_pedido, CASE WHEN o_orderstatus='P' THEN 2 ELSE 1 END AS versao, o_custkey AS id_cliente, seller AS id_vendedor, product AS id_produto, CAST(q AS BIGINT) AS quantidade, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(o_orderdate AS DATE) AS data_pedido,
    CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS data_prevista, CASE WHEN o_orderstatus='P' THEN 'cancelado' ELSE 'aberto' END AS status, o_orderdate FROM o WHERE q>0 AND o_orderkey>0),
fat AS (SELECT o_orderkey AS id_faturamento, CASE WHEN o_orderpriority='1-URGENT' THEN 2 ELSE 1 END AS versao, o_orderkey AS id_pedido, CAST(fq AS BIGINT) AS quantidade, CAST(fd AS DATE) AS data_faturamento, CASE WHEN o_orderpriority='1-URGENT' THEN 'estornado' ELSE 'faturado' END AS status, fd
    FROM o WHERE fq>0 AND q>0 AND o_orderkey>0 AND CAST(fd AS DATE)>=CAST(o_orderdate AS DATE)),
dev AS (SELECT o_orderkey AS id_devolucao, 1 AS versao, id_faturamento, CAST(rq AS BIGINT) AS quantidade, CAST(rd AS DATE) AS data_devolucao, 'confirmada' AS status, rd FROM o JOIN fat ON id_faturamento=o_orderkey WHERE rq>0 AND fat.status='faturado' AND CAST(rd AS DATE)>=data_faturamento),
pos0 AS (SELECT ped.*, ped.quantidade AS quantidade_pedida, CASE WHEN fat.status='faturado' THEN fat.quantidade ELSE 0 END AS quantidade_faturada, coalesce(dev.quantidade,0) AS quantidade_devolvida FROM ped LEFT JOIN fat USING (id_pedido) LEFT JOIN dev USING (id_faturamento)),
pos1 AS (SELECT *, CASE WHEN status='cancelado' THEN 0 ELSE quantidade_pedida-quantidade_faturada END AS quantidade_aberta, CASE WHEN status='cancelado' THEN quantidade_pedida-quantidade_faturada ELSE 0 END AS quantidade_cancelada FROM pos0),
pos AS (SELECT *, CAST(quantidade_aberta*price AS DECIMAL(28,2)) AS valor_aberto, CAST(quantidade_faturada*price AS DECIMAL(28,2)) AS valor_faturado, CAST(quantidade_devolvida*price AS DECIMAL(28,2)) AS valor_devolvido, CAST((quantidade_faturada-quantidade_devolvida)*price AS DECIMAL(28,2)) AS receita_apos_devolucao,
    CAST(CASE WHEN quantidade_aberta>0 THEN greatest(date_diff('day', data_prevista, DATE '2001-12-31'),0) ELSE 0 END AS INTEGER) AS dias_atraso FROM pos1) """


def _d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


_MONEY = _d("valor_aberto", "valor_faturado", "valor_devolvido", "receita_apos_devolucao")
_QUARANTINE = """SELECT 'pedido-'||o_orderkey||'-'||v AS id_evento, 'pedido' AS entidade, o_orderkey AS chave, CAST(v AS BIGINT) AS revisao, CASE WHEN o_orderkey<=0 THEN 'identificador_versao_ou_data_invalida' ELSE 'quantidade_invalida' END AS motivo
                FROM o, (VALUES (1),(2)) t(v) WHERE (v=1 OR o_orderstatus='P') AND (coalesce(q,0)<=0 OR o_orderkey<=0)
            UNION ALL SELECT 'faturamento-'||o_orderkey||'-'||v, 'faturamento', o_orderkey, v, 'identificador_versao_ou_data_invalida' FROM o, (VALUES (1),(2)) t(v) WHERE (v=1 OR o_orderpriority='1-URGENT') AND fq>0 AND o_orderkey<=0
            UNION ALL SELECT 'devolucao-'||o_orderkey||'-1', 'devolucao', o_orderkey, 1, 'identificador_versao_ou_data_invalida' FROM o WHERE rq>0 AND o_orderkey<=0
            UNION ALL SELECT 'faturamento-'||o_orderkey||'-'||CASE WHEN o_orderpriority='1-URGENT' THEN 2 ELSE 1 END, 'faturamento', o_orderkey, CASE WHEN o_orderpriority='1-URGENT' THEN 2 ELSE 1 END, 'referencia_ausente_ou_data_incompativel' FROM o WHERE fq>0 AND o_orderkey>0 AND o_orderkey NOT IN (SELECT id_faturamento FROM fat)
            UNION ALL SELECT 'devolucao-'||o_orderkey||'-1', 'devolucao', o_orderkey, 1, 'referencia_ausente_ou_data_incompativel' FROM o WHERE rq>0 AND o_orderkey>0 AND o_orderkey NOT IN (SELECT id_devolucao FROM dev)"""
SQL = {
    name: _BASE + select
    for name, select in {
        "k49_silver_orders": "SELECT id_pedido, CAST(versao AS BIGINT) AS versao, o_orderdate + to_days(versao) AS atualizado, id_cliente, id_vendedor, id_produto, quantidade, CAST(price AS DOUBLE) AS preco_unitario, data_pedido, data_prevista, status FROM ped",
        "k49_silver_invoices": "SELECT id_faturamento, CAST(versao AS BIGINT) AS versao, fd + to_days(versao) AS atualizado, id_pedido, quantidade, data_faturamento, status FROM fat",
        "k49_silver_returns": "SELECT id_devolucao, CAST(versao AS BIGINT) AS versao, rd + to_days(versao) AS atualizado, id_faturamento, quantidade, data_devolucao, status FROM dev",
        "k50_position": f"SELECT id_pedido, CAST(versao AS BIGINT) AS versao, id_cliente, id_vendedor, id_produto, CAST(price AS DOUBLE) AS preco_unitario, data_pedido, data_prevista, status, quantidade_pedida, quantidade_faturada, quantidade_devolvida, quantidade_aberta, quantidade_cancelada, {_MONEY}, dias_atraso FROM pos",
        "k51_return_facts": "SELECT id_devolucao, id_faturamento, id_pedido, id_cliente, id_vendedor, id_produto, data_devolucao, dev.quantidade AS quantidade_devolvida, CAST(CAST(dev.quantidade*price AS DECIMAL(28,2)) AS DOUBLE) AS valor_devolvido FROM dev JOIN fat USING (id_faturamento) JOIN ped USING (id_pedido)",
        "k52_seller_summary": f"SELECT id_vendedor, COUNT(*) AS pedidos, {', '.join(f'CAST(SUM({a}) AS DOUBLE) AS {b}' for a, b in (('valor_aberto', 'carteira_aberta'), ('valor_faturado', 'faturamento'), ('valor_devolvido', 'devolucoes'), ('receita_apos_devolucao', 'receita_apos_devolucao')))}, CAST(SUM(CASE WHEN dias_atraso>0 THEN valor_aberto ELSE 0 END) AS DOUBLE) AS carteira_atrasada FROM pos GROUP BY 1",
        "k53_open_orders": "SELECT id_pedido, c_name AS cliente, s_name AS vendedor, quantidade_aberta, CAST(valor_aberto AS DOUBLE) AS valor_aberto, dias_atraso FROM pos JOIN customer ON c_custkey=id_cliente JOIN supplier ON s_suppkey=id_vendedor WHERE quantidade_aberta>0",
        "k54_returns_by_category": "SELECT p_brand AS categoria, CAST(SUM(valor_faturado) AS DOUBLE) AS faturamento, CAST(SUM(valor_devolvido) AS DOUBLE) AS devolucoes, CAST(SUM(receita_apos_devolucao) AS DOUBLE) AS receita_apos_devolucao, round(CAST(SUM(valor_devolvido) AS DOUBLE)/nullif(CAST(SUM(valor_faturado) AS DOUBLE),0),6) AS taxa_devolucao_valor FROM pos JOIN part ON p_partkey=id_produto GROUP BY 1",
        "k55_backlog_split": "SELECT id_vendedor, CAST(SUM(valor_aberto) AS DOUBLE) AS carteira, CAST(SUM(CASE WHEN quantidade_faturada>0 THEN valor_aberto ELSE 0 END) AS DOUBLE) AS saldo_parcial, CAST(SUM(quantidade_cancelada*price) AS DOUBLE) AS saldo_cancelado FROM pos GROUP BY 1",
        "k56_inconsistencies": "SELECT id_pedido FROM pos WHERE quantidade_devolvida>quantidade_faturada OR quantidade_aberta<0 OR quantidade_pedida<>quantidade_faturada+quantidade_aberta+quantidade_cancelada",
        "k57_quarantine": _QUARANTINE,
        "k58_runs": f"""SELECT lote, '2001-12-31' AS data_corte, CASE WHEN over THEN 'falha' ELSE 'sucesso' END AS status, CASE WHEN over THEN NULL ELSE bronze END AS eventos_bronze, CASE WHEN over THEN NULL ELSE held END AS quarentena,
            CASE WHEN over THEN 'more was consumed than a document holds; the silver tables stay as they were' END AS erro FROM (
            SELECT 'pedido' AS lote, (SELECT COUNT(*) + COUNT(*) FILTER (o_orderstatus='P') FROM o) AS bronze, (SELECT COUNT(*) FROM ({_QUARANTINE}) WHERE entidade='pedido') AS held, false AS over
            UNION ALL SELECT 'faturamento', (SELECT COUNT(*) + COUNT(*) FILTER (o_orderstatus='P') + COUNT(fq) + COUNT(fq) FILTER (o_orderpriority='1-URGENT') FROM o), (SELECT COUNT(*) FROM ({_QUARANTINE}) WHERE entidade<>'devolucao'), EXISTS (SELECT 1 FROM fat JOIN ped USING (id_pedido) WHERE fat.status='faturado' AND fat.quantidade>ped.quantidade)
            UNION ALL SELECT 'devolucao', (SELECT COUNT(*) + COUNT(*) FILTER (o_orderstatus='P') + COUNT(fq) + COUNT(fq) FILTER (o_orderpriority='1-URGENT') + COUNT(rq) FROM o), (SELECT COUNT(*) FROM ({_QUARANTINE})), EXISTS (SELECT 1 FROM dev JOIN fat USING (id_faturamento) WHERE dev.quantidade>fat.quantidade))""",
    }.items()
}
