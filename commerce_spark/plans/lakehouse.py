"""Versioned document events (orders, invoices, returns) consolidated into a position: bronze, silver, gold.

Events come in any order and in any number of versions. All valid versions are re-evaluated with each batch, so
late parents resolve themselves and an old version never reverts a newer one. Batches that would make the data
ambiguous stop before anything is written; quantities that exceed their document stop before the silver tables change.
"""

from __future__ import annotations

import re
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import content_hash, lenient
from commerce_spark.operators import changes
from commerce_spark.sources import files
from commerce_spark.sources.scratch import kept

FIELDS = ["id_evento", "entidade", "id_registro", "versao", "atualizado_em", "id_cliente", "id_vendedor", "id_produto", "id_referencia", "quantidade", "preco_unitario", "data_documento", "data_prevista", "status"]
EVENTS = ", ".join(f"{c} string" for c in FIELDS)
BRONZE = f"{EVENTS}, hash_conteudo string"
STATES = {"pedido": ["aberto", "cancelado"], "faturamento": ["faturado", "estornado"], "devolucao": ["confirmada"]}
RUNS = "id_execucao string, arquivo string, data_corte string, status string, registrado_em timestamp, duracao_segundos double, eventos_bronze long, quarentena long, erro string"


KINDS = {"chave": ("id_registro", "bigint"), "revisao": ("versao", "bigint"), "qtd": ("quantidade", "bigint"), "preco": ("preco_unitario", "decimal(18,2)"), "documento": ("data_documento", "date"), "previsao": ("data_prevista", "date"), "atualizado": ("atualizado_em", "timestamp"), "cliente": ("id_cliente", "bigint"), "vendedor": ("id_vendedor", "bigint"), "produto": ("id_produto", "bigint"), "referencia": ("id_referencia", "bigint")}


def typed(events: DataFrame) -> DataFrame:
    """The events with typed columns; what can't be parsed is null."""
    return events.withColumns({k: lenient(kind, F.col(c)) for k, (c, kind) in KINDS.items()})


def raw(events: DataFrame) -> DataFrame:
    """Typed events as the texts that `typed` reads back, in the columns of FIELDS; instants to the second."""
    text = {c: F.date_format(k, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "timestamp" else F.col(k).cast("string") for k, (c, kind) in KINDS.items()}
    return events.select(*[text.get(c, F.col(c)).alias(c) for c in FIELDS])


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


REFERENCES = (("clientes", "cliente"), ("vendedores", "vendedor"), ("produtos", "produto"))


def unknown(references: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """The keys, by table, that orders refer to and the dimensions haven't: none in sound data. references: a row an order.

    The keys alone are shuffled, and what is found is written, so its size is known to the joins with events."""
    pairs = references.select(F.inline(F.array(*[F.struct(F.lit(table).alias("tabela"), F.col(c).alias("chave")) for table, c in REFERENCES]))).distinct()
    known = [dimensions[table].select(F.lit(table).alias("tabela"), F.col(f"id_{c}").cast("long").alias("chave")) for table, c in REFERENCES]
    return kept(pairs.where("chave is not null").join(known[0].unionByName(known[1]).unionByName(known[2]), ["tabela", "chave"], "left_anti"), "desconhecidos")


def evaluate(events: DataFrame, dimensions: dict[str, DataFrame], references: DataFrame | None = None) -> DataFrame:
    """Events that come as texts, typed and judged."""
    return judge(typed(events), dimensions, references)


def judge(e: DataFrame, dimensions: dict[str, DataFrame], references: DataFrame | None = None) -> DataFrame:
    """Typed events, without their raw texts, with `reason`: the first rule that an event breaks, or null.

    Events meet only the keys that no dimension has, so they aren't shuffled once for each dimension. references: cliente,
    vendedor and produto of the orders among the events, where they can be had without the events.
    """
    missing = unknown(e.where("entidade = 'pedido'").select("cliente", "vendedor", "produto") if references is None else references, dimensions)
    known = F.lit(True)
    for table, column in REFERENCES:
        flag = f"_{column}"
        e = e.join(missing.where(F.col("tabela") == table).select(F.col("chave").alias(column), F.lit(True).alias(flag)), column, "left")
        known = known & F.col(column).isNotNull() & F.col(flag).isNull()
    entity, state = F.col("entidade"), F.col("status")
    stated = lambda name: F.coalesce((entity == name) & state.isin(STATES[name]), F.lit(False))
    order_ok = stated("pedido") & _positive("preco") & F.coalesce(F.col("previsao") >= F.col("documento"), F.lit(False)) & known
    head_ok = _positive("chave") & _positive("revisao") & F.col("atualizado").isNotNull() & F.col("documento").isNotNull()
    reason = (
        F.when(~head_ok, "identificador_versao_ou_data_invalida").when(~_positive("qtd"), "quantidade_invalida").when((entity == "pedido") & ~order_ok, "pedido_invalido")
        .when((entity == "faturamento") & ~(stated("faturamento") & F.col("referencia").isNotNull()), "faturamento_invalido").when((entity == "devolucao") & ~(stated("devolucao") & F.col("referencia").isNotNull()), "devolucao_invalida")
        .when(~F.coalesce(entity.isin(list(STATES)), F.lit(False)), "entidade_invalida")
    )
    return e.select("id_evento", "entidade", "status", *KINDS, reason.alias("reason"))


def current(evaluated: DataFrame) -> DataFrame:
    """The newest valid version of each document. The key comes first: a sort compares its numbers, and few texts."""
    return changes.latest(evaluated.where("reason is null"), ["chave", "entidade"], [F.desc("revisao"), F.asc("id_evento")])


def resolved(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Documents whose parent is there and not later."""
    parent = parents.select(F.col("chave").alias("referencia"), F.col("documento").alias("_since"))
    return children.join(parent, "referencia").where("documento >= _since").drop("_since")


def held(evaluated: DataFrame, *unresolved: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The quarantine: events that break a rule, and current children whose parent isn't there or is later. unresolved:
    children and parents; each child is judged by the join with its parent, so no list of what was resolved is needed."""
    columns = [F.col(c) for c in ("id_evento", "entidade", "chave", "revisao")]
    rows = evaluated.where("reason is not null").select(*columns, F.col("reason").alias("motivo"))
    for children, parents in unresolved:
        parent = parents.select(F.col("chave").alias("referencia"), F.col("documento").alias("_since"))
        waiting = children.join(parent, "referencia", "left").where(~F.coalesce(F.col("documento") >= F.col("_since"), F.lit(False)))
        rows = rows.unionByName(waiting.select(*columns, F.lit("referencia_ausente_ou_data_incompativel").alias("motivo")))
    return rows


SILVER = {
    "pedidos": {"id_pedido": "chave", "versao": "revisao", "atualizado": "atualizado", "id_cliente": "cliente", "id_vendedor": "vendedor", "id_produto": "produto", "quantidade": "qtd", "preco_unitario": "preco", "data_pedido": "documento", "data_prevista": "previsao", "status": "status"},
    "faturamentos": {"id_faturamento": "chave", "versao": "revisao", "atualizado": "atualizado", "id_pedido": "referencia", "quantidade": "qtd", "data_faturamento": "documento", "status": "status"},
    "devolucoes": {"id_devolucao": "chave", "versao": "revisao", "atualizado": "atualizado", "id_faturamento": "referencia", "quantidade": "qtd", "data_devolucao": "documento", "status": "status"},
}


def silver_table(name: str, documents: DataFrame) -> DataFrame:
    """Resolved documents in the columns of their silver table."""
    return documents.select(*[F.col(c).alias(k) for k, c in SILVER[name].items()])


class Position:
    """What a state of bronze says: evaluated and current events, resolved documents, quarantine, excess. With `keep` the
    current events are persisted, and the caller lets them go: all but the rejected rows is made of them."""

    def __init__(self, bronze: DataFrame, dimensions: dict[str, DataFrame], keep: bool = False):
        self.evaluated = evaluate(bronze, dimensions)
        self.current = current(self.evaluated)
        if keep:
            self.current.persist()
        of = lambda name: self.current.where(F.col("entidade") == name)
        self.orders = of("pedido")
        self.invoices = resolved(of("faturamento"), self.orders)
        self.returns = resolved(of("devolucao"), self.invoices.where("status = 'faturado'"))

    def quarantine(self) -> DataFrame:
        of = lambda name: self.current.where(F.col("entidade") == name)
        return held(self.evaluated, (of("faturamento"), self.orders), (of("devolucao"), self.invoices.where("status = 'faturado'")))

    def excess(self) -> DataFrame:
        """Documents of which more was consumed than they hold."""

        def over(parents: DataFrame, children: DataFrame) -> DataFrame:
            used = children.groupBy(F.col("referencia").alias("chave")).agg(F.sum("qtd").alias("used"))
            return parents.select("chave", "qtd").join(used, "chave").where("used > qtd").select("chave")

        return over(self.orders, self.invoices.where("status = 'faturado'")).unionByName(over(self.invoices, self.returns))

    def silver(self) -> dict[str, tuple[str, DataFrame]]:
        """Table -> (key, rows): K49."""
        return {name: (next(iter(SILVER[name])), silver_table(name, rows)) for name, rows in (("pedidos", self.orders), ("faturamentos", self.invoices), ("devolucoes", self.returns))}


def order_position(orders: DataFrame, invoices: DataFrame, returns: DataFrame, cutoff: str) -> DataFrame:
    """Each order's quantities and values, open, invoiced, returned and cancelled, and its days late at the cutoff."""
    back = returns.groupBy("id_faturamento").agg(F.sum("quantidade").alias("_q"))
    billed = invoices.where("status = 'faturado'").select("id_faturamento", "id_pedido", "quantidade").join(back, "id_faturamento", "left")
    moved = billed.groupBy("id_pedido").agg(F.sum("quantidade").alias("_sold"), F.sum("_q").alias("_back"))
    zero = F.lit(0).cast("long")
    p = orders.join(moved, "id_pedido", "left").withColumns({"quantidade_pedida": F.col("quantidade"), "quantidade_faturada": F.coalesce("_sold", zero), "quantidade_devolvida": F.coalesce("_back", zero)}).drop("_sold", "_back")
    rest, cancelled = F.col("quantidade_pedida") - F.col("quantidade_faturada"), F.col("status") == "cancelado"
    p = p.withColumn("quantidade_aberta", F.when(cancelled, zero).otherwise(rest)).withColumn("quantidade_cancelada", F.when(cancelled, rest).otherwise(zero))
    worth = lambda q: (q.cast("decimal(18,0)") * F.col("preco_unitario")).cast("decimal(28,2)")
    late = F.when(F.col("quantidade_aberta") > 0, F.greatest(F.datediff(F.lit(cutoff).cast("date"), "data_prevista"), F.lit(0))).otherwise(0)
    return p.withColumns({"valor_aberto": worth(F.col("quantidade_aberta")), "valor_faturado": worth(F.col("quantidade_faturada")), "valor_devolvido": worth(F.col("quantidade_devolvida")), "receita_apos_devolucao": worth(F.col("quantidade_faturada") - F.col("quantidade_devolvida")), "dias_atraso": late})


def return_facts(orders: DataFrame, invoices: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns at the price of their order."""
    i = invoices.where("status = 'faturado'").select("id_faturamento", "id_pedido")
    o = orders.select("id_pedido", "id_cliente", "id_vendedor", "id_produto", "preco_unitario")
    r = returns.select("id_devolucao", "id_faturamento", "data_devolucao", F.col("quantidade").alias("quantidade_devolvida"))
    return r.join(i, "id_faturamento").join(o, "id_pedido").select("id_devolucao", "id_faturamento", "id_pedido", "id_cliente", "id_vendedor", "id_produto", "data_devolucao", "quantidade_devolvida", (F.col("quantidade_devolvida").cast("decimal(18,0)") * F.col("preco_unitario")).cast("decimal(28,2)").alias("valor_devolvido"))


def seller_summary(position: DataFrame) -> DataFrame:
    """K52."""
    s = lambda c, n: F.sum(c).alias(n)
    return position.groupBy("id_vendedor").agg(F.count(F.lit(1)).alias("pedidos"), s("valor_aberto", "carteira_aberta"), s("valor_faturado", "faturamento"), s("valor_devolvido", "devolucoes"), s("receita_apos_devolucao", "receita_apos_devolucao"), F.sum(F.when(F.col("dias_atraso") > 0, F.col("valor_aberto")).otherwise(0)).alias("carteira_atrasada"))


def open_orders(position: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Open orders, most valuable first."""
    c, v = customers.select("id_cliente", F.col("nome").alias("cliente")), sellers.select("id_vendedor", F.col("nome").alias("vendedor"))
    return position.where("quantidade_aberta > 0").join(c, "id_cliente").join(v, "id_vendedor").select("id_pedido", "cliente", "vendedor", "quantidade_aberta", "valor_aberto", "dias_atraso").orderBy(F.desc("valor_aberto"), "id_pedido")


def returns_by_category(position: DataFrame, products: DataFrame) -> DataFrame:
    """The share of invoiced value that came back, by category."""
    g = position.join(products.select("id_produto", "categoria"), "id_produto").groupBy("categoria").agg(F.sum("valor_faturado").alias("faturamento"), F.sum("valor_devolvido").alias("devolucoes"), F.sum("receita_apos_devolucao").alias("receita_apos_devolucao"))
    return g.withColumn("taxa_devolucao_valor", F.try_divide("devolucoes", "faturamento")).orderBy(F.desc_nulls_last("taxa_devolucao_valor"), "categoria")


def backlog_split(position: DataFrame) -> DataFrame:
    """Each seller's open value, of which in partly invoiced orders, and the value cancelled."""
    partial = F.when(F.col("quantidade_faturada") > 0, F.col("valor_aberto")).otherwise(0)
    gone = F.col("quantidade_cancelada").cast("decimal(18,0)") * F.col("preco_unitario")
    return position.groupBy("id_vendedor").agg(F.sum("valor_aberto").alias("carteira"), F.sum(partial).alias("saldo_parcial"), F.sum(gone).alias("saldo_cancelado")).orderBy("id_vendedor")


def inconsistencies(position: DataFrame) -> DataFrame:
    """Orders whose quantities don't add up, or that come twice."""
    bad = position.where((F.col("quantidade_pedida") != F.col("quantidade_faturada") + F.col("quantidade_aberta") + F.col("quantidade_cancelada")) | (F.col("quantidade_devolvida") > F.col("quantidade_faturada")) | (F.col("quantidade_aberta") < 0)).select("id_pedido")
    twice = position.groupBy("id_pedido").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id_pedido")
    return bad.unionByName(twice)


class Refused(ValueError):
    """A batch that the engine doesn't take."""


class Lakehouse:
    """The engine over a versioned store: `load_dimensions`, `process`, then the gold functions on `silver`.

    inbox: folders that batches may be read from; None allows any path."""

    def __init__(self, spark: SparkSession, folder: str, inbox: tuple[str, ...] | None = None):
        self.spark, self.store, self.inbox = spark, files.Store(spark, folder), inbox

    def load_dimensions(self, dimensions: dict[str, DataFrame]) -> None:
        for name, df in dimensions.items():
            key = df.columns[0]
            if not df.where(F.col(key).isNull()).isEmpty():
                raise ValueError(f"{name}: {key} is missing")
        self.store.commit(replaced={f"dim_{k}": v for k, v in dimensions.items()})

    def process(self, batch: str | DataFrame, cutoff: str = "2026-09-30", name: str = "dataframe") -> dict:
        """Take in a batch (a JSON-lines path or a DataFrame of its strings); a log row is written whatever happens. name:
        what the log calls a DataFrame."""
        began, status, error, found = time.monotonic(), "sucesso", None, {}
        try:
            found = self._process(batch, cutoff)
            return found
        except Exception as e:
            status, error = "falha", str(e)[:2000]
            raise
        finally:
            row = (str(uuid.uuid4()), batch if isinstance(batch, str) else name, cutoff, status, datetime.now(timezone.utc), time.monotonic() - began, found.get("eventos_bronze"), found.get("quarentena"), error)
            self.store.commit(appended={"execucoes": self.spark.createDataFrame([row], RUNS)})

    def _process(self, batch: str | DataFrame, cutoff: str) -> dict:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", cutoff):
            raise ValueError("the cutoff must be a date")
        if isinstance(batch, str) and self.inbox is not None:
            files.inside(batch, self.inbox)
        events = files.jsonl(self.spark, batch, EVENTS) if isinstance(batch, str) else batch.select(*[F.col(c).cast("string") for c in FIELDS])
        events = events.withColumn("hash_conteudo", content_hash(*[c for c in FIELDS if c != "id_evento"])).persist()
        held = [events]
        try:
            return self._taken_in(events, cutoff, held)
        finally:  # a refused batch leaves nothing in memory
            for df in held:
                df.unpersist()

    @staticmethod
    def _repeats(old: DataFrame, events: DataFrame) -> str:
        """Whether ids of the batch are "new", some come "again" (in it, or after earlier ones), or in "conflict". Bronze
        itself has each id once, so only its ids between the batch's first and last are looked at."""
        low, high = events.agg(F.min("id_evento"), F.max("id_evento")).first()
        if low is None:
            return "new"
        both = old.where(F.col("id_evento").between(low, high)).unionByName(events).select("id_evento", F.xxhash64("hash_conteudo").alias("h"))
        ids = both.groupBy("id_evento").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count(F.lit(1)).alias("n"))
        conflict, most = ids.agg(F.bool_or(F.col("a") != F.col("b")), F.max("n")).first()
        return "conflict" if conflict else "again" if most > 1 else "new"

    def _taken_in(self, events: DataFrame, cutoff: str, held: list[DataFrame]) -> dict:
        if not events.where(F.col("id_evento").isNull() | (F.trim("id_evento") == "")).isEmpty():
            raise Refused("an event has no id")
        old = self.store.read("eventos", BRONZE)
        known = self._repeats(old, events)
        if known == "conflict":
            raise Refused("an event id was used again with other content")
        same = typed(old.join(F.broadcast(events.select("entidade").distinct()), "entidade", "left_semi").select(*events.columns).unionByName(events))  # a version's rows are of one entity
        if not changes.conflicts(same.where("chave is not null and revisao is not null"), ["entidade", "chave", "revisao"], ["hash_conteudo"]).isEmpty():
            raise Refused("a version of a document is ambiguous")
        new = events
        if known == "again":
            new = changes.insert_only(old, events, ["id_evento"]).persist()
            held.append(new)
        dimensions = {k: self.store.read(f"dim_{k}") for k in ("clientes", "vendedores", "produtos")}
        at = Position(old.unionByName(new), dimensions, keep=True)
        held.append(at.current)
        counted: dict[str, int] = {}
        self.store.commit(replaced={"quarentena": at.quarantine()}, appended={"eventos": new}, counted=counted)
        if not at.excess().isEmpty():
            raise Refused("more was consumed than a document holds; the silver tables stay as they were")
        synced = {}
        for name, (key, rows) in at.silver().items():
            synced[name] = changes.full_sync(self.store.read(name, rows.schema), rows, [key], "versao").select(*rows.columns)
        self.store.commit(replaced=synced, state={"data_corte": cutoff}, counted=counted)
        return {"eventos_bronze": self.store.read("eventos").count(), "quarentena": counted["quarentena"], "pedidos": counted["pedidos"]}

    def position(self, cutoff: str | None = None) -> DataFrame:
        return order_position(*[self.store.read(k) for k in ("pedidos", "faturamentos", "devolucoes")], cutoff or self.store.manifest()["state"]["data_corte"])

    def runs(self) -> DataFrame:
        """The execution log, newest first."""
        return self.store.read("execucoes", RUNS).orderBy(F.desc("registrado_em"))
