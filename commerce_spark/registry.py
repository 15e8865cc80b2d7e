"""The entities of the incremental pipeline: key, typed columns, defaults for older payloads, and DDL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commerce_spark.functions import scalar
from commerce_spark.sources.store import Layout


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    columns: dict[str, str]
    defaults: dict[str, str] = field(default_factory=dict)
    refers: dict[str, str] = field(default_factory=dict)  # column -> entity
    month: str | None = None  # the date by whose month the table is laid out

    @property
    def layout(self) -> Layout:
        """By month where the entity has a date, and sorted by key."""
        return Layout((f"mes=date_format({self.month}, 'yyyy-MM')",) if self.month else (), (self.key,))

    @property
    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items()) + ", atualizado_em timestamp"

    def typed(self, rows: DataFrame) -> DataFrame:
        """Rows of text columns as typed columns, with `errors`: the columns that are missing or not of their type."""
        have = set(rows.columns)
        text = lambda c: F.coalesce(F.col(c) if c in have else F.lit(None).cast("string"), F.lit(self.defaults[c]) if c in self.defaults else F.lit(None).cast("string"))
        made = {c: _strict(t, text(c)) for c, t in self.columns.items()} | {"atualizado_em": scalar.strict_timestamp(text("atualizado_em"))}
        out = rows.select(*[v.alias(c) for c, v in made.items()])
        return out.withColumn("errors", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in made]), lambda x: x.isNotNull()))


def _strict(kind: str, c: Column) -> Column:
    if kind == "bigint":
        return scalar.strict_integer(c)
    if kind.startswith("decimal"):
        return scalar.strict_money(c)
    if kind == "date":
        return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    if kind == "boolean":  # as `fields` reads JSON's own booleans
        return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))
    return scalar.filled_text(c)


def fields(entity: Entity, payload: str = "payload") -> list[Column]:
    """The entity's columns and atualizado_em of a JSON payload, as text. A boolean counts only as JSON's own, not as a
    quoted word; a sale's net value is made of gross and discount, whatever the payload says."""
    wanted = [*entity.columns, "atualizado_em"]
    text = {c: F.get_json_object(payload, f"$.{c}") for c in wanted}
    for c in (c for c, kind in entity.columns.items() if kind == "boolean"):
        text[c] = F.from_json(payload, f"{c} boolean")[c].cast("string")
    if {"valor_bruto", "valor_desconto", "valor_liquido"} <= set(wanted):
        gross, off = (text[c].try_cast("decimal(38,8)") for c in ("valor_bruto", "valor_desconto"))
        text["valor_liquido"] = (gross - off).cast("decimal(38,8)").cast("string")
    return [text[c].alias(c) for c in wanted]


_UNKNOWN = "Não informado"
ENTITIES = {
    e.name: e
    for e in (
        Entity("vendedores", "id_vendedor", {"id_vendedor": "bigint", "nome": "string", "ativo": "boolean", "equipe": "string", "regiao": "string"}, {"equipe": _UNKNOWN, "regiao": _UNKNOWN}),
        Entity("clientes", "id_cliente", {"id_cliente": "bigint", "nome": "string", "uf": "string", "cidade": "string", "segmento": "string"}, {"cidade": _UNKNOWN, "segmento": _UNKNOWN}),
        Entity("produtos", "id_produto", {"id_produto": "bigint", "descricao": "string", "categoria": "string"}, {"categoria": _UNKNOWN}),
        Entity("vendas", "id_lancamento", {"id_lancamento": "bigint", "id_vendedor": "bigint", "id_cliente": "bigint", "id_produto": "bigint", "data_venda": "date", "quantidade": "bigint", "valor_bruto": scalar.MONEY, "valor_desconto": scalar.MONEY, "valor_liquido": scalar.MONEY, "cancelado": "boolean"}, refers={"id_vendedor": "vendedores", "id_cliente": "clientes", "id_produto": "produtos"}, month="data_venda"),
        Entity("devolucoes", "id_devolucao", {"id_devolucao": "bigint", "id_lancamento": "bigint", "data_devolucao": "date", "quantidade": "bigint", "valor_devolvido": scalar.MONEY, "motivo": "string"}, month="data_devolucao"),
        Entity("metas", "id_meta", {"id_meta": "bigint", "id_vendedor": "bigint", "competencia": "date", "valor_meta": scalar.MONEY}, refers={"id_vendedor": "vendedores"}),
    )
}
