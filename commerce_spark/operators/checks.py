"""Declared checks: all that is stated about a table's rows, compiled into one scan and one aggregation.

Every row is looked at once. It yields an item for each row rule that it breaks and one for each key that must be unique;
the items are counted together by rule and key, partial sums first, so a hot key is summed before it moves. References are
looked up by joins with the parents' keys on the way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    """What holds for a table: keys (the first names rows in violations), columns never null, accepted values, references
    (column -> (table, its key)) and conditions (rule -> SQL). Null passes accepted values and references, not conditions."""

    name: str
    key: str
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    accepted: dict[str, tuple] = field(default_factory=dict)
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)
    holds: dict[str, str] = field(default_factory=dict)
    told: dict[str, str] = field(default_factory=dict)  # rule -> what violations call it


def _row_rules(d: Declared) -> dict[str, Column]:
    """Rule -> whether a row breaks it."""
    out = {f"not null {c}": F.col(c).isNull() for c in d.not_null}
    out |= {f"accepted {c}": ~F.col(c).isin(*values) for c, values in d.accepted.items()}
    out |= {f"related {c}": F.col(c).isNotNull() & F.col(f"_known_{c}").isNull() for c in d.refers}
    return out | {rule: ~F.expr(sql) for rule, sql in d.holds.items()}


def _broken(rule: str, c: Column, d: Declared) -> Column:
    return ~F.coalesce(~c, F.lit(False)) if rule in d.holds else F.coalesce(c, F.lit(False))


def violations(d: Declared, tables: dict[str, DataFrame]) -> DataFrame:
    """entity, key, rule, rows: each broken rule by key, with the number of rows. `tables` has the table and its parents.

    A null key is the empty text; an empty table breaks nothing."""
    df = tables[d.name]
    for c, (parent, parent_key) in d.refers.items():
        keys = tables[parent].select(F.col(parent_key).alias(c)).distinct().withColumn(f"_known_{c}", F.lit(True))
        df = df.join(keys, c, "left")
    name = F.coalesce(F.col(d.key).cast("string"), F.lit(""))
    item = lambda rule, key, exact, least: F.struct(F.lit(rule).alias("rule"), key.alias("key"), exact.alias("exact"), F.lit(least).alias("least"))
    items = [F.when(_broken(rule, c, d), item(rule, name, name, 1)) for rule, c in _row_rules(d).items()]
    exact = lambda keys: F.to_json(F.array(*[F.col(c).cast("string") for c in keys]))  # noqa: E731  (null, 1) isn't (1, null)
    items += [item(f"unique {', '.join(keys)}", F.concat_ws("/", *keys), exact(keys), 2) for keys in d.unique]
    if not items:
        raise ValueError(f"nothing is declared of {d.name}")
    found = df.select(F.explode(F.array_compact(F.array(*items))).alias("i")).groupBy("i.rule", "i.key", "i.exact", "i.least").agg(F.count(F.lit(1)).alias("rows"))
    rule = F.coalesce(*[F.when(F.col("rule") == k, v) for k, v in d.told.items()], F.col("rule"))
    return found.where("rows >= least").select(F.lit(d.name).alias("entity"), "key", rule.alias("rule"), "rows")


def report(found: DataFrame, shown: int = 20) -> DataFrame:
    """entity, rule, keys (how many break it), rows, sample: the first `shown` keys. Ranks are cut before the shuffle, so no
    task holds all the keys of a rule."""
    first = Window.partitionBy("entity", "rule").orderBy("key")
    some = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= shown).groupBy("entity", "rule").agg(F.array_sort(F.collect_list("key")).alias("sample"))
    return found.groupBy("entity", "rule").agg(F.count(F.lit(1)).alias("keys"), F.sum("rows").alias("rows")).join(some, ["entity", "rule"])


def checked(declared: list[Declared], tables: dict[str, DataFrame]) -> DataFrame:
    """The violations of several tables."""
    out = violations(declared[0], tables)
    for d in declared[1:]:
        out = out.unionByName(violations(d, tables))
    return out


#: What a load asserts of the demonstration sales (the columns of `sources.generators.demonstration_sales`).
SALES = Declared("vendas", "entry", unique=(("entry",),), not_null=("entry",), holds={"quantity > 0": "quantity > 0", "price >= 0": "price >= 0"})

#: What the portfolio's sources state of themselves, in the columns of `plans.views`.
SOURCES = [
    Declared("clientes", "id_cliente", unique=(("id_cliente",),), not_null=("id_cliente", "atualizado_em", "id_vendedor"), refers={"id_vendedor": ("vendedores", "id_vendedor")}),
    Declared("vendedores", "id_vendedor", unique=(("id_vendedor",),), not_null=("id_vendedor",)),
    Declared("produtos", "id_produto", unique=(("id_produto",),), not_null=("id_produto",)),
    Declared("pedidos", "id_pedido", unique=(("id_pedido",),), not_null=("id_pedido", "id_cliente"), accepted={"status": ("faturado", "cancelado")}, refers={"id_cliente": ("clientes", "id_cliente")}),
    Declared("itens_pedidos", "id_item", unique=(("id_item",),), not_null=("id_item",), refers={"id_pedido": ("pedidos", "id_pedido"), "id_produto": ("produtos", "id_produto")}),
]
