"""The commercial domain over the driver's tables: sales, targets, forecasts, returns, histories, orders and items."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commerce_spark.functions.scalar import month

FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-08-01"
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


class Tables:
    """Lazy readers of one folder's tables. `given` holds DataFrames that stand in for views of this module, by name."""

    def __init__(self, spark: SparkSession, folder: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.given = spark, folder, given or {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    @wraps(f)
    def found(t: Tables) -> DataFrame:
        return t.given[f.__name__] if f.__name__ in t.given else f(t)

    return found


def cents(name: str) -> F.Column:
    return F.col(name).cast("decimal(12,2)")


@view
def sales(t: Tables) -> DataFrame:
    """One row a line: entry, date, month, customer, seller, product, exact revenue, cost and margin, status."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("sale_date"))
    p = t.part.select("p_partkey", cents("p_retailprice").alias("price"))
    revenue = (cents("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    quantity = F.col("l_quantity").cast("long")
    rows = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select(
        F.col("l_orderkey").alias("entry"), "l_linenumber", "sale_date", month(F.col("sale_date")).alias("month"), F.col("o_custkey").alias("customer"),
        F.col("l_suppkey").alias("seller"), F.col("l_partkey").alias("product"), quantity.alias("quantity"), revenue.alias("revenue"),
        (quantity.cast("decimal(10,0)") * F.col("price")).cast("decimal(18,4)").alias("cost"),
        F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("invoiced").alias("status"),
    ).withColumn("margin", (F.col("revenue") - F.col("cost")).cast("decimal(18,4)"))


def invoiced(t: Tables) -> DataFrame:
    return sales(t).where("status = 'invoiced'")


@view
def months(t: Tables) -> DataFrame:
    from commerce_spark.operators import temporal

    return temporal.months(t.spark, FIRST_MONTH, LAST_MONTH)


@view
def targets(t: Tables) -> DataFrame:
    """A target for each seller and month: 115000 + 2500 by month + 7000 by seller modulo 10."""
    w = months(t).select(F.col("competencia").alias("month"), (F.year("competencia") * 12 + F.month("competencia") - 1995 * 12 - 1).alias("i"))
    value = (F.lit(115000) + F.col("i") * 2500 + F.col("seller") % 10 * 7000).cast("decimal(18,2)")
    return t.supplier.select(F.col("s_suppkey").alias("seller")).crossJoin(F.broadcast(w)).select("month", "seller", value.alias("target"))


@view
def forecasts(t: Tables) -> DataFrame:
    """A forecast for each month at horizons of 30, 60 and 120 days."""
    w = months(t).select(F.col("competencia").alias("month"), (F.year("competencia") * 12 + F.month("competencia") - 1995 * 12 - 1).alias("i"))
    h = w.withColumn("horizon", F.explode(F.array(F.lit(30), F.lit(60), F.lit(120))))
    share = (F.lit(100) + (F.col("i") + F.col("horizon")) % 7 - 3).cast("decimal(5,0)")
    value = ((F.lit(510000) + F.col("i") * 9500).cast("decimal(12,0)") * share / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,4)")
    return h.select(F.add_months("month", (-F.col("horizon") / 30).cast("int")).alias("issued"), "month", "horizon", value.alias("forecast"))


@view
def returns(t: Tables) -> DataFrame:
    """A return for each line flagged R: half its quantity, up, and its proportion of the revenue."""
    r = t.lineitem.where("l_returnflag = 'R'")
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("sale_date"), "o_orderstatus")
    q = F.col("l_quantity").cast("long")
    back = F.ceil(q / 2).cast("long")
    revenue = (cents("l_extendedprice") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    value = (revenue * back.cast("decimal(10,0)") / q.cast("decimal(10,0)")).cast("decimal(18,2)")
    return r.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("seller"), month(F.col("sale_date")).alias("month"), F.col("l_shipdate").cast("date").alias("returned"), back.alias("quantity"), value.alias("value"), (F.col("o_orderstatus") == "P").alias("cancelled")
    )


@view
def customer_history(t: Tables) -> DataFrame:
    """Type-2 history: seller, region and activity of each customer by [valid_from, valid_to).

    Keys divisible by 10 change seller on 1998-07-01; keys that leave 3 on division by 50 end on 1999-09-01.
    """
    n = F.broadcast(t.supplier.agg(F.count(F.lit(1)).alias("n")))
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("regiao"))
    c = t.customer.join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey"), "left").crossJoin(n)
    k, start = F.col("c_custkey"), F.lit("1994-12-01").cast("timestamp")
    base = c.select(k.alias("id_cliente"), F.col("c_name").alias("nome"), (k % F.col("n") + 1).alias("_seller"), ((k + 1) % F.col("n") + 1).alias("_next"), "regiao")
    moved, left = F.lit("1998-07-01").cast("timestamp"), F.lit("1999-09-01").cast("timestamp")
    version = lambda at, seller, active: F.struct(at.alias("at"), seller.alias("id_vendedor"), active.alias("ativo"))
    first = version(start, F.col("_seller"), F.lit(True))
    moves, leaves = F.col("id_cliente") % 10 == 0, F.col("id_cliente") % 50 == 3
    versions = F.when(moves, F.array(first, version(moved, F.col("_next"), F.lit(True)))).when(leaves, F.array(first, version(left, F.col("_seller"), F.lit(False)))).otherwise(F.array(first))
    rows = base.withColumn("v", F.explode(versions)).select("id_cliente", "nome", "v.id_vendedor", "regiao", "v.ativo", F.col("v.at").alias("valid_from"))
    w = Window.partitionBy("id_cliente").orderBy("valid_from")
    rows = rows.withColumn("valid_to", F.lead("valid_from").over(w))
    return rows.select(F.concat_ws("-", F.col("id_cliente").cast("string"), F.date_format("valid_from", "yyyyMMdd")).alias("chave_cliente"), "id_cliente", "nome", "id_vendedor", "regiao", "ativo", "valid_from", "valid_to")


@view
def items(t: Tables) -> DataFrame:
    """Order items with exact money; the item's name is its order, part, supplier and line."""
    gross = cents("l_extendedprice").cast("decimal(18,4)")
    off = (cents("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    return t.lineitem.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in LINE]).alias("id_item"), F.col("l_orderkey").alias("id_pedido"), F.col("l_partkey").alias("id_produto"),
        F.col("l_quantity").cast("long").alias("quantidade"), gross.alias("valor_bruto"), off.alias("valor_desconto"), (gross - off).cast("decimal(18,4)").alias("valor_liquido"),
    )


@view
def orders(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id_pedido"), F.col("o_custkey").alias("id_cliente"), F.col("o_orderdate").cast("timestamp").alias("emitido_em"), F.when(F.col("o_orderstatus") == "P", "cancelado").otherwise("faturado").alias("status"))
