"""The command line: create the tables, run a load, watch the runs.

    python -m commerce_spark bootstrap --pasta STORE
    python -m commerce_spark executar --pasta STORE --execucao dia-1 --fim 2026-09-02T00:00:00Z --arquivos FOLDER
    python -m commerce_spark executar --pasta STORE --execucao dia-1 --fim … --erp psycopg --argumentos '{"conninfo": "…"}' --metas http://host:8000
    python -m commerce_spark monitorar --pasta STORE
"""

from __future__ import annotations

import argparse
import json
import logging
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commerce_spark.plans.incremental import Runs, Source
from commerce_spark.registry import ENTITIES
from commerce_spark.session import session
from commerce_spark.sources import rest
from commerce_spark.sources.files import jsonl
from commerce_spark.sources.keyset import keyset


def from_files(spark: SparkSession, folder: str) -> Source:
    """Payloads in FOLDER/<entity>.jsonl, the window cut out of each file."""

    def source(entity: str, low: datetime, high: datetime) -> DataFrame:
        rows = spark.read.text(f"{folder}/{entity}.jsonl").where("trim(value) <> ''").select(F.col("value").alias("payload"))
        at = F.get_json_object("payload", "$.atualizado_em").try_cast("timestamp")
        return rows.where(at.isNull() | ((at >= F.lit(low)) & (at < F.lit(high))))  # a row without a time is the run's to refuse

    return source


def from_database(spark: SparkSession, driver: str, arguments: list | dict, schema: str | None = None) -> Source:
    """Payloads of a database's tables, by keyset pages in one snapshot."""

    def source(entity: str, low: datetime, high: datetime) -> DataFrame:
        e = ENTITIES[entity]
        kinds = {c: "boolean" if k == "boolean" else "bigint" if c == e.key else "string" for c, k in e.columns.items()} | {"atualizado_em": "timestamp"}
        rows = keyset(spark, ", ".join(f"{c} {k}" for c, k in kinds.items()), driver, arguments, f"{schema}.{entity}" if schema else entity, "atualizado_em", e.key, low=low.isoformat(), high=high.isoformat())
        return rows.select(F.to_json(F.struct("*")).alias("payload"))

    return source


def with_goals(erp: Source, spark: SparkSession, url: str) -> Source:
    """The ERP's entities from it, and the goals from their service."""

    def source(entity: str, low: datetime, high: datetime) -> DataFrame:
        if entity != "metas":
            return erp(entity, low, high)
        spark.dataSource.register(rest.RestSource)
        fields = "id_meta bigint, id_vendedor bigint, competencia string, valor_meta string, atualizado_em string"
        rows = spark.read.format(rest.RestSource.name()).option("url", url).option("fields", fields).option("windows", json.dumps([[low.isoformat(), high.isoformat()]])).load()
        return rows.select(F.to_json(F.struct("*")).alias("payload"))

    return source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="commerce_spark", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="comando", required=True)
    for name in ("bootstrap", "executar", "monitorar"):
        c = commands.add_parser(name)
        c.add_argument("--pasta", required=True, help="folder of the store")
        if name == "executar":
            c.add_argument("--execucao", required=True)
            c.add_argument("--fim", required=True, help="instant with its offset; the window ends before it")
            given = c.add_mutually_exclusive_group(required=True)
            given.add_argument("--arquivos", help="folder of <entity>.jsonl")
            given.add_argument("--erp", help="module of a DB-API driver")
            c.add_argument("--argumentos", type=json.loads, default=[], help="JSON list or object for the driver's connect")
            c.add_argument("--esquema", help="schema of the ERP's tables")
            c.add_argument("--metas", help="URL of the goals' service")
    return p


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = session()
    runs = Runs(spark, a.pasta)
    if a.comando == "bootstrap":
        told = {"tabelas": runs.bootstrap()}
    elif a.comando == "executar":
        source = from_files(spark, a.arquivos) if a.arquivos else from_database(spark, a.erp, a.argumentos, a.esquema)
        runs.execute(a.execucao, a.fim, with_goals(source, spark, a.metas) if a.metas else source)
        told = {"execucao": a.execucao, "status": runs.status(a.execucao), "marcas": runs.watermarks()}
    else:
        told = {k: [r.asDict() for r in df.collect()] for k, df in runs.monitor().items()}
    print(json.dumps(told, ensure_ascii=False, default=str))
    return told


if __name__ == "__main__":
    main()
