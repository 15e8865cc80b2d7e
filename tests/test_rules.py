"""Every rule of the gate and every reason of the quarantine, each on data that breaks just it; exact recomputation in plain decimals."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from commerce_spark.operators.checks import SALES, violations
from commerce_spark.plans import kpi, lakehouse
from commerce_spark.plans.incremental import Runs
from commerce_spark.plans.views import Tables
from commerce_spark.registry import ENTITIES
from commerce_spark.sources import generators

AT, DAY = dt.datetime(2026, 1, 1, 10, tzinfo=dt.timezone.utc), dt.date(2026, 1, 1)
SOUND = {
    "vendedores": [{"id_vendedor": 1, "nome": "Ana", "ativo": True, "equipe": "E", "regiao": "R"}],
    "clientes": [{"id_cliente": 1, "nome": "Loja", "uf": "SP", "cidade": "C", "segmento": "S"}],
    "produtos": [{"id_produto": 1, "descricao": "Caixa", "categoria": "C"}],
    "vendas": [{"id_lancamento": k, "id_vendedor": 1, "id_cliente": 1, "id_produto": 1, "data_venda": DAY, "quantidade": 5, "valor_bruto": Decimal(100), "valor_desconto": Decimal(10), "valor_liquido": Decimal(90), "cancelado": k == 2} for k in (1, 2)],
    "devolucoes": [{"id_devolucao": k, "id_lancamento": 1, "data_devolucao": DAY, "quantidade": 2, "valor_devolvido": Decimal(40), "motivo": "avaria"} for k in (1, 2)],
    "metas": [{"id_meta": 1, "id_vendedor": 1, "competencia": DAY, "valor_meta": Decimal(5)}],
}
CASES = [
    ("vendedores", {"id_vendedor": 0}, {("vendedores", "0", "chave não positiva"), ("vendas", "1", "id_vendedor sem dimensão"), ("vendas", "2", "id_vendedor sem dimensão"), ("metas", "1", "id_vendedor sem dimensão")}),
    ("clientes", {"uf": "sp"}, {("clientes", "1", "UF inválida")}),
    ("clientes", {"uf": "SPX"}, {("clientes", "1", "UF inválida")}),
    ("clientes", {"id_cliente": 9}, {("vendas", "1", "id_cliente sem dimensão"), ("vendas", "2", "id_cliente sem dimensão")}),
    ("produtos", {"id_produto": 9}, {("vendas", "1", "id_produto sem dimensão"), ("vendas", "2", "id_produto sem dimensão")}),
    ("vendas", {"quantidade": 0}, {("vendas", "1", "quantidade ou valores inválidos"), ("devolucoes", "1", "acumulado superior à venda")}),
    ("vendas", {"valor_desconto": Decimal(-1), "valor_liquido": Decimal(101)}, {("vendas", "1", "quantidade ou valores inválidos")}),
    ("vendas", {"valor_liquido": Decimal(91)}, {("vendas", "1", "líquido divergente")}),
    ("metas", {"valor_meta": Decimal(-1)}, {("metas", "1", "valor/competência inválido")}),
    ("metas", {"competencia": dt.date(2026, 1, 2)}, {("metas", "1", "valor/competência inválido")}),
    ("metas", [{"id_meta": 2, "id_vendedor": 1, "competencia": DAY, "valor_meta": Decimal(6)}], {("metas", "1/2026-01-01", "Mais de uma meta para vendedor e competência")}),
    ("devolucoes", {"id_lancamento": 7}, {("devolucoes", "1", "lançamento sem venda")}),
    ("devolucoes", {"id_lancamento": 2}, {("devolucoes", "1", "venda cancelada")}),
    ("devolucoes", {"quantidade": 0}, {("devolucoes", "1", "quantidade ou valor inválido")}),
    ("devolucoes", {"valor_devolvido": Decimal(0)}, {("devolucoes", "1", "quantidade ou valor inválido")}),
    ("devolucoes", {"data_devolucao": dt.date(2025, 12, 31)}, {("devolucoes", "1", "data ou motivo inválido")}),
    ("devolucoes", {"motivo": " "}, {("devolucoes", "1", "data ou motivo inválido")}),
    ("devolucoes", {"quantidade": 4}, {("devolucoes", "1", "acumulado superior à venda")}),
    ("devolucoes", {"valor_devolvido": Decimal("50.01")}, {("devolucoes", "1", "acumulado superior à venda")}),
]


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    return Runs(spark, str(tmp_path_factory.mktemp("rules")))


def frame(spark, name, rows):
    e = ENTITIES[name]
    return spark.createDataFrame([tuple(r[c] for c in e.columns) + (r.get("atualizado_em", AT),) for r in rows], e.schema)


def found(spark, monkeypatch, runs, rows, published=None):
    frames = {n: frame(spark, n, v) for n, v in rows.items()}
    monkeypatch.setattr(runs, "candidate", lambda run, n: frames[n])
    monkeypatch.setattr(runs, "staged", lambda run, n: frames[n])
    monkeypatch.setattr(runs, "published", lambda n, months=None: frame(spark, n, (published or {}).get(n, [])))
    return {tuple(r) for r in runs.violations("r").collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_each_rule_alone(spark, monkeypatch, runs, case):
    name, change, told = CASES[case]
    rows = dict(SOUND)
    rows[name] = [*SOUND[name], *change] if isinstance(change, list) else [SOUND[name][0] | change, *SOUND[name][1:]]
    assert found(spark, monkeypatch, runs, rows) == told


def test_sound_data_and_changes_without_an_instant(spark, monkeypatch, runs):
    assert found(spark, monkeypatch, runs, SOUND) == set() == found(spark, monkeypatch, runs, SOUND, SOUND)
    other = SOUND | {"produtos": [SOUND["produtos"][0] | {"categoria": "D"}]}
    assert found(spark, monkeypatch, runs, SOUND, other) == {("produtos", "1", "alteração sem atualizar timestamp")}
    later = SOUND | {"produtos": [SOUND["produtos"][0] | {"categoria": "D", "atualizado_em": AT - dt.timedelta(hours=1)}]}
    assert found(spark, monkeypatch, runs, SOUND, later) == set()


EVENT = dict.fromkeys(lakehouse.FIELDS) | {"id_registro": "1", "versao": "1", "atualizado_em": "2026-01-01T00:00:00Z", "quantidade": "2", "data_documento": "2026-01-01"}
ORDER = EVENT | {"entidade": "pedido", "id_cliente": "1", "id_vendedor": "1", "id_produto": "1", "preco_unitario": "1.00", "data_prevista": "2026-02-01", "status": "aberto"}
INVOICE = EVENT | {"entidade": "faturamento", "id_referencia": "1", "status": "faturado"}
RETURN = EVENT | {"entidade": "devolucao", "id_referencia": "1", "status": "confirmada"}
REASONS = [
    (ORDER, None), (INVOICE, None), (RETURN, None), (INVOICE | {"status": "estornado"}, None), (ORDER | {"status": "cancelado"}, None),
    *[(ORDER | {c: v}, "identificador_versao_ou_data_invalida") for c, v in (("id_registro", "0"), ("id_registro", "x"), ("id_registro", None), ("versao", "-1"), ("versao", "1.5"), ("atualizado_em", "ontem"), ("data_documento", "2026-13-01"))],
    *[(e | {"quantidade": q}, "quantidade_invalida") for e in (ORDER, INVOICE, RETURN) for q in ("0", "-2", "x", None)],
    *[(ORDER | {c: v}, "pedido_invalido") for c, v in (("preco_unitario", "0"), ("preco_unitario", None), ("data_prevista", "2025-12-31"), ("data_prevista", None), ("status", "faturado"), ("id_cliente", "9"), ("id_vendedor", None), ("id_produto", "x"))],
    *[(INVOICE | {c: v}, "faturamento_invalido") for c, v in (("status", "aberto"), ("status", None), ("id_referencia", "x"))],
    *[(RETURN | {c: v}, "devolucao_invalida") for c, v in (("status", "faturado"), ("id_referencia", None))],
    (ORDER | {"entidade": "troca"}, "entidade_invalida"), (ORDER | {"entidade": None}, "entidade_invalida"),
]


def test_every_reason(spark):
    rows = [tuple((e | {"id_evento": str(i)})[c] for c in lakehouse.FIELDS) for i, (e, _) in enumerate(REASONS)]
    dims = {f"{n}s" if n != "vendedor" else "vendedores": spark.createDataFrame([(1, "x")], f"id_{n} long, nome string") for n in ("cliente", "vendedor", "produto")}
    got = {int(r.id_evento): r.reason for r in lakehouse.evaluate(spark.createDataFrame(rows, lakehouse.EVENTS), dims).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(REASONS)}


def test_assertions_of_sales(spark):
    sales = generators.demonstration_sales(spark)
    assert violations(SALES, {"vendas": sales}).isEmpty()
    broken = sales.unionByName(sales.where("entry = 10001")).withColumns({"quantity": F.when(F.col("entry") == 10002, 0).otherwise(F.col("quantity")).cast("int"), "price": F.when(F.col("entry") == 10003, -1).otherwise(F.col("price")).cast("decimal(18,2)"), "entry": F.when(F.col("entry") != 10004, F.col("entry"))})
    assert {(r.key, r.rule) for r in violations(SALES, {"vendas": broken}).collect()} == {("10001", "unique entry"), ("10002", "quantity > 0"), ("10003", "price >= 0"), ("", "not null entry")}


def test_revenue_in_plain_decimals(spark, data):
    """The months' revenue again, line by line in Python's decimals, without Spark or SQL sums."""
    orders = dict(duckdb.sql(f"select o_orderkey, (o_orderstatus, strftime(o_orderdate, '%Y-%m-01')) from '{data}/orders.parquet'").fetchall())
    months: dict[str, Decimal] = defaultdict(Decimal)
    for key, price, off in duckdb.sql(f"select l_orderkey, cast(l_extendedprice as decimal(12,2))::varchar, cast(l_discount as decimal(4,2))::varchar from '{data}/lineitem.parquet'").fetchall():
        status, month = orders[key]
        if status != "P":
            months[month] += Decimal(price) * (1 - Decimal(off))
    got = {str(r.mes_referencia): r.faturamento for r in kpi.executive(Tables(spark, data)).select("mes_referencia", "faturamento").collect()}
    assert got == {m: float(v) for m, v in months.items()}
