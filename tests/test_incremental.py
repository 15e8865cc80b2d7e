from __future__ import annotations

import json

import pytest

from commerce_spark import registry
from commerce_spark.plans.incremental import Runs

DAY1, DAY2 = "2026-01-02T00:00:00+00:00", "2026-01-03T00:00:00+00:00"


def base(at="2026-01-01T10:00:00Z"):
    sale = lambda k, gross, off, **x: {"id_lancamento": k, "id_vendedor": 1, "id_cliente": 1, "id_produto": 1, "data_venda": "2026-01-01", "quantidade": 2, "valor_bruto": f"{gross}.00", "valor_desconto": f"{off}.00", "valor_liquido": f"{gross - off}.00", "cancelado": False, "atualizado_em": at} | x
    return {
        "vendedores": [{"id_vendedor": 1, "nome": "Ana", "ativo": True, "atualizado_em": at}],
        "clientes": [{"id_cliente": 1, "nome": "Loja", "uf": "SP", "atualizado_em": at}],
        "produtos": [{"id_produto": 1, "descricao": "Caixa", "atualizado_em": at}],
        "vendas": [sale(1, 200, 20), sale(2, 270, 20)],
        "devolucoes": [],
        "metas": [{"id_meta": 1, "id_vendedor": 1, "competencia": "2026-01-01", "valor_meta": "500.00", "atualizado_em": at}],
    }


def source(spark, rows):
    return lambda entity, low, high: spark.createDataFrame([(json.dumps(r),) for r in rows.get(entity, [])], "payload string")


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    r = Runs(spark, str(tmp_path_factory.mktemp("runs")))
    r.execute("d1", DAY1, source(spark, base()))
    return r


def total(runs):
    r = runs.published("vendas").selectExpr("count(*)", "count_if(cancelado)", "sum(if(cancelado, 0, valor_liquido))").first()
    return r[0], r[1], float(r[2])


def test_life_of_runs(spark, runs):
    assert total(runs) == (2, 0, 430.0)
    assert set(runs.watermarks().values()) == {DAY1}
    assert runs.published("clientes").first().cidade == "Não informado"
    runs.execute("d1", DAY1, source(spark, base()))  # a success is final
    with pytest.raises(ValueError, match="another end"):
        runs.begin("d1", DAY2)
    with pytest.raises(ValueError, match="before a watermark"):
        runs.begin("old", "2026-01-01T00:00:00+00:00")
    with pytest.raises(ValueError, match="offset"):
        runs.begin("naive", "2026-01-05T00:00:00")
    assert runs.begin("d2", DAY2)["limits"]["vendas"] == "2026-01-01T23:55:00+00:00"

    at = "2026-01-02T09:00:00Z"
    sales = base(at)["vendas"]
    changed = [sales[0] | {"cancelado": True}, sales[0] | {"id_lancamento": 3, "valor_bruto": "100.00", "valor_desconto": "110.00", "valor_liquido": "90.00"}]
    with pytest.raises(ValueError, match="quantidade ou valores inválidos"):
        runs.execute("d2", DAY2, source(spark, {"vendas": changed}))
    assert total(runs) == (2, 0, 430.0) and runs.begin("d2", DAY2)["status"] == "falha"
    fixed = changed[1] | {"valor_desconto": "0.00", "atualizado_em": "2026-01-02T09:30:00Z"}
    runs.execute("d2", DAY2, source(spark, {"vendas": [fixed]}))  # the newer version heals the run
    assert total(runs) == (3, 1, 350.0)
    assert runs.monitor()["execucoes"].count() == 2


def test_gates(spark, runs):
    end = "2026-01-04T00:00:00+00:00"
    at = "2026-01-03T08:00:00Z"
    back = {"id_devolucao": 1, "id_lancamento": 2, "data_devolucao": "2026-01-03", "quantidade": 1, "valor_devolvido": "100.00", "motivo": "avaria", "atualizado_em": at}
    with pytest.raises(RuntimeError, match="before publication"):
        runs.begin("d3", end)
        runs.add_raw("d3", "devolucoes", source(spark, {"devolucoes": [back]})("devolucoes", 0, 0))
        runs.stage("d3")
        runs.approve("d3")
        runs.publish("d3", fail_after=3)
    assert runs.published("devolucoes").count() == 0 and set(runs.watermarks().values()) == {DAY2}
    runs.publish("d3")
    assert runs.published("devolucoes").count() == 1
    later = "2026-01-05T00:00:00+00:00"
    two = back | {"id_devolucao": 2, "quantidade": 2, "atualizado_em": "2026-01-04T08:00:00Z"}
    with pytest.raises(ValueError, match="acumulado superior à venda"):  # over published and new rows together
        runs.execute("d4", later, source(spark, {"devolucoes": [two]}))
    with pytest.raises(ValueError, match="outside the window"):
        runs.execute("d5", later, source(spark, {"devolucoes": [two | {"atualizado_em": later}]}))
    with pytest.raises(ValueError, match="different contents"):
        runs.execute("d6", later, source(spark, {"metas": [{"id_meta": 9, "id_vendedor": 1, "competencia": "2026-02-01", "valor_meta": v, "atualizado_em": "2026-01-04T08:00:00Z"} for v in ("1.00", "2.00")]}))
    with pytest.raises(ValueError, match="valor_meta"):
        runs.execute("d7", later, source(spark, {"metas": [{"id_meta": 9, "id_vendedor": 1, "competencia": "2026-02-01", "valor_meta": "1.005", "atualizado_em": "2026-01-04T08:00:00Z"}]}))
    runs.execute("d8", later, source(spark, {}))  # an empty run advances the watermark
    assert set(runs.watermarks().values()) == {later}


@pytest.mark.parametrize(("changed", "column"), [({"cancelado": "true"}, "cancelado"), ({"cancelado": 1}, "cancelado"), ({"quantidade": "02"}, "quantidade"), ({"valor_bruto": "1.234"}, "valor_liquido"), ({"data_venda": "01/01/2026"}, "data_venda"), ({"id_cliente": None}, "id_cliente")])
def test_typed_intake_rejects(spark, changed, column):
    e = registry.ENTITIES["vendas"]
    rows = [(json.dumps(r),) for r in (base()["vendas"][0] | changed, base()["vendas"][1])]
    typed = e.typed(spark.createDataFrame(rows, "payload string").select(*registry.fields(e))).orderBy("id_lancamento")
    assert [column in r.errors for r in typed.collect()] == [True, False]


def test_net_value_is_derived_and_money_is_wide(spark, tmp_path):
    rows = base()
    del rows["vendas"][0]["valor_liquido"]
    rows["vendas"][1] |= {"valor_bruto": "99999999999999999999999999999.99", "valor_desconto": "0.01", "valor_liquido": "1.00"}
    r = Runs(spark, str(tmp_path / "r"))
    r.execute("d1", DAY1, source(spark, rows))
    assert [str(x.valor_liquido) for x in r.published("vendas").orderBy("id_lancamento").collect()] == ["180.00", "99999999999999999999999999999.98"]
