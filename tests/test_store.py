"""The store: layouts, pruning, overwrite of single partitions, guarded corrections, second publication, keeping house."""

from __future__ import annotations

import datetime as dt
import json
import logging

import pytest
from pyspark.sql import functions as F

from commerce_spark.operators.telemetry import Watched, stage_event
from commerce_spark.plans.incremental import Runs
from commerce_spark.plans.sandbox import Sandbox, enforced, unbilled
from commerce_spark.registry import ENTITIES
from commerce_spark.sources.store import Layout, Store
from tests.test_incremental import DAY1, DAY2, base, source

MONTHLY = Layout(("mes=date_format(dia, 'yyyy-MM')",), ("k",))


def rows(spark, items):
    return spark.createDataFrame([(k, dt.date.fromisoformat(d), v) for k, d, v in items], "k long, dia date, v string")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def files(df):
    return set(df.inputFiles())


def test_layout_prunes_reads(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    items = [(k, f"2026-{1 + k % 4:02d}-10", "x") for k in range(80)]
    s.commit(replaced={"t": rows(spark, items)}, layouts={"t": MONTHLY})
    whole, one = s.read("t"), s.read("t", where={"mes": ["2026-02"]})
    assert whole.columns == ["k", "dia", "v"] and whole.count() == 80 and one.count() == 20
    assert files(one) < files(whole) and all("mes=2026-02" in f for f in one.inputFiles())
    assert [p["mes"] for p in s.partitions("t")] == [f"2026-{m:02d}" for m in range(1, 5)]
    assert [r.k for r in spark.read.parquet(one.inputFiles()[0]).collect()] == list(range(1, 80, 4))  # sorted inside
    with pytest.raises(ValueError, match="partition columns"):
        s.read("t", where={"dia": ["2026-02-10"]})

    own = rows(spark, items).withColumn("lote", F.col("k") % 3)
    s.commit(replaced={"u": own}, layouts={"u": Layout(("lote",))})
    found = s.read("u").where("lote = 2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lote" in plan and found.count() == 26
    scan = [m for m in plan.splitlines() if "PartitionFilters" in m][0]
    assert "lote" in scan and dict(s.read("u").dtypes)["lote"] == "bigint"


def test_one_partition_gives_way(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.commit(replaced={"t": rows(spark, [(1, "2026-01-01", "a"), (2, "2026-02-01", "a"), (3, "2026-03-01", "a")])}, layouts={"t": MONTHLY})
    before = {m: s.folders("t", {"mes": [m]}) for m in ("2026-01", "2026-02", "2026-03")}
    s.commit(overwritten={"t": rows(spark, [(9, "2026-02-05", "b")])}, emptied={"t": [{"mes": "2026-03"}]})
    assert held(s.read("t")) == [(1, dt.date(2026, 1, 1), "a"), (9, dt.date(2026, 2, 5), "b")]
    assert s.folders("t", {"mes": ["2026-01"]}) == before["2026-01"] and s.folders("t", {"mes": ["2026-02"]}) != before["2026-02"]
    assert s.folders("t", {"mes": ["2026-03"]}) == [] and s.read("t", version=1).count() == 3  # versions stay readable
    s.commit(appended={"t": rows(spark, [(4, "2026-01-09", "c")])})
    assert len(s.folders("t", {"mes": ["2026-01"]})) == 2
    with pytest.raises(ValueError, match="lies otherwise"):
        s.commit(appended={"t": rows(spark, [])}, layouts={"t": Layout(("v",))})
    s.commit(replaced={"p": spark.range(2)})
    with pytest.raises(ValueError, match="no partitions"):
        s.commit(overwritten={"p": spark.range(2)})
    with pytest.raises(ValueError, match="layout makes"):
        s.commit(replaced={"q": rows(spark, []).withColumn("mes", F.lit(1))}, layouts={"q": MONTHLY})


def test_odd_partition_values(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    odd = [("a b/c=d%", 1), (None, 2), ("ç'é", 3), ("2026-01", 4)]
    s.commit(replaced={"t": spark.createDataFrame(odd, "p string, n long")}, layouts={"t": Layout(("p",))})
    assert sorted((r.p or "", r.n) for r in s.read("t").collect()) == sorted((p or "", n) for p, n in odd)
    for p, n in odd:
        assert [r.n for r in s.read("t", where={"p": [p]}).collect()] == [n]
    s.commit(overwritten={"t": spark.createDataFrame([("a b/c=d%", 9)], "p string, n long")}, emptied={"t": [{"p": None}]})
    assert sorted(r.n for r in s.read("t").collect()) == [3, 4, 9]
    s.commit(replaced={"e": spark.createDataFrame([], "p string, n long")}, layouts={"e": Layout(("p",))})
    assert s.read("e").count() == 0 and s.read("e").columns == ["p", "n"]
    s.commit(replaced={"b": spark.createDataFrame([(True, 1), (False, 2)], "p boolean, n long")}, layouts={"b": Layout(("p",))})
    assert [r.n for r in s.read("b", where={"p": [True]}).collect()] == [1]


def test_writers_notice_each_other(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    with pytest.raises(RuntimeError, match="another writer"):
        a.commit(replaced={"t": spark.range(1)}, before=lambda: b.commit(replaced={"t": spark.range(5)}))
    assert a.read("t").count() == 5


def test_load_once_tries_again(spark, tmp_path, monkeypatch):
    s, df = Store(spark, str(tmp_path / "s")), spark.range(3)
    real, calls = Store.commit, []

    def flaky(self, **what):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("the network went away")
        return real(self, **what)

    monkeypatch.setattr(Store, "commit", flaky)
    assert s.load_once("t", df, wait=0) and len(calls) == 3 and not s.load_once("t", df)
    calls.clear()

    def always(self, **what):
        calls.append(1)
        raise OSError("gone")

    monkeypatch.setattr(Store, "commit", always)
    with pytest.raises(OSError, match="gone"):
        s.load_once("t", spark.range(4), wait=0)
    assert len(calls) == 3


def test_corrections_swap_all_or_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    goals = spark.createDataFrame([(1, dt.date(2026, 9, 1), 1200), (2, dt.date(2026, 9, 1), 800), (3, dt.date(2026, 8, 1), 5)], "id long, mes date, valor long")
    s.commit(replaced={"metas": goals}, layouts={"metas": Layout(("mes",), ("id",))})
    fix = lambda *items: spark.createDataFrame(list(items), "id long, before array<long>, after long")
    august = s.folders("metas", {"mes": ["2026-08-01"]})
    versions = s.versions()
    with pytest.raises(ValueError, match="1 of 2 rows"):
        s.corrected("metas", "id", fix((1, [1200], 23040), (2, [999], 24480)), "valor")
    with pytest.raises(ValueError, match="0 of 1"):
        s.corrected("metas", "id", fix((7, [1], 2)), "valor")
    with pytest.raises(ValueError, match="twice"):
        s.corrected("metas", "id", fix((1, [1200], 1), (1, [1200], 2)), "valor")
    assert s.versions() == versions
    both = fix((1, [1200], 23040), (2, [800, 801], 24480))
    assert s.corrected("metas", "id", both, "valor") == 2 and s.corrected("metas", "id", both, "valor") == 0
    assert [(r.id, r.valor) for r in s.read("metas").orderBy("id").collect()] == [(1, 23040), (2, 24480), (3, 5)]
    assert s.folders("metas", {"mes": ["2026-08-01"]}) == august  # partitions without a correction keep their files
    s.commit(replaced={"flat": goals})
    assert s.corrected("flat", "id", fix((3, [5], 6)), "valor") == 1 and s.read("flat").where("id = 3").first().valor == 6


def test_keeping_house(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for k in range(5):
        s.commit(appended={"t": rows(spark, [(k, "2026-01-01", "a")] + ([(9, "2026-02-01", "b")] if k == 0 else []))}, layouts={"t": MONTHLY})
    lone = s.folders("t", {"mes": ["2026-02"]})
    assert len(s.folders("t")) == 6 and s.compact("t", most=4) == 1 and s.compact("t", most=4) == 0
    assert len(s.folders("t")) == 2 and s.folders("t", {"mes": ["2026-02"]}) == lone and s.read("t").count() == 6
    with pytest.raises(RuntimeError):
        s.commit(replaced={"t": rows(spark, [])}, fail_after=1)
    assert s.vacuum(keep=1) == 5 and s.read("t").count() == 6 and len(s.versions()) == 1  # four appends and the broken commit


# --- runs over the store -------------------------------------------------------------------------------------


def test_runs_touch_their_own_partitions(spark, tmp_path):
    r = Runs(spark, str(tmp_path / "r"))
    first = base()
    first["vendas"].append(first["vendas"][0] | {"id_lancamento": 5, "data_venda": "2025-11-03"})
    r.execute("d1", DAY1, source(spark, first))
    staged = {e: r.store.folders(f"staging_{e}", {"execucao": ["d1"]}) for e in ENTITIES}
    raw = r.store.folders("raw", {"execucao": ["d1"]})
    november, january = (r.store.folders("vendas", {"mes": [m]}) for m in ("2025-11", "2026-01"))
    at = "2026-01-02T09:00:00Z"
    moved = first["vendas"][1] | {"data_venda": "2025-12-30", "atualizado_em": at}
    r.execute("d2", DAY2, source(spark, {"vendas": [moved]}))
    assert {e: r.store.folders(f"staging_{e}", {"execucao": ["d1"]}) for e in ENTITIES} == staged
    assert r.store.folders("raw", {"execucao": ["d1"]}) == raw
    assert r.store.folders("vendas", {"mes": ["2025-11"]}) == november and r.store.folders("vendas", {"mes": ["2026-01"]}) != january
    by_month = {m: sorted(x.id_lancamento for x in r.published("vendas", {m}).collect()) for m in ("2025-11", "2025-12", "2026-01")}
    assert by_month == {"2025-11": [5], "2025-12": [2], "2026-01": [1]} and r.published("vendas").count() == 3
    only = r.raw("d2", "vendas")
    assert only.count() == 1 and all("execucao=d2" in f and "entidade=vendas" in f for f in only.inputFiles())
    r.execute("d3", "2026-01-04T00:00:00+00:00", source(spark, {"vendas": [first["vendas"][0] | {"data_venda": "2025-11-04", "atualizado_em": "2026-01-03T09:00:00Z"}]}))
    assert r.store.folders("vendas", {"mes": ["2026-01"]}) == [] and r.published("vendas").count() == 3  # an emptied month goes


def test_stages_tell_what_their_jobs_counted(spark, tmp_path, caplog):
    r = Runs(spark, str(tmp_path / "r"))
    with caplog.at_level(logging.INFO, logger="commerce_spark"):
        r.execute("d1", DAY1, source(spark, base()))
    told = [json.loads(m.message) for m in caplog.records if m.name == "commerce_spark"]
    assert all({"execucao", "etapa", "segundos", "status", "registros"} <= e.keys() for e in told)
    assert {(e["etapa"], e.get("entidade")): e["registros"] for e in told} == {("raw", "vendedores"): 1, ("raw", "clientes"): 1, ("raw", "produtos"): 1, ("raw", "vendas"): 2, ("raw", "devolucoes"): 0, ("raw", "metas"): 1, ("staging", None): 6, ("publicacao", None): 6}
    caplog.clear()
    with pytest.raises(KeyError), stage_event("x", "etapa"):
        raise KeyError("no")
    assert json.loads(caplog.records[-1].message)["status"] == "erro"


def test_counting_needs_no_second_job(spark, tmp_path):
    s, tracker, sc = Store(spark, str(tmp_path / "s")), spark.sparkContext.statusTracker(), spark.sparkContext
    many = {}
    for group, counted in (("plain", None), ("counted", {})):
        sc.setJobGroup(group, group)
        s.commit(replaced={"t": spark.range(100).withColumn("p", F.col("id") % 3)}, layouts={"t": Layout(("p",))}, counted=counted)
        many[group] = len(tracker.getJobIdsForGroup(group))
    w = Watched(spark.range(10).where("id > 3"), most="max(id)")
    sc.setJobGroup("watched", "watched")
    w.rows.write.format("noop").mode("overwrite").save()
    assert w.measured() == {"registros": 6, "most": 9} and len(tracker.getJobIdsForGroup("watched")) == 1
    sc.setJobGroup("rest", "rest")
    assert counted == {"t": 100} and many["plain"] == many["counted"]
    assert Watched(spark.range(3).where("false")).rows.count() == 0


# --- the second publication ----------------------------------------------------------------------------------


def test_leave_fails_closed():
    unbilled({"billingEnabled": False})
    for info in ({}, None, {"billingEnabled": None}, {"billingEnabled": True}, {"billingEnabled": "false"}, {"billingEnabled": False, "billingAccountName": "x"}):
        with pytest.raises(ValueError, match="billing"):
            unbilled(info)


def test_second_publication(spark, tmp_path):
    r = Runs(spark, str(tmp_path / "r"))
    answers = [{"billingEnabled": False}] * 2
    target = Sandbox(spark, str(tmp_path / "target"), lambda: answers.pop(0))
    r.execute("d1", DAY1, source(spark, base()), after=lambda: target.publish(r, "d1"))
    assert target.store.read("vendas").count() == 2 and target.store.manifest()["state"] == {"run": "d1"}
    r.begin("d2", DAY2)
    with pytest.raises(ValueError, match="not sucesso"):
        target.publish(r, "d2")
    r.execute("d2", DAY2, source(spark, {"vendas": [base("2026-01-02T09:00:00Z")["vendas"][0] | {"id_lancamento": 3}]}))
    before = target.store.versions()
    answers += [{"billingEnabled": False}, {"billingEnabled": True}]  # leave is taken back while the tables are written
    with pytest.raises(ValueError, match="billing"):
        target.publish(r, "d2")
    answers += [{}]
    with pytest.raises(ValueError, match="billing"):
        target.publish(r, "d2")
    assert target.store.versions() == before and target.store.read("vendas").count() == 2
    answers += [{"billingEnabled": False}] * 2
    assert target.publish(r, "d2")["vendas"] == 3 and target.store.read("vendas").count() == 3


def test_schemas_are_enforced(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, nome string")
    with pytest.raises(ValueError, match="nome"):
        enforced(df, "id bigint, nome bigint", "t")
    with pytest.raises(ValueError, match="extra"):
        enforced(df.withColumn("extra", F.lit(1)), "id bigint, nome string", "t")
    with pytest.raises(Exception, match="nome is required"):
        enforced(df, "id bigint, nome string", "t").collect()
    assert enforced(df.where("id = 1"), "nome string, id bigint", "t").columns == ["nome", "id"]
