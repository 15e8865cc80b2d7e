from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from commerce_spark.plans import lakehouse
from commerce_spark.sources import generators
from commerce_spark.streaming import available_now


def events(spark, run, **changed):
    """Events of one run, with columns changed."""
    df = generators.document_events(spark, f"1 {run}").drop("batch")
    return df.withColumns({k: F.lit(v) for k, v in changed.items()}) if changed else df


def test_batches_blocks_and_recovery(spark, tmp_path):
    engine = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    engine.load_dimensions(generators.event_dimensions(spark))
    batches = generators.event_batches(spark)
    seen = [tuple(engine.process(b).values()) for b in batches]
    assert seen == [(50, 0, 30), (79, 3, 40), (90, 1, 48)]
    before = sorted(map(tuple, engine.store.read("pedidos").collect()))
    assert tuple(engine.process(batches[2]).values()) == (90, 1, 48)  # again: nothing changes
    assert sorted(map(tuple, engine.store.read("pedidos").collect())) == before

    with pytest.raises(ValueError, match="again"):
        engine.process(events(spark, "pedido 1 1 1 - - aberto", quantidade="99"))
    with pytest.raises(ValueError, match="ambiguous"):
        engine.process(events(spark, "pedido 1 1 1 - - aberto", quantidade="99", id_evento="outro"))
    with pytest.raises(ValueError, match="no id"):
        engine.process(events(spark, "pedido 1 1 1 - - aberto", id_evento=" "))
    with pytest.raises(ValueError, match="date"):
        engine.process(batches[0].where("false"), "30/09/2026")
    assert engine.store.read("eventos").count() == 90

    with pytest.raises(ValueError, match="consumed"):
        engine.process(events(spark, "faturamento 700 700 1 695 50 faturado"))
    assert engine.store.read("eventos").count() == 91 and sorted(map(tuple, engine.store.read("pedidos").collect())) == before
    with pytest.raises(ValueError, match="consumed"):  # it blocks every batch until it is corrected
        engine.process(events(spark, "pedido 49 49 1 - - aberto"))
    engine.process(events(spark, "faturamento 700 700 2 695 1 faturado"))
    assert engine.store.read("pedidos").count() == 49
    log = engine.runs().collect()
    assert [r.status for r in log].count("falha") == 6 and log[0].status == "sucesso"


def test_stream_equals_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, b in enumerate(generators.event_batches(spark)):
        (folder / f"{k}.jsonl").write_text("".join(json.dumps({c: v for c, v in r.asDict().items() if v is not None}) + "\n" for r in b.collect()))
    engine = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    engine.load_dimensions(generators.event_dimensions(spark))
    available_now.run(spark, engine, str(folder), str(tmp_path / "check"), files_a_batch=3)
    assert (engine.store.read("eventos").count(), engine.store.read("quarentena").count(), engine.store.read("pedidos").count()) == (90, 1, 48)
    available_now.run(spark, engine, str(folder), str(tmp_path / "check"))
    assert engine.store.read("eventos").count() == 90


def test_two_streams_share_a_store(spark, tmp_path):
    """Each has a checkpoint of its own, so both start at batch 0: neither loses events to the other."""
    engine = lakehouse.Lakehouse(spark, str(tmp_path / "lake"))
    engine.load_dimensions(generators.event_dimensions(spark))
    seen = []
    for k, b in enumerate(generators.event_batches(spark)[:2]):
        folder = tmp_path / f"in{k}"
        folder.mkdir()
        (folder / "a.jsonl").write_text("".join(json.dumps({c: v for c, v in r.asDict().items() if v is not None}) + "\n" for r in b.collect()))
        available_now.run(spark, engine, str(folder), str(tmp_path / f"check{k}"))
        seen.append(engine.store.read("eventos").count())
    assert seen == [50, 79]
    available_now.run(spark, engine, str(tmp_path / "in0"), str(tmp_path / "fresh"))
    assert engine.store.read("eventos").count() == 79
