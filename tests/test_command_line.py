"""The command line over files and over a database; what runs leave behind; allowed paths and guarded drops."""

from __future__ import annotations

import json
import sqlite3
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from commerce_spark.__main__ import main, parser
from commerce_spark.plans.incremental import Runs
from commerce_spark.plans.lakehouse import Lakehouse
from commerce_spark.registry import ENTITIES
from commerce_spark.sources.files import inside
from commerce_spark.sources.store import Store
from tests.test_incremental import DAY1, DAY2, base, source


def test_files(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for e in ENTITIES:
        (folder / f"{e}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in base().get(e, [])))
    made = main(["bootstrap", "--pasta", store])["tabelas"]
    assert {"raw", "vendas", "staging_metas"} <= set(made) and main(["bootstrap", "--pasta", store]) == {"tabelas": []}
    assert Runs(spark, store).published("vendas").count() == 0
    run = ["executar", "--pasta", store, "--execucao", "d1", "--fim", DAY1, "--arquivos", str(folder)]
    assert main(run)["status"] == "sucesso" and main(run)["marcas"] == dict.fromkeys(ENTITIES, DAY1)
    assert Runs(spark, store).published("vendas").count() == 2
    (folder / "metas.jsonl").write_text('{"id_meta": 2, "sem": "instante"}\n')
    with pytest.raises(ValueError, match="outside the window"):
        main([*run[:4], "d2", "--fim", DAY2, *run[-2:]])
    told = main(["monitorar", "--pasta", store])
    assert [(r["id"], r["status"]) for r in told["execucoes"]] == [("d2", "falha"), ("d1", "sucesso")] and len(told["marcas"]) == 6
    for bad in (["executar", "--pasta", store], ["voar"], [*run, "--erp", "sqlite3"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_database_and_service(spark, tmp_path):
    at, store = str(tmp_path / "erp.db"), str(tmp_path / "store")
    db = sqlite3.connect(at)
    for e in (e for n, e in ENTITIES.items() if n != "metas"):
        columns = [*e.columns, "atualizado_em"]
        db.execute(f"create table {e.name} ({', '.join(columns)})")
        rows = [[(r | {"cidade": "Recife", "segmento": "A", "equipe": "E", "regiao": "NE", "categoria": "C"}).get(c) for c in columns] for r in base("2026-01-01T10:00:00+00:00")[e.name]]
        db.executemany(f"insert into {e.name} values ({', '.join('?' * len(columns))})", rows)
    db.commit()
    db.close()
    asked = []

    class Goals(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = json.dumps({"itens": base()["metas"], "proximo_cursor": None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Goals)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        told = main(["executar", "--pasta", store, "--execucao", "d1", "--fim", DAY1, "--erp", "sqlite3", "--argumentos", json.dumps([at]), "--metas", f"http://127.0.0.1:{server.server_port}"])
    finally:
        server.shutdown()
    r = Runs(spark, store)
    assert told["status"] == "sucesso" and asked and r.published("metas").count() == 1
    assert [(x.id_lancamento, str(x.valor_liquido), x.cancelado) for x in r.published("vendas").orderBy("id_lancamento").collect()] == [(1, "180.00", False), (2, "250.00", False)]


def test_a_failure_leaves_what_was_published(spark, tmp_path):
    r = Runs(spark, str(tmp_path / "r"))
    r.execute("d1", DAY1, source(spark, base()))
    before = r.fingerprint()
    lost = base("2026-01-02T09:00:00Z")["metas"][0] | {"id_meta": 2, "id_vendedor": 99}
    with pytest.raises(ValueError, match="sem dimensão"):
        r.execute("d2", DAY2, source(spark, {"metas": [lost]}))
    assert r.fingerprint() == before and len(before) == 12
    assert [x.id for x in r.failures("%metas/2:%sem dimensão%").collect()] == ["d2"] and r.failures("%metas/3:%").isEmpty()


def test_paths_that_batches_may_come_from(spark, tmp_path):
    allowed = ("/data/in", "s3a://bucket/in/")
    for ok in ("/data/in/a.jsonl", "/data/in/x/a b.jsonl", "s3a://bucket/in/a"):
        assert inside(ok, allowed) == ok
    for bad in ("/data/in", "/data/in/", "/data/inner/a", "/data/in/../out/a", "/data/in/./a", "/data/in//a", "/data/in/*", "/data/in/{a,b}", "file:///data/in/a", "s3a://other/in/a", "", "/data/in/a\0"):
        with pytest.raises(ValueError):
            inside(bad, allowed)
    engine = Lakehouse(spark, str(tmp_path / "lake"), inbox=(str(tmp_path / "in"),))
    with pytest.raises(ValueError, match="none of the folders"):
        engine.process(str(tmp_path / "elsewhere.jsonl"))
    assert engine.runs().first().status == "falha"


def test_only_named_test_stores_are_dropped(spark, tmp_path):
    s = Store(spark, str(tmp_path / "cenario_teste"))
    s.commit(replaced={"t": spark.range(2)})
    for name in ("cenario", "outro_teste", ""):
        with pytest.raises(ValueError, match="may be dropped"):
            s.dropped(name)
    assert s.read("t").count() == 2
    s.dropped("cenario_teste")
    assert s.versions() == [] and not (tmp_path / "cenario_teste" / "t").exists()
    with pytest.raises(ValueError, match="may be dropped"):
        Store(spark, str(tmp_path / "producao")).dropped("producao")


def test_missing_parts_are_told_from_broken_ones(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def failing(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=missing)

    monkeypatch.setattr(importlib, "import_module", failing)
    missing = "commerce_spark.llm"
    assert entry._llm() is None and entry._pipeline() is None
    missing = "commerce_spark.llm.topkk"
    with pytest.raises(ModuleNotFoundError):
        entry._llm()
