from __future__ import annotations

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from commerce_spark.functions import scalar
from commerce_spark.operators import changes, quality, temporal
from commerce_spark.plans import portfolio
from commerce_spark.plans.views import Tables
from commerce_spark.sources import files, rest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("text", "value"), [("7", 7), ("-3", -3), ("007", None), (" 7 ", None), ("4.0", None), ("true", None), ("9223372036854775808", None), ("0", 0)])
def test_strict_integer(spark, text, value):
    assert one(spark, scalar.strict_integer(F.lit(text))) == value


@pytest.mark.parametrize(("text", "value"), [("12.3", "12.30"), ("12.345", None), ("12.340", "12.34"), ("1e3", None), ("NaN", None), ("", None)])
def test_strict_money(spark, text, value):
    got = one(spark, scalar.strict_money(F.lit(text)))
    assert (got and str(got)) == value


def test_other_scalars(spark):
    assert str(one(spark, scalar.lenient("decimal(18,2)", F.lit("12.345")))) == "12.35"
    assert one(spark, scalar.strict_timestamp(F.lit("2026-01-01T00:00:00"))) is None
    assert one(spark, scalar.utc_text(scalar.strict_timestamp(F.lit("2026-01-01T03:00:00+03:00")))) == "2026-01-01T00:00:00.000000Z"
    assert one(spark, scalar.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalar.lower_bound_at_zero(F.lit(None).cast("double"))) is None
    assert one(spark, scalar.state_code(F.lit("sp"))) is None and one(spark, scalar.filled_text(F.lit("  "))) is None
    with pytest.raises(ValueError):
        scalar.identifier("a; drop")


def test_merges(spark):
    t = spark.createDataFrame([(1, 5, "t1"), (2, 5, "t2"), (3, 5, "t3")], "k int, v int, x string")
    s = spark.createDataFrame([(1, 5, "s1"), (2, 4, "s2"), (4, 1, "s4")], "k int, v int, x string")
    rows = lambda df: sorted((r.k, r.x) for r in df.collect())
    assert rows(changes.upsert(t, s, ["k"], "v")) == [(1, "s1"), (2, "t2"), (3, "t3"), (4, "s4")]
    assert rows(changes.full_sync(t, s, ["k"], "v")) == [(1, "t1"), (2, "t2"), (4, "s4")]
    assert rows(changes.insert_only(t, s.unionByName(s), ["k"])) == [(4, "s4")]
    with pytest.raises(ValueError):
        changes.deduplicate(t.unionByName(t.withColumn("x", F.lit("y"))), ["k"], "v", ["x"])


def test_scd2_and_as_of(spark):
    ts = lambda x: F.lit(x).cast("timestamp")
    empty = spark.createDataFrame([], "k int, seller int, updated timestamp, valid_from timestamp, valid_to timestamp")
    snap = lambda seller, at: spark.range(1).select(F.lit(1).alias("k"), F.lit(seller).alias("seller"), ts(at).alias("updated"))
    h = changes.scd2(empty, snap(1, "2025-01-01"), "k", "updated")
    assert changes.scd2(h, snap(9, "2025-01-01"), "k", "updated").count() == 1  # the same instant changes nothing
    h = changes.scd2(h, snap(2, "2025-07-01"), "k", "updated")
    facts = spark.createDataFrame([("2025-06-30 23:59:59",), ("2025-07-01 00:00:00",), ("2024-01-01 00:00:00",)], "at string").select(F.lit(1).alias("k"), F.col("at").cast("timestamp").alias("at"))
    assert [r.seller for r in temporal.as_of(facts, h, "k", "at", ["seller"]).orderBy("at").collect()] == [None, 1, 2]
    close = temporal.state_at_close(h, temporal.months(spark, "2025-05-01", "2025-08-01"))
    assert [r.seller for r in close.orderBy("competencia").collect()] == [1, 1, 2, 2]
    assert temporal.overlaps(h.withColumn("id", F.concat_ws("-", "seller")), "k", "id").isEmpty()
    assert not temporal.overlaps(h.withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("id", F.concat_ws("-", "seller")), "k", "id").isEmpty()


def test_gate(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "k int, v int")
    bad = quality.all_of(quality.unique(df, "t", ["k"]), quality.not_null(df, "t", "v", "k"))
    with pytest.raises(ValueError, match="t/1: unique k; t/2: not null v"):
        quality.gate(bad)
    quality.gate(bad.where("false"))


def test_store(spark, tmp_path):
    s = files.Store(spark, str(tmp_path / "s"))
    a = spark.range(3)
    assert s.load_once("t", a) and not s.load_once("t", a.orderBy(F.desc("id")))
    with pytest.raises(RuntimeError):
        s.commit(replaced={"t": spark.range(9), "u": a}, fail_after=2)
    assert s.read("t").count() == 3 and s.versions() == [1]
    s.commit(replaced={"t": spark.range(9)})
    assert (s.read("t").count(), s.read("t", version=1).count(), s.versions()) == (9, 3, [1, 2])
    snapshot = files.exported({"a": spark.createDataFrame([(1, "2.50")], "id int, v string").withColumn("v", F.col("v").cast("decimal(18,2)"))})
    assert str(files.imported(snapshot, "a", "id int, v decimal(18,2)").first().v) == "2.50"
    assert files.with_defaults(a, {"city": "x"}).first().city == "x"


def test_rest(spark):
    book = {None: {"itens": [{"atualizado_em": "2026-01-01", "k": 1}], "proximo_cursor": "b"}, "b": {"itens": [{"atualizado_em": "2026-01-02", "k": 2}]}}
    get = lambda url: book["b" if "cursor=b" in url else None]
    assert [r["k"] for r in rest.pages("http://x", "2026-01-01", "2026-01-03", get=get)] == [1, 2]
    with pytest.raises(ValueError, match="window"):
        list(rest.pages("http://x", "2026-01-02", "2026-01-03", get=get))
    with pytest.raises(ValueError, match="advance"):
        list(rest.pages("http://x", "2026-01-01", "2027-01-01", get=lambda u: {"itens": [], "proximo_cursor": "c"}))
    with pytest.raises(ValueError, match="list"):
        list(rest.pages("http://x", "2026-01-01", "2027-01-01", get=lambda u: {"itens": "no"}))
    waits, answers = [], [urllib.error.HTTPError("u", 503, "", {"Retry-After": "90"}, None), urllib.error.HTTPError("u", 429, "", None, None), io.BytesIO(json.dumps({"ok": 1}).encode())]

    def opener(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert rest.fetch("u", sleep=waits.append, opener=opener) == {"ok": 1} and waits == [60.0, 2.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "", None, None)]
    with pytest.raises(urllib.error.HTTPError):
        rest.fetch("u", sleep=waits.append, opener=opener)
    with pytest.raises(ValueError):
        rest.allow("erp", "metas")


def test_rest_source_reads_windows(spark):
    """The registered source against a server of this test: two windows as two tasks, pages, offsets, and no window."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    every = [{"id": i, "atualizado_em": f"2026-01-0{1 + i % 4}T0{i % 3}:00:00+02:00"} for i in range(40)]

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            rows = [r for r in every if rest._instant(q["inicio"]) <= rest._instant(r["atualizado_em"]) < rest._instant(q["fim"])]
            at, n = int(q.get("cursor", 0)), int(q["limite"])
            body = json.dumps({"itens": rows[at : at + n], "proximo_cursor": str(at + n) if at + n < len(rows) else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(rest.RestSource)
        windows = [["2025-12-31T00:00:00Z", "2026-01-02T00:00:00Z"], ["2026-01-02T00:00:00Z", "2026-01-06T00:00:00Z"]]
        source = spark.read.format("commerce_rest").option("url", f"http://127.0.0.1:{server.server_port}/x").option("fields", "id long, atualizado_em string").option("size", "3")
        df = source.option("windows", json.dumps(windows)).load()
        assert sorted(r.id for r in df.collect()) == list(range(40)) and df.rdd.getNumPartitions() == 2
        assert source.option("windows", "[]").load().count() == 0
    finally:
        server.shutdown()


def test_portfolio_is_dense(spark, data):
    t = Tables(spark, data)
    assert portfolio.monthly(t).count() == t.customer.count() * 80


def test_scan_is_pruned(spark, data):
    plan = Tables(spark, data).events.where("event_id > 5").select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,5)]" in plan and "ReadSchema: struct<event_id:bigint>" in plan


def test_every_overlapping_pair_of_versions(spark):
    h = spark.sql("select k, id, timestamp(a) valid_from, timestamp(b) valid_to from values (1, 'a', '2020-01-01', '2020-12-01'), (1, 'b', '2020-02-01', '2020-11-01'), (1, 'c', '2020-03-01', null), (1, 'd', '2019-01-01', '2020-01-01'), (2, 'e', '2020-01-01', null) as t(k, id, a, b)")
    assert {tuple(r) for r in temporal.overlaps(h, "k", "id").collect()} == {(1, "a", "b"), (1, "a", "c"), (1, "b", "c")}
