"""Keyset pages over a database, opaque cursors, SQL templates, JSON lines and dimensions."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains

from commerce_spark.functions import templates
from commerce_spark.sources import files, pages
from commerce_spark.sources.keyset import KeyRange, KeysetReader, keyset

SCHEMA = "id bigint, atualizado_em timestamp, nome string, valor decimal(12,2), dia date, ativo boolean"


def instant(k):
    return (dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=k)).isoformat()


@pytest.fixture
def base(tmp_path):
    """60 rows, three to each minute, keys against the order of time within it; write-ahead, so that readers don't block writers."""
    at = str(tmp_path / "erp.db")
    db = sqlite3.connect(at)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("create table vendas (id integer primary key, atualizado_em text, nome text, valor text, dia text, ativo integer, segredo text)")
    db.executemany("insert into vendas values (?,?,?,?,?,?,?)", [(100 - k, instant(k // 3), f"n{k}", f"{k}.50", "2026-01-01", k % 2, "x") for k in range(60)])
    db.commit()
    yield at, db
    db.close()


def reader(at, **options):
    return KeysetReader(T.StructType.fromDDL(SCHEMA), {"driver": "sqlite3", "arguments": json.dumps([at]), "table": "vendas", "time": "atualizado_em", "key": "id"} | options)


def test_window_and_types(spark, base):
    df = keyset(spark, SCHEMA, "sqlite3", [base[0]], "vendas", "atualizado_em", "id", low=instant(3), high=instant(10), page=4)
    rows = df.orderBy("id").collect()
    assert [r.id for r in rows] == sorted(100 - k for k in range(9, 30))  # low is in, high is out
    assert rows[0].valor == Decimal("29.50") and rows[0].dia == dt.date(2026, 1, 1) and rows[0].ativo is True
    assert df.where("id = 80").select("nome").collect()[0].nome == "n20"
    assert df.where("nome = 'n20' and valor > 1").count() == 1 and df.where("id in (80, 81) and atualizado_em is not null").count() == 2


def test_pages_see_one_snapshot(base):
    at, db = base
    r = reader(at, page="7")
    rows = r.read(KeyRange(None, None))
    got = [next(rows)[0] for _ in range(10)]
    db.execute("insert into vendas values (1, ?, 'new', '1', '2026-01-01', 1, '')", [instant(15)])
    db.execute("update vendas set atualizado_em = ? where id = 50", [instant(900)])
    db.execute("delete from vendas where id = 45")
    db.commit()  # another connection changes what lies ahead
    got += [x[0] for x in rows]
    order = [x for m in range(20) for x in sorted(100 - k for k in range(3 * m, 3 * m + 3))]
    assert got == order
    assert {x[0] for x in r.read(KeyRange(None, None))} == set(order) - {45} | {1}  # a new read sees the new state


@pytest.mark.parametrize("page", [1, 2, 3, 59, 60, 61, 500])
def test_every_page_size_gives_the_whole(base, page):
    assert len([*reader(base[0], page=str(page)).read(KeyRange(None, None))]) == 60


def test_ranges_of_keys_part_the_table(spark, base):
    df = keyset(spark, SCHEMA, "sqlite3", [base[0]], "vendas", "atualizado_em", "id", parts=3, least=41, most=101, page=5)
    assert df.rdd.getNumPartitions() == 3 and sorted(r.id for r in df.collect()) == list(range(41, 101))


def test_filters_go_into_the_query(base):
    r = reader(base[0], low=instant(0), page="9")
    text = StringContains(("nome",), "n1")
    named = EqualTo(("nome",), "N1")
    nested = EqualTo(("a", "b"), 1)
    left = list(r.pushFilters([EqualTo(("id",), 80), text, In(("id",), (80, 81)), named, nested, LessThan(("atualizado_em",), dt.datetime(2026, 1, 1, 1, tzinfo=dt.timezone.utc))]))
    assert left == [text, named, nested]  # texts and what lies inside structs stay with Spark
    sql, values = r.statement(KeyRange(None, None), (instant(1), 5))
    assert sql.startswith("SELECT id, atualizado_em, nome, valor, dia, ativo FROM vendas WHERE atualizado_em >= ? AND id = ? AND id IN (?, ?) AND atualizado_em < ? AND (atualizado_em > ? OR (atualizado_em = ? AND id > ?)) ORDER BY atualizado_em, id LIMIT 9")
    assert values == [instant(0), 80, 80, 81, "2026-01-01T01:00:00+00:00", instant(1), instant(1), 5]
    assert [x[0] for x in r.read(KeyRange(None, None))] == [80]
    assert list(r.pushFilters([GreaterThan(("segredo",), 1)])) != []  # not a column that was asked for


def test_pushed_filters_show_in_the_plan(spark, base):
    df = keyset(spark, SCHEMA, "sqlite3", [base[0]], "vendas", "atualizado_em", "id").where("id >= 90")
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 11


def test_what_a_reader_refuses(base):
    for options, told in (({"table": "vendas; drop table vendas"}, "identifier"), ({"key": "id--"}, "identifier"), ({"page": "0"}, "one row"), ({"low": "2026-01-01T00:00:00"}, "offset"), ({"key": "nada"}, "lacks"), ({"driver": "dbm"}, "snapshot")):
        with pytest.raises(ValueError, match=told):
            reader(base[0], **options)
    base[1].execute("update vendas set atualizado_em = '2026-01-01T00:00:00' where id = 100")
    base[1].commit()
    with pytest.raises(ValueError, match="offset"):
        list(reader(base[0]).read(KeyRange(None, None)))


# --- cursors -------------------------------------------------------------------------------------------------


def all_pages(df, order, size):
    out, cursor, n = [], None, 0
    while True:
        rows, cursor = pages.page(df, order, size, cursor)
        out += rows
        n += 1
        assert len(rows) <= size
        if cursor is None:
            return out, n
        assert len(rows) == size


@pytest.mark.parametrize("size", [1, 3, 4, 50])
def test_pages_join_to_the_whole(spark, size):
    rows = [("a", 1), ("a", 1), ("a", 1), ("a", 1), ("a", 1), ("b", None), ("b", None), (None, 3), (None, None), ("c", 9)]
    df = spark.createDataFrame([(t, k, i % 2) for i, (t, k) in enumerate(rows)], "t string, k long, x int")  # ties, nulls, rows twice
    found, n = all_pages(df, ["t", "k"], size)
    assert sorted(map(repr, found)) == sorted(map(repr, df.collect())) and n == -(-10 // size)
    assert [r.t for r in found] == [None, None, *"aaaaabbc"]


def test_cursors_are_opaque_and_checked(spark):
    df = spark.range(9).withColumn("at", F.timestamp_seconds(F.col("id") * 7))
    rows, cursor = pages.page(df, ["at", "id"], 4)
    assert [r.id for r in rows] == [0, 1, 2, 3] and "=" not in cursor and pages.decoded(cursor, 2)[1:] == ["3", 1]
    assert [r.id for r in pages.page(df, ["at", "id"], 9, cursor)[0]] == [4, 5, 6, 7, 8] and pages.page(df, ["id"], 9)[1] is None
    for bad in ("", "nonsense", "!!", pages.encoded(["1"]), pages.encoded(["1", "2", 0]), pages.encoded(["1", 2, 1]), pages.encoded({"a": 1})):
        with pytest.raises(ValueError, match="not a cursor"):
            pages.page(df, ["at", "id"], 4, bad)
    assert pages.page(df.where("false"), ["id"], 3) == ([], None)


# --- templates -----------------------------------------------------------------------------------------------


def test_templates_bind_values_and_check_names(spark):
    spark.createDataFrame([(1, "Ana"), (2, "x' OR '1'='1")], "id long, nome string").createOrReplaceTempView("pessoas")
    q = "select id from __TABELA__ where nome = :nome and id >= :least"
    run = lambda nome, table="pessoas": [r.id for r in templates.query(spark, q, {"TABELA": table}, nome=nome, least=1).collect()]
    assert run("Ana") == [1] and run("x' OR '1'='1") == [2] and run("' OR 1=1 --") == []
    for table in ("pessoas; drop view pessoas", "pessoas where 1=1 --", "`pessoas`", "", "a..b"):
        with pytest.raises(ValueError, match="identifier"):
            run("Ana", table)
    with pytest.raises(ValueError, match="markers"):
        templates.query(spark, q, {"TABELA": "pessoas"}, nome="Ana")
    with pytest.raises(ValueError, match="places"):
        templates.query(spark, q, {}, nome="Ana", least=1)
    found = templates.query(spark, "select ':not' as t, max(id) as m from IDENTIFIER(:v) where ':x' <> :y", v="pessoas", y="z")
    assert found.first().asDict() == {"t": ":not", "m": 2}
    at = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    assert templates.query(spark, "select cast(:at as timestamp) = timestamp'2026-01-01 00:00:00Z' as ok", at=at).first().ok


# --- files ---------------------------------------------------------------------------------------------------


def test_json_lines_and_dimensions(spark, tmp_path):
    good, bad, no_key = tmp_path / "good.jsonl", tmp_path / "bad.jsonl", tmp_path / "no_key.jsonl"
    good.write_text('{"id_cliente": 1, "nome": "Ana"}\n{"id_cliente": 2}\n')
    bad.write_text('{"id_cliente": 1}\n{"id_cliente": \n')
    no_key.write_text('{"id_cliente": 1}\n{"nome": "no one"}\n')
    schema = "id_cliente bigint, nome string"
    assert [tuple(r) for r in files.dimension(spark, str(good), schema, "id_cliente").orderBy("id_cliente").collect()] == [(1, "Ana"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.jsonl(spark, str(bad), schema).collect()
    with pytest.raises(ValueError, match="id_cliente is missing"):
        files.dimension(spark, str(no_key), schema, "id_cliente")


def test_windowed_scan_pages_by_place(spark):
    df = spark.createDataFrame([(k, k // 3) for k in range(30)], "id long, t long")
    seen, after = [], None
    while rows := files.windowed(df, "t", 2, 8, after, "id", 4).collect():
        seen += [r.id for r in rows]
        after = (rows[-1].t, rows[-1].id)
    assert seen == list(range(6, 24))
