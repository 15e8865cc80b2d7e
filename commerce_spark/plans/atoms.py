"""One query for each data-change and time operator that no named query isolates, over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commerce_spark.operators import changes, temporal
from commerce_spark.operators.checks import Declared, checked
from commerce_spark.plans.incremental import lag_hours
from commerce_spark.plans.views import Tables

_BODY = ["event_type", "value", "props"]


def _half(t: Tables, rest: int) -> DataFrame:
    """Events of one parity; two neighbouring ids are the same version of a user."""
    e = t.events.where(F.col("event_id") % 2 == rest).withColumn("version", F.expr("event_id div 2"))
    return changes.latest(e, ["user_id"], [F.desc("version")]).select("user_id", "version", "event_id", *_BODY)


def insert_only(t: Tables) -> DataFrame:
    """All events as a batch, into a target that has the purchases."""
    return changes.insert_only(t.events.where("event_type = 'purchase'"), t.events, ["event_id"]).select("event_id", "user_id")


def upsert(t: Tables) -> DataFrame:
    """Odd events over even ones by version; ties go to the source."""
    return changes.upsert(_half(t, 0), _half(t, 1), ["user_id"], "version").select("user_id", "version", "event_id")


def full_sync(t: Tables) -> DataFrame:
    """As I2, but ties stay and users that the source (odd events of value 1 or more) lacks go."""
    return changes.full_sync(_half(t, 0), _half(t, 1).where("value >= 1"), ["user_id"], "version").select("user_id", "version", "event_id")


def watermark(t: Tables) -> DataFrame:
    """I4: the later of two high-water marks by type."""
    mark = lambda rest: t.events.where(F.col("event_id") % 2 == rest).groupBy(F.col("event_type").alias("entity")).agg(F.max("ts").alias("value"))
    return changes.advance(mark(0), mark(1))


def window_scan(t: Tables, low: str = "2024-01-02 00:00:00", high: str = "2024-01-03 00:00:00") -> DataFrame:
    """A half-open window with five minutes of look-back."""
    ts = F.col("ts")
    return t.events.where((ts >= F.lit(low).cast("timestamp_ntz") - F.expr("interval 5 minutes")) & (ts < F.lit(high).cast("timestamp_ntz"))).select("event_id", "ts")


def latest_valid(t: Tables) -> DataFrame:
    """The newest valid event of each type and user; an invalid newer one doesn't hide it."""
    return changes.latest(t.events.where("value >= 1"), ["event_type", "user_id"], [F.desc("event_id")]).select("event_type", "user_id", "event_id", "value")


def history(t: Tables) -> DataFrame:
    """The type-2 history of each user's events."""
    h = changes.versions_to_history(t.events.select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), "user_id", "at")
    return h.select("user_id", "event_id", F.col("valid_from.ts").alias("valid_from"), F.col("valid_to.ts").alias("valid_to"))


def ambiguous(t: Tables) -> DataFrame:
    """Users and types with more than one content on a day."""
    e = t.events.withColumn("day", F.col("ts").cast("date"))
    return changes.conflicts(e, ["user_id", "event_type", "day"], ["value"])


def quarantined(t: Tables) -> DataFrame:
    """Invalid events, and the latest valid purchases of users without a signup."""
    e = t.events.withColumn("reason", F.when(F.col("value") < 1, "valor_invalido"))
    now = changes.latest(e.where("reason is null and event_type = 'purchase'"), ["user_id"], [F.desc("event_id")])
    solved = now.join(t.events.where("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_semi")
    return changes.quarantine(e.select("event_id", "reason"), now.select("event_id"), solved, "event_id", "referencia_ausente")


def checks(t: Tables) -> DataFrame:
    """Generic checks over orders and lines: unique, not null, accepted values, relationships."""
    lines = Declared("lineitem", "l_orderkey", unique=(("l_orderkey", "l_linenumber"),))
    orders = Declared("orders", "o_orderkey", not_null=("o_custkey",), accepted={"o_orderstatus": ("F", "O")}, refers={"o_custkey": ("customer", "c_custkey")})
    tables = {"lineitem": t.lineitem, "orders": t.orders, "customer": t.customer.where("c_acctbal >= 0")}
    return checked([lines, orders], tables).select("entity", "key", "rule")


def next_page(t: Tables) -> DataFrame:
    """The rows after a position in (value, id) order."""
    return temporal.after_row(t.events.select("event_id", "value"), ["value", "event_id"], [50.0, 100])


def monitor_raw(t: Tables) -> DataFrame:
    """Rows and distinct versions by entity."""
    return t.events.groupBy(F.col("event_type").alias("entidade")).agg(F.count(F.lit(1)).alias("linhas_raw"), F.count_distinct(F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_id").cast("string"))).alias("versoes"))


def monitor_lag(t: Tables) -> DataFrame:
    """Each type's watermark, and its lag in whole hours behind the newest event."""
    marks = t.events.groupBy(F.col("event_type").alias("entidade")).agg(F.max("ts").alias("valor"))
    return lag_hours(marks, marks.agg(F.max("valor").alias("agora")))


def monitor_runs(t: Tables, shown: int = 30) -> DataFrame:
    """The newest runs, one a day of events; a day with invalid values failed and says why."""
    bad = F.count_if(F.col("value") < 1)
    days = t.events.groupBy(F.col("ts").cast("date").alias("dia")).agg(F.max("ts").alias("atualizado_em"), bad.alias("_bad"))
    failed = F.col("_bad") > 0
    return days.select(
        F.concat(F.lit("dia-"), F.col("dia").cast("string")).alias("id"), F.when(failed, "falha").otherwise("sucesso").alias("status"), F.date_add("dia", 1).alias("fim"), "atualizado_em",
        F.when(failed, F.concat(F.col("_bad").cast("string"), F.lit(" eventos com valor_invalido"))).alias("erro"),
    ).orderBy(F.desc("atualizado_em"), "id").limit(shown)


def failures(t: Tables) -> DataFrame:
    """Failed runs whose message has a pattern."""
    return monitor_runs(t, 1 << 30).where((F.col("status") == "falha") & F.col("erro").like("1%valor\\_inv%")).select("id", "erro")


PLANS = {
    "k19_lag": monitor_lag, "k19_runs": monitor_runs, "c19_failures": failures,
    "i01_insert_only": insert_only, "i02_upsert": upsert, "i03_full_sync": full_sync, "i04_watermark": watermark, "i05_window_scan": window_scan, "i10_history": history, "i11_latest_valid": latest_valid, "i12_quarantine": quarantined, "i15_ambiguous": ambiguous,
    "j07_checks": checks, "c09_next_page": next_page, "k19_monitor_raw": monitor_raw,
}

_PARTS = "WITH h AS (SELECT *, event_id//2 AS version, event_id%2 AS s FROM events), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, s ORDER BY version DESC) AS r FROM h) WHERE r=1) "
_RUN = "SELECT 'dia-' || CAST(ts AS DATE) AS id, CASE WHEN COUNT(*) FILTER (value<1)>0 THEN 'falha' ELSE 'sucesso' END AS status, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS fim, MAX(ts) AS atualizado_em, CASE WHEN COUNT(*) FILTER (value<1)>0 THEN COUNT(*) FILTER (value<1) || ' eventos com valor_invalido' END AS erro FROM events GROUP BY CAST(ts AS DATE)"
SQL = {
    "k19_lag": "SELECT entidade, valor, datesub('hour', valor, (SELECT MAX(ts) FROM events)) AS horas_defasagem FROM (SELECT event_type AS entidade, MAX(ts) AS valor FROM events GROUP BY 1)",
    "k19_runs": f"{_RUN} ORDER BY atualizado_em DESC, id LIMIT 30",
    "c19_failures": f"SELECT id, erro FROM ({_RUN}) WHERE erro LIKE '1%valor^_inv%' ESCAPE '^'",
    "i01_insert_only": "SELECT event_id, user_id FROM events WHERE event_type<>'purchase'",
    "i02_upsert": _PARTS + "SELECT user_id, version, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, s DESC) AS k FROM n) WHERE k=1",
    "i03_full_sync": _PARTS + "SELECT a.user_id, CASE WHEN b.version>=a.version THEN b.version ELSE a.version END AS version, CASE WHEN b.version>=a.version THEN b.event_id ELSE a.event_id END AS event_id FROM n a LEFT JOIN n b ON b.user_id=a.user_id AND b.s=0 WHERE a.s=1 AND a.value>=1",
    "i04_watermark": "SELECT event_type AS entity, MAX(ts) AS value FROM events GROUP BY 1",
    "i05_window_scan": "SELECT event_id, ts FROM events WHERE ts>=TIMESTAMP '2024-01-01 23:55:00' AND ts<TIMESTAMP '2024-01-03 00:00:00'",
    "i10_history": "SELECT user_id, event_id, ts AS valid_from, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events",
    "i11_latest_valid": "SELECT event_type, user_id, event_id, value FROM events WHERE value>=1 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC)=1",
    "i12_quarantine": "SELECT event_id, 'valor_invalido' AS reason FROM events WHERE value<1 UNION ALL SELECT event_id, 'referencia_ausente' FROM (SELECT * FROM events WHERE value>=1 AND event_type='purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type='signup')",
    "i15_ambiguous": "SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY 1,2,3 HAVING COUNT(DISTINCT value)>1",
    "j07_checks": "SELECT 'lineitem' AS entity, concat_ws('/', l_orderkey, l_linenumber) AS key, 'unique l_orderkey, l_linenumber' AS rule FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*)>1 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'not null o_custkey' FROM orders WHERE o_custkey IS NULL UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'accepted o_orderstatus' FROM orders WHERE o_orderstatus NOT IN ('F','O') UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'related o_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal>=0)",
    "c09_next_page": "SELECT event_id, value FROM events WHERE value>50 OR (value=50 AND event_id>100)",
    "k19_monitor_raw": "SELECT event_type AS entidade, COUNT(*) AS linhas_raw, COUNT(DISTINCT concat_ws('|', user_id, event_id)) AS versoes FROM events GROUP BY 1",
}
