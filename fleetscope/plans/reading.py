"""Registered queries on dashboards' reads, snapshots, observations, lead times and label effects, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, explain
from ..sources import store
from . import dashboards
from .base import DAY, HOUR, START, H, S, as_long, host_of, rounded, samples

NOW = START + 30 * DAY


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(host_of(), "id", "ts", "pid", F.col("source").alias("kind"), "value")


def latest_rows(spark, sf_dir):
    """Each machine's last sample, and all its programs' rows of the last hour that has any."""
    h = _hosts(spark, sf_dir)
    last = dashboards.latest_metrics(h).select("source", F.lit("last").alias("part"), "id")
    return last.unionByName(dashboards.latest_gpu(h.withColumn("ts", F.floor(F.col("ts") / HOUR))).select("source", F.lit("hour").alias("part"), "id"))


def recent_series(spark, sf_dir):
    """One program's load by hour over the last ten days."""
    h = _hosts(spark, sf_dir).select("source", F.floor(F.col("ts") / HOUR).alias("ts"), F.col("kind").alias("name"), F.col("value").alias("cpu_percent"), F.col("pid").alias("rss_mb"))
    series = dashboards.program_series(dashboards.recent(h, NOW // HOUR, 240.0), "view")
    return rounded(as_long(series, "ts", "rss"), "cpu", places=5)


def observer_alert(spark, sf_dir):
    """The observer's own drops and throttling on each machine."""
    h = _hosts(spark, sf_dir).select("source", "ts", F.col("id").alias("drop_count"), (F.floor(F.col("value") / 100)).cast("int").alias("throttle_level"))
    return as_long(dashboards.observer_alert(h), "worst")


def rollup_lag(spark, sf_dir):
    """How far each machine's hourly rollup has come, taking every full hour as a commit."""
    h = _hosts(spark, sf_dir).select(F.col("source").alias("name"), (F.floor(F.col("ts") / HOUR) * HOUR).alias("hi"))
    return rounded(dashboards.rollup_state(h, NOW), "lag_minutes").withColumn("upto", F.col("upto").cast("long"))


def export_overview(spark, sf_dir):
    """Exported days beside the days that the warm tier has; days of few samples were not exported."""
    h = _hosts(spark, sf_dir).groupBy("source", F.to_date(F.timestamp_seconds("ts")).alias("day")).agg(F.count("*").alias("rows"), F.max("value").alias("top"))
    out = dashboards.exports_and_span(h.where("rows >= 10"), h.where("top > 60").select("source", "day"))
    return as_long(out.withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string")), "missing_days")


def latest_incident_signals(spark, sf_dir):
    """The three latest signals of each machine's day, and the share of the day's best score that each has."""
    h = _hosts(spark, sf_dir).where("value > 30")
    said = h.select("source", "ts", F.col("kind").alias("detector"), F.col("value").alias("score"))
    linked = h.select("source", F.floor((F.col("ts") - START) / DAY).cast("long").alias("incident_id"), "ts", F.col("kind").alias("detector"))
    out = dashboards.incident_signals(linked, said, 3).withColumn("best", F.when(F.col("rank") < 3, 100.0).otherwise(0.0))
    return rounded(as_long(dashboards.shares(out, "score", "best").select("source", "incident_id", "detector", "score", "rank", "share"), "rank"), "share", places=6)


def snapshot_windows(spark, sf_dir):
    """Guarded windows of large errors on each machine, and its latest four hundred quiet hours."""
    h = _hosts(spark, sf_dir)
    faults = h.where("kind = 'error' and value > 90").select("source", F.col("ts").alias("ts_start"), (F.col("ts") + HOUR).alias("ts_end"))
    span = h.groupBy("source").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return rounded(store.snapshot_windows(faults, span, 900.0, 400.0), "lo", "hi")


def snapshot_rows(spark, sf_dir):
    """The samples inside those windows."""
    h = _hosts(spark, sf_dir)
    faults = h.where("kind = 'error' and value > 90").select("source", F.col("ts").alias("ts_start"), (F.col("ts") + HOUR).alias("ts_end"))
    span = h.groupBy("source").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return store.snapshot(h, store.snapshot_windows(faults, span, 900.0, 200.0)).select("id")


def observations(spark, sf_dir):
    """Clicks as system ticks with the rows of the nearest view and the nearest error."""
    h = _hosts(spark, sf_dir)
    out = store.observations(h.where("kind = 'click'").select("source", "ts", "id"), h.where("kind = 'view'").select("source", "ts", F.col("id").alias("pid")), h.where("kind = 'error'").select("source", "ts", F.col("id").alias("gpu")), 6 * HOUR)
    return out.select("id", F.get("processes", F.lit(0))["pid"].alias("view"), F.get("gpus", F.lit(0))["gpu"].alias("error"))


def lead_times(spark, sf_dir):
    """How long before each large error its machine's users of one kind reached their level."""
    h = _hosts(spark, sf_dir)
    own = h.where("kind = 'error' and value > 75").select("source", "id", F.col("ts").alias("start"))
    processes = h.select("source", F.floor(F.col("ts") / HOUR).cast("double").alias("ts"), "pid", F.round("value").alias("value"))
    found = own.select("source", "id", F.lit("users").alias("name"), F.sequence(F.floor(F.substring("source", 2, 9).cast("int") * 25), F.floor(F.substring("source", 2, 9).cast("int") * 25 + 24)).alias("pids"), F.lit(150.0).alias("after"), F.lit(100.0).alias("delta"))
    out = explain.lead_time(found, own.withColumn("start", F.floor(F.col("start") / HOUR).cast("double")), processes, "value", 24.0)
    return out.select("source", "id", "lead_s")


def label_effects(spark, sf_dir):
    """Whether a labelled half day lifts its machine's peak by what is asked over the mean of the day before."""
    h = _hosts(spark, sf_dir)
    own = h.where("kind = 'error' and value > 60").select("source", "id", F.col("ts").alias("lo"), (F.col("ts") + DAY / 2).alias("hi"))
    return rounded(evaluate.label_effect(own, h.select("source", "ts", "value"), "value", 120.0, DAY).select("source", "id", "effect", "completed"), "effect", places=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (latest_rows, recent_series, observer_alert, rollup_lag, export_overview, latest_incident_signals, snapshot_windows, snapshot_rows, observations, lead_times, label_effects)}

T = f"h AS (SELECT {H} AS source, id, ts, pid, source AS kind, value FROM s)"


def _snapshot(hours: float) -> str:
    """``windows``: guarded faults and the latest quiet hours, merged."""
    return f"""
span AS (
    SELECT source, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1
), f AS (
    SELECT source, ts - 900 AS lo, ts + 4500 AS hi FROM h WHERE kind = 'error' AND value > 90
), fr AS (
    SELECT *, max(hi) OVER (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f
), fi AS (
    SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY lo, hi) AS k FROM fr
), m AS (
    SELECT source, min(lo) AS lo, max(hi) AS hi FROM fi GROUP BY source, k
), edges AS (
    SELECT span.source, span.lo AS a, span.hi AS b, m.lo, m.hi FROM span JOIN m ON m.source = span.source AND m.lo < span.hi AND m.hi > span.lo
    UNION ALL SELECT source, lo, hi, lo, lo FROM span UNION ALL SELECT source, lo, hi, hi, hi FROM span
), free AS (
    SELECT source, greatest(hi, a) AS lo, lead(lo) OVER (PARTITION BY source ORDER BY lo, hi) AS hi FROM edges
), quiet AS (
    SELECT source, lo, hi, {hours * 3600} - coalesce(sum(hi - lo) OVER (PARTITION BY source ORDER BY lo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM free WHERE hi > lo
), joined AS (
    SELECT * FROM m UNION ALL SELECT source, greatest(lo, hi - rest), hi FROM quiet WHERE rest > 0
), br AS (
    SELECT *, max(hi) OVER (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM joined
), bi AS (
    SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY lo, hi) AS k FROM br
), windows AS (
    SELECT source, min(lo) AS lo, max(hi) AS hi FROM bi GROUP BY source, k
)"""


ORACLE_SQL: dict[str, str] = {
    "latest_rows": f"""
WITH {S}, {T}
SELECT source, 'last' AS part, arg_max(id, ts) AS id FROM h GROUP BY 1
UNION ALL SELECT source, 'hour', id FROM h QUALIFY floor(ts / 3600) = max(floor(ts / 3600)) OVER (PARTITION BY source)
""",
    "recent_series": f"""
WITH {S}, {T}
SELECT source, CAST(floor(ts / 3600) AS BIGINT) AS ts, round(sum(value), 5) AS cpu, CAST(sum(pid) AS BIGINT) AS rss FROM h WHERE kind = 'view' AND floor(ts / 3600) >= {NOW // HOUR - 240} GROUP BY 1, 2
""",
    "observer_alert": f"""
WITH {S}, {T}
SELECT source, arg_max(id, ts) AS drops, count(*) FILTER (WHERE value >= 100) AS throttled, CAST(max(floor(value / 100)) AS BIGINT) AS worst FROM h GROUP BY 1
""",
    "rollup_lag": f"""
WITH {S}, {T}
SELECT source AS name, CAST(max(floor(ts / 3600) * 3600) AS BIGINT) AS upto, round(({NOW} - max(floor(ts / 3600) * 3600)) / 60, 3) AS lag_minutes FROM h GROUP BY 1
""",
    "export_overview": f"""
WITH {S}, {T}, d AS (
    SELECT source, DATE '1970-01-01' + CAST(floor(ts / 86400) AS INTEGER) AS day, count(*) AS n, max(value) AS top FROM h GROUP BY 1, 2
), e AS (
    SELECT source, count(*) AS exports, CAST(sum(n) AS BIGINT) AS exported_rows FROM d WHERE n >= 10 GROUP BY 1
), w AS (
    SELECT source, min(day) AS a, max(day) AS b, count(*) AS days FROM d WHERE top > 60 GROUP BY 1
)
SELECT source, coalesce(exports, 0) AS exports, coalesce(exported_rows, 0) AS exported_rows, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, coalesce(days, 0) AS days, date_diff('day', a, b) + 1 - days AS missing_days FROM e FULL JOIN w USING (source)
""",
    "latest_incident_signals": f"""
WITH {S}, {T}, g AS (
    SELECT source, CAST(floor((ts - {START}) / 86400) AS BIGINT) AS incident_id, kind AS detector, value AS score, row_number() OVER (PARTITION BY source, floor((ts - {START}) / 86400) ORDER BY ts DESC, value DESC, kind) AS rank FROM h WHERE value > 30
)
SELECT *, CASE WHEN rank < 3 THEN round(score / 100, 6) END AS share FROM g WHERE rank <= 3
""",
    "snapshot_windows": f"WITH {S}, {T}, {_snapshot(400)} SELECT source, round(lo, 3) AS lo, round(hi, 3) AS hi FROM windows",
    "snapshot_rows": f"WITH {S}, {T}, {_snapshot(200)} SELECT DISTINCT id FROM h JOIN windows w ON w.source = h.source AND h.ts BETWEEN w.lo AND w.hi",
    "observations": f"""
WITH {S}, {T}, c AS (
    SELECT * FROM h WHERE kind = 'click'
), near AS (
    SELECT c.id, o.kind, o.id AS other, row_number() OVER (PARTITION BY c.id, o.kind ORDER BY abs(o.ts - c.ts), o.ts DESC) AS n FROM c JOIN h o ON o.source = c.source AND o.kind IN ('view', 'error') AND abs(o.ts - c.ts) <= {6 * HOUR}
)
SELECT c.id, v.other AS view, e.other AS error FROM c LEFT JOIN near v ON v.id = c.id AND v.kind = 'view' AND v.n = 1 LEFT JOIN near e ON e.id = c.id AND e.kind = 'error' AND e.n = 1
""",
    "lead_times": f"""
WITH {S}, {T}, i AS (
    SELECT source, id, floor(ts / 3600) AS st FROM h WHERE kind = 'error' AND value > 75
), p AS (
    SELECT source, floor(ts / 3600) AS ts, sum(round(value)) AS v FROM h GROUP BY 1, 2
), m AS (
    SELECT i.source, i.id, st, min(p.ts) AS first, min(CASE WHEN v >= 60 THEN p.ts END) AS reached FROM i JOIN p ON p.source = i.source AND p.ts BETWEEN st - 24 AND st + 24 GROUP BY ALL
)
SELECT source, id, CASE WHEN reached > first THEN st - reached END AS lead_s FROM m
""",
    "label_effects": f"""
WITH {S}, {T}, i AS (
    SELECT source, id, ts AS lo, ts + 43200 AS hi FROM h WHERE kind = 'error' AND value > 60
), a AS (
    SELECT i.id, max(h.value) AS peak FROM i JOIN h ON h.source = i.source AND h.ts BETWEEN lo AND hi GROUP BY 1
), b AS (
    SELECT i.id, avg(h.value) AS usual FROM i JOIN h ON h.source = i.source AND h.ts >= lo - 86400 AND h.ts < lo GROUP BY 1
)
SELECT source, id, round(peak - usual, 5) AS effect, coalesce(peak - usual >= 120, false) AS completed FROM i LEFT JOIN a USING (id) LEFT JOIN b USING (id)
""",
}
