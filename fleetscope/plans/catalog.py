"""Registered queries over the driver tables, each with its SQL where SQL can state it.

``events`` stands in for telemetry: the event type is the source, the user is the process, and hours or days take the
place of seconds. Other tables serve joins by time and label rates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import band, bucket_of, epoch, severity_name
from ..operators import baseline, decide, derive, evaluate, explain, history, intervals, joins, leak, rollup, rules, usage
from . import boards, dashboards, detection, detectors, incidents, leaks, library, reading
from .base import DAY, DAYS, HOUR, START, H, S, as_long, host_of, islands_sql, rounded, samples

def rollup_hourly(spark, sf_dir):
    s = samples(spark, sf_dir)
    out = s.groupBy("source", bucket_of(F.col("ts"), HOUR).cast("long").alias("bucket")).agg(F.count("value").alias("n"), rollup.mean3("value", 6).alias("mean"), rollup.max3("value").alias("max"), rollup.std3("value", 6).alias("std"), rollup.pct_index("value", 0.95).alias("p95"), F.round(rollup.pct_rank("value", 0.5), 3).alias("p50"))
    return out


def dominant_and_top(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.lit("all").alias("source"), "ts", F.col("source").alias("name"), "value").withColumn("bucket", bucket_of(F.col("ts"), DAY).cast("long"))
    return rollup.dominant(s).join(rollup.top_share(s, "value"), ["source", "bucket"])


def two_stage_rollup(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.lit("all").alias("source"), bucket_of(F.col("ts"), HOUR).alias("ts"), "pid", F.col("source").alias("name"), "value", F.abs("value").alias("size"), (F.col("id") % 97).alias("handles"), (F.col("pid") % 5).alias("threads"))
    return as_long(rollup.process_rollup(s, 6 * HOUR, 2, "value", "size", places=6, further=("handles", "threads")), "bucket", "handles_max", "threads_max")


def distinct_activity(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.groupBy("source", F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(F.countDistinct("pid").alias("users"), F.count("*").alias("n"))


def counter_rate(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rounded(derive.counter_rate(s, "value", "rate", ("pid",)).select("id", "rate"), "rate", places=6)


def snapshot_diff(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / DAY).cast("long"))
    return derive.snapshot_events(s, ("source",), "pid")


def long_gaps(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("pid").alias("source"), "ts", F.col("ts").alias("mono"))
    return rounded(derive.time_gaps(s.distinct(), 1.0, 2 * DAY).select("source", "ts", "gap_seconds", "cause"), "ts", "gap_seconds")


def _spans(spark, sf_dir, kind: str, length: float) -> DataFrame:
    return samples(spark, sf_dir).where(F.col("source") == kind).select(F.col("pid").alias("source"), F.col("ts").alias("lo"), (F.col("ts") + length).alias("hi"), "id")


def interval_union(spark, sf_dir):
    return rounded(intervals.union(_spans(spark, sf_dir, "click", DAY)), "lo", "hi")


def interval_shared(spark, sf_dir):
    a, b = intervals.union(_spans(spark, sf_dir, "click", DAY)), intervals.union(_spans(spark, sf_dir, "error", DAY / 2))
    return rounded(intervals.intersection_seconds(a, b), "seconds")


def interval_gaps(spark, sf_dir):
    a = intervals.union(_spans(spark, sf_dir, "click", DAY))
    span = a.select("source").distinct().select("source", F.lit(START).alias("lo"), F.lit(START + 30 * DAY).alias("hi"))
    return rounded(intervals.complement(a, span), "lo", "hi")


def span_overlaps(spark, sf_dir):
    """Purchases' spans that meet an error of the same user (semi) with the error that overlaps longest."""
    a, b = _spans(spark, sf_dir, "purchase", DAY), _spans(spark, sf_dir, "error", DAY / 2)
    return rounded(intervals.longest_overlap(a, b), "overlap_s")


def excluded_buckets(spark, sf_dir):
    s = samples(spark, sf_dir)
    buckets = s.select(F.col("pid").alias("source"), bucket_of(F.col("ts"), HOUR).alias("bucket")).distinct()
    return as_long(intervals.outside(buckets, _spans(spark, sf_dir, "error", 6 * HOUR), HOUR), "bucket")


def near_marks(spark, sf_dir):
    s = samples(spark, sf_dir)
    points = s.where("source = 'click'").select(F.col("pid").alias("source"), "ts", "id")
    marks = s.where("source = 'purchase'").select(F.col("pid").alias("source"), "ts")
    return intervals.near_marks(points, marks, 6 * HOUR).select("source", "id")


def touched_hours(spark, sf_dir):
    return as_long(intervals.touched_buckets(_spans(spark, sf_dir, "error", 3 * HOUR), HOUR), "bucket")


def nearest_asof(spark, sf_dir):
    s = samples(spark, sf_dir)
    a = s.where("source = 'purchase'").select(F.col("pid").alias("source"), "ts", "id")
    b = s.where("source = 'click'").select(F.col("pid").alias("source"), "ts", F.col("id").alias("click_id"))
    return joins.nearest(a, b, 12 * HOUR).select("id", "click_id")


def backward_asof(spark, sf_dir):
    s = samples(spark, sf_dir)
    a = s.where("source = 'purchase'").select(F.col("pid").alias("source"), "ts", "id")
    b = s.where("source = 'click'").select(F.col("pid").alias("source"), "ts", F.col("id").alias("click_id"))
    return joins.backward(a, b, "click_id").select("id", "click_id")


def latest_orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return joins.latest(o, ["o_custkey"], "at").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def sessions(spark, sf_dir):
    e = samples(spark, sf_dir).select(F.col("pid").alias("source"), "ts", F.when(F.col("source") == "signup", "startup").when(F.col("source") == "purchase", "shutdown").alias("event")).where("event is not null")
    return rounded(usage.sessions(e, START + 30 * DAY), "lo", "hi")


def daily_usage(spark, sf_dir):
    s = samples(spark, sf_dir)
    e = s.select(F.col("pid").alias("source"), "ts", F.when(F.col("source") == "signup", "startup").when(F.col("source") == "purchase", "shutdown").alias("event")).where("event is not null")
    observed = usage.sessions(e, START + 30 * DAY)
    starts = s.where("source in ('click', 'view')").select(F.col("pid").alias("source"), "ts", F.lit("start").alias("event"), F.col("source").alias("name"), F.hash("source").cast("long").alias("pid"))
    spans = usage.process_spans(starts, observed, START + 30 * DAY)
    return rounded(usage.daily_usage(spans, observed, starts.select("source", "ts", "name"), 60.0).select("source", "day", "name", "seconds", "observed_seconds", "launches"), "seconds", "observed_seconds", places=1)


def foreground_gap(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.lit("all").alias("source"), F.floor(F.col("ts") / DAY).cast("long").alias("day"), "ts", F.col("source").alias("name"))
    return usage.foreground_gaps(s, 600.0).groupBy("day", "name").agg(F.round(F.sum("seconds"), 1).alias("seconds"))


def _bucket_stats(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("bucket", bucket_of(F.col("ts"), HOUR)).withColumn("day", F.floor(F.col("ts") / DAY).cast("long"))
    return s.groupBy(F.lit("all").alias("source"), F.col("source").alias("name"), "bucket", "day").agg(F.round(F.avg("value"), 6).alias("level"), F.round(F.max("value"), 6).alias("peak"))


def fingerprints(spark, sf_dir):
    return history.fingerprints(_bucket_stats(spark, sf_dir), ["level", "peak"], size=HOUR).drop("source")


def day_index(spark, sf_dir):
    return history.day_index(_bucket_stats(spark, sf_dir)).drop("source")


def two_tier_union(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("day", F.floor((F.col("ts") - START) / DAY).cast("long"))
    warm = s.where("day < 15").withColumn("tier", F.lit("warm"))
    return history.warm_wins(warm, s.where("day >= 10").withColumn("tier", F.lit("hot"))).groupBy("source", "day", "tier").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def rolling_baseline(spark, sf_dir):
    config = baseline.Baseline(DAY, 20, 0.001)
    out = baseline.rolling_dense(samples(spark, sf_dir), config=config, chunk=2 * DAY)
    return rounded(out.withColumn("z", baseline.z_score(F.col("value"), F.col("median"), F.col("sigma"))).select("id", "median", "mad", "samples", "z"), "median", "mad", "z", places=4)


def sustained_rule(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rules.sustained(s, F.col("value") > 20, 6 * HOUR).select("id", F.round(F.col("ts") - F.col("since"), 3).alias("held"))


def cooled_rule(spark, sf_dir):
    s = samples(spark, sf_dir)
    return rules.cooled(rules.sustained(s, F.col("value") > 20, HOUR), DAY).select("id")


def drift(spark, sf_dir):
    """Kinds whose level under load (twice the value) rose by one or more in the last three days that have load enough."""
    s = samples(spark, sf_dir).withColumn("day", F.floor(F.col("ts") / DAY).cast("long")).withColumn("load", F.col("value") * 2)
    levels = leak.daily_load_median(s, "value", "load", 80, 2)
    return rounded(leak.drift(levels, 1.0), "recent_level", "usual_level", "rise", "score")


def fusion(spark, sf_dir):
    out = decide.fold(decide.fuse(incidents.signals(spark, sf_dir), 3 * HOUR))
    return rounded(rounded(out.select("source", "ts_start", "ts_end", "signal_count", "peak_score"), "ts_start", "ts_end"), "peak_score", places=6)


def incident_severity(spark, sf_dir):
    """Each incident's severity, which rises with every signal once two detectors have spoken."""
    out = decide.fold(decide.fuse(incidents.signals(spark, sf_dir), 3 * HOUR))
    return rounded(out.select("source", F.col("session").cast("long").alias("session"), "severity", F.concat_ws(",", "detectors").alias("detectors"), "ts_start"), "ts_start")


def notification_budget(spark, sf_dir):
    return decide.budget(incidents.incidents(spark, sf_dir), 5).select("id", "notified", "notify_skipped")


def alarm_clusters(spark, sf_dir):
    return rounded(rounded(evaluate.alarms(incidents.signals(spark, sf_dir), HOUR).drop("alarm"), "first", "last"), "peak", places=6)


def attribution(spark, sf_dir):
    """Which customer segments make an order month's revenue exceed the month before, by the shares of the positive differences."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("date")
    sums = o.groupBy(month.alias("month"), F.col("c_mktsegment").alias("name")).agg(F.sum("o_totalprice").alias("v"))
    before = sums.select(F.add_months("month", 1).alias("month"), "name", F.col("v").alias("b"))
    deltas = sums.join(before, ["month", "name"], "full_outer").select(F.lit("all").alias("source"), F.col("month").alias("id"), "name", (F.coalesce("v", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))
    return rounded(explain._shares(deltas, 8).select(F.col("id").alias("month"), "name", "delta", "share", F.col("rank").cast("long").alias("rank")), "delta", "share", places=2)


def contributors(spark, sf_dir):
    """Programs (users) whose value grew in each of the largest errors' hours against the hours before."""
    s = samples(spark, sf_dir)
    incidents = s.where("source = 'error' and value > 75").select(F.lit("all").alias("source"), "id", F.col("ts").alias("start"), (F.col("ts") + 2 * HOUR).alias("end"))
    rows = s.select(F.lit("all").alias("source"), "ts", "pid", "name", "value")
    return rounded(explain.flow_contributors(incidents, rows, "value", (10 * HOUR, HOUR)).select("id", "name", "delta", F.col("rank").cast("long").alias("rank")), "delta")


def compare_previous(spark, sf_dir):
    s = samples(spark, sf_dir)
    daily = s.groupBy("source", F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(F.round(F.sum("value"), 3).alias("total"))
    return daily.withColumn("delta", F.round(F.col("total") - F.lag("total").over(Window.partitionBy("source").orderBy("day")), 3))


def threshold_sweep(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("severity_rank", F.coalesce(band(F.col("value"), 50, 100), F.lit(0)))
    return evaluate.threshold_sweep(s, "value", [20, 40, 60])


def label_rates(spark, sf_dir):
    """Documents as incidents: users' answers, automatic ones by language, and two sources during faults, where automatic ones don't count."""
    d, lab = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    met = d.select("doc_id", "source", "lang").join(lab, "doc_id", "left")
    user = F.when(F.col("toxic") == 1, "real").when(F.col("quality") == 1, "normal").when(F.col("quality") == 0, "unknown")
    auto = F.when(F.col("lang") == "de", "normal").when(F.col("lang") == "fr", "real")
    i = met.select("source", user.alias("user_label"), auto.alias("auto_label"), F.col("source").isin("src1", "src2").alias("during_injection"))
    return rounded(dashboards.false_positive_rate(i), "rate", places=6)


def top_programs(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.lit("all").alias("source"), "ts", "pid", F.col("source").alias("name"), F.col("value").alias("cpu_percent"), F.col("value").alias("rss_mb"), F.col("id").alias("handles"), F.lit(False).alias("foreground"))
    return rounded(dashboards.top_programs(s, START + 30 * DAY, 10 * DAY).select("name", "pids", "cpu_avg", "cpu_max", "handles_max"), "cpu_avg", "cpu_max")


def growth_rates(spark, sf_dir):
    return rounded(dashboards.growth_per_hour(samples(spark, sf_dir), "value", 24.0, ("source", "pid")), "growth_per_hour", places=6)


def gap_markers(spark, sf_dir):
    return rounded(dashboards.break_gaps(samples(spark, sf_dir).select("source", "ts", "value"), factor=5.0).where("value is null").select("source", "ts"), "ts")


def table_inventory(spark, sf_dir):
    e, o = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    return as_long(dashboards.inventory({"events": e.select(epoch("ts").alias("ts")), "orders": o.select(epoch("o_orderdate").alias("ts"))}), "first", "last")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    rollup_hourly, dominant_and_top, two_stage_rollup, distinct_activity, counter_rate, snapshot_diff, long_gaps, interval_union, interval_shared, interval_gaps, span_overlaps, excluded_buckets, near_marks, touched_hours, nearest_asof, backward_asof,
    latest_orders, sessions, daily_usage, foreground_gap, fingerprints, day_index, two_tier_union, rolling_baseline, sustained_rule, cooled_rule, drift, fusion, incident_severity, notification_budget, alarm_clusters,
    attribution, contributors, compare_previous, threshold_sweep, label_rates, top_programs, growth_rates, gap_markers, table_inventory,
)}


def _span(kind: str, length: float) -> str:
    return f"(SELECT pid AS source, ts AS lo, ts + {length} AS hi, id FROM s WHERE source = '{kind}')"


SIGNAL = f"g AS (SELECT {H} AS source, ts, source AS detector, least(value / 200, 1.0) AS score, id, value FROM s WHERE value > 75)"
ALARM = f"{SIGNAL}, a1 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source, detector ORDER BY ts, score) > 3600 THEN 1 ELSE 0 END AS nw FROM g), a2 AS (SELECT *, sum(nw) OVER (PARTITION BY source, detector ORDER BY ts, score) AS k FROM a1), a AS (SELECT source, detector, k, min(ts) AS first, max(ts) AS last, max(score) AS peak, count(*) AS n FROM a2 GROUP BY source, detector, k)"
SESSION = f"{SIGNAL}, i AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts, detector, score) > 10800 THEN 1 ELSE 0 END AS nw FROM g), k AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY source ORDER BY ts, detector, score) AS BIGINT) AS session, CASE WHEN value >= 200 THEN 2 WHEN value >= 120 THEN 1 ELSE 0 END AS rank FROM i)"
SEVERITY = "['info', 'warning', 'critical']"

ORACLE_SQL: dict[str, str] = {
    "rollup_hourly": f"WITH {S} SELECT source, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket, count(value) AS n, round(avg(value), 6) AS mean, round(max(value), 3) AS max, round(stddev_pop(value), 6) AS std, round(list_sort(list(value))[CAST(round_even(0.95 * (count(value) - 1), 0) AS BIGINT) + 1], 3) AS p95, round(quantile_disc(value, 0.5), 3) AS p50 FROM s GROUP BY 1, 2",
    "dominant_and_top": f"WITH {S}, b AS (SELECT CAST(floor(ts / 86400) * 86400 AS BIGINT) AS bucket, source AS name, value, ts FROM s), c AS (SELECT bucket, name, count(*) AS n, sum(value) AS v FROM b GROUP BY 1, 2), t AS (SELECT bucket, count(DISTINCT ts) AS ticks, count(*) AS al FROM b GROUP BY 1), d AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, name) AS rn, row_number() OVER (PARTITION BY bucket ORDER BY v DESC, name) AS rv FROM c) SELECT 'all' AS source, t.bucket, x.name AS dominant, round(x.n / t.al, 3) AS dominant_ratio, y.name AS top_name, round(y.v / t.ticks, 3) AS top_share FROM t JOIN d x ON x.bucket = t.bucket AND x.rn = 1 JOIN d y ON y.bucket = t.bucket AND y.rv = 1",
    "two_stage_rollup": f"WITH {S}, b AS (SELECT source AS name, floor(ts / 3600) * 3600 AS ts, pid, value, abs(value) AS size, id % 97 AS hd, pid % 5 AS td FROM s), t AS (SELECT name, ts, sum(value) AS v, sum(size) AS w, count(DISTINCT pid) AS p, sum(hd) AS hd, sum(td) AS td FROM b GROUP BY 1, 2), u AS (SELECT CAST(floor(ts / 21600) * 21600 AS BIGINT) AS bucket, name, count(*) AS sample_count, round(avg(v), 6) AS value_mean, list_sort(list(v)) AS l, round(max(v), 3) AS value_max, round(avg(w), 6) AS second_mean, round(max(w), 3) AS second_max, max(p) AS pids_max, round(avg(hd), 6) AS handles_mean, CAST(max(hd) AS BIGINT) AS handles_max, round(avg(td), 6) AS threads_mean, CAST(max(td) AS BIGINT) AS threads_max FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value_mean DESC, name) AS a, row_number() OVER (PARTITION BY bucket ORDER BY second_max DESC, name) AS b FROM u) SELECT 'all' AS source, bucket, name, sample_count, value_mean, round(l[CAST(round_even(0.5 * (sample_count - 1), 0) AS BIGINT) + 1], 3) AS value_p50, round(l[CAST(round_even(0.95 * (sample_count - 1), 0) AS BIGINT) + 1], 3) AS value_p95, round(l[CAST(round_even(0.99 * (sample_count - 1), 0) AS BIGINT) + 1], 3) AS value_p99, value_max, second_mean, second_max, pids_max, handles_mean, handles_max, threads_mean, threads_max FROM r WHERE a <= 2 OR b <= 2",
    "distinct_activity": f"WITH {S} SELECT source, {DAYS} AS day, count(DISTINCT pid) AS users, count(*) AS n FROM s GROUP BY 1, 2",
    "counter_rate": f"WITH {S}, d AS (SELECT id, value - lag(value) OVER w AS dv, ts - lag(ts) OVER w AS dt FROM s WINDOW w AS (PARTITION BY pid ORDER BY ts)) SELECT id, round(CASE WHEN dt > 0 AND dv >= 0 THEN dv / dt END, 6) AS rate FROM d",
    "snapshot_diff": f"WITH {S}, p AS (SELECT DISTINCT source, {DAYS} AS ts, pid FROM s), t AS (SELECT source, ts, row_number() OVER (PARTITION BY source ORDER BY ts) AS i, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS nx FROM (SELECT DISTINCT source, ts FROM p)), q AS (SELECT p.*, i, nx, lag(i) OVER (PARTITION BY p.source, pid ORDER BY i) AS b, lead(i) OVER (PARTITION BY p.source, pid ORDER BY i) AS a FROM p JOIN t ON t.source = p.source AND t.ts = p.ts) SELECT source, ts, pid, 'start' AS event FROM q WHERE i > 1 AND (b IS NULL OR b < i - 1) UNION ALL SELECT source, nx, pid, 'exit' FROM q WHERE nx IS NOT NULL AND (a IS NULL OR a > i + 1)",
    "long_gaps": f"WITH {S}, d AS (SELECT pid AS source, ts, ts - lag(ts) OVER (PARTITION BY pid ORDER BY ts) AS g FROM (SELECT DISTINCT pid, ts FROM s)) SELECT source, round(ts, 3) AS ts, round(g, 3) AS gap_seconds, 'suspend_or_stall' AS cause FROM d WHERE g > 172801",
    "interval_union": f"WITH {S}, x AS {_span('click', DAY)}, {islands_sql('x', 'm')} SELECT source, round(lo, 3) AS lo, round(hi, 3) AS hi FROM m",
    "interval_shared": f"WITH {S}, x AS {_span('click', DAY)}, y AS {_span('error', DAY / 2)}, {islands_sql('x', 'm')}, {islands_sql('y', 'n')} SELECT m.source, round(sum(least(m.hi, n.hi) - greatest(m.lo, n.lo)), 3) AS seconds FROM m JOIN n ON m.source = n.source AND m.lo < n.hi AND m.hi > n.lo GROUP BY 1",
    "interval_gaps": f"WITH {S}, x AS {_span('click', DAY)}, {islands_sql('x', 'm')}, z AS (SELECT source, lo, hi FROM m UNION ALL SELECT DISTINCT source, {START}, {START} FROM m UNION ALL SELECT DISTINCT source, {START + 30 * DAY}, {START + 30 * DAY} FROM m), f AS (SELECT source, greatest(hi, {START}) AS lo, lead(lo) OVER (PARTITION BY source ORDER BY lo, hi) AS hi FROM z WHERE lo <= {START + 30 * DAY}) SELECT source, round(lo, 3) AS lo, round(hi, 3) AS hi FROM f WHERE hi > lo",
    "span_overlaps": f"WITH {S}, x AS {_span('purchase', DAY)}, y AS {_span('error', DAY / 2)}, j AS (SELECT x.source, x.id, y.id AS id2, least(x.hi, y.hi) - greatest(x.lo, y.lo) AS o, y.lo AS lo2 FROM x JOIN y ON x.source = y.source AND x.lo < y.hi AND x.hi > y.lo) SELECT source, id, id2, round(o, 3) AS overlap_s FROM (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY o DESC, lo2, id2) AS n FROM j) WHERE n = 1",
    "excluded_buckets": f"WITH {S}, b AS (SELECT DISTINCT pid AS source, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket FROM s), y AS {_span('error', 6 * HOUR)} SELECT source, bucket FROM b WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.source = b.source AND b.bucket < y.hi AND b.bucket > y.lo - 3600)",
    "near_marks": f"WITH {S} SELECT a.pid AS source, a.id FROM s a WHERE a.source = 'click' AND EXISTS (SELECT 1 FROM s b WHERE b.source = 'purchase' AND b.pid = a.pid AND abs(a.ts - b.ts) <= 21600)",
    "touched_hours": f"WITH {S}, y AS {_span('error', 3 * HOUR)} SELECT DISTINCT source, CAST(3600 * unnest(range(CAST(floor(lo / 3600) AS BIGINT), CAST(floor(hi / 3600) AS BIGINT) + 1)) AS BIGINT) AS bucket FROM y",
    "nearest_asof": f"WITH {S}, j AS (SELECT a.id, b.id AS click_id, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.ts - b.ts) NULLS LAST, b.ts DESC) AS n FROM s a LEFT JOIN s b ON b.source = 'click' AND b.pid = a.pid AND abs(a.ts - b.ts) <= 43200 WHERE a.source = 'purchase') SELECT id, click_id FROM j WHERE n = 1",
    "backward_asof": f"WITH {S}, a AS (SELECT * FROM s WHERE source = 'purchase'), b AS (SELECT * FROM s WHERE source = 'click') SELECT a.id, b.id AS click_id FROM a ASOF LEFT JOIN b ON a.pid = b.pid AND a.ts >= b.ts",
    "latest_orders": "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "sessions": f"WITH {S}, e AS (SELECT pid AS source, ts, source AS ev, coalesce(lead(ts) OVER (PARTITION BY pid ORDER BY ts), {START + 30 * DAY}) AS nx FROM s WHERE source IN ('signup', 'purchase')), x AS (SELECT source, ts AS lo, nx AS hi FROM e WHERE ev = 'signup' AND nx > ts), {islands_sql('x', 'm')} SELECT source, round(lo, 3) AS lo, round(hi, 3) AS hi FROM m",
    "daily_usage": f"WITH {S}, e AS (SELECT pid AS source, ts, source AS ev, coalesce(lead(ts) OVER (PARTITION BY pid ORDER BY ts), {START + 30 * DAY}) AS nx FROM s WHERE source IN ('signup', 'purchase')), x AS (SELECT source, ts AS lo, nx AS hi FROM e WHERE ev = 'signup' AND nx > ts), {islands_sql('x', 'm')}, st AS (SELECT pid AS source, ts, source AS name, coalesce(lead(ts) OVER (PARTITION BY pid, source ORDER BY ts), {START + 30 * DAY}) AS nx FROM s WHERE source IN ('click', 'view')), sp AS (SELECT st.source, st.name, st.ts AS lo, least(st.nx, coalesce(m.hi, st.nx), {START + 30 * DAY}) AS hi FROM st ASOF LEFT JOIN m ON m.source = st.source AND st.ts >= m.lo), us AS (SELECT source || '/' || name AS source, lo, hi FROM sp WHERE hi > lo), {islands_sql('us', 'un')}, sh AS (SELECT m.source, split_part(un.source, '/', 2) AS name, greatest(un.lo, m.lo) AS lo, least(un.hi, m.hi) AS hi FROM un JOIN m ON m.source = CAST(split_part(un.source, '/', 1) AS BIGINT) AND un.lo < m.hi AND un.hi > m.lo), dd AS (SELECT unnest(range({int(START // DAY)}, {int(START // DAY) + 31})) AS d), u AS (SELECT source, d, name, sum(least(hi, (d + 1) * 86400) - greatest(lo, d * 86400)) AS seconds FROM sh JOIN dd ON lo < (d + 1) * 86400 AND hi > d * 86400 GROUP BY 1, 2, 3), o AS (SELECT source, d, sum(least(hi, (d + 1) * 86400) - greatest(lo, d * 86400)) AS observed FROM m JOIN dd ON lo < (d + 1) * 86400 AND hi > d * 86400 GROUP BY 1, 2), c AS (SELECT st.source, CAST(floor(ts / 86400) AS BIGINT) AS d, name, count(*) AS launches FROM st WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = st.source AND abs(m.lo - st.ts) <= 60) GROUP BY 1, 2, 3) SELECT u.source, CAST(DATE '1970-01-01' + CAST(u.d AS INTEGER) AS DATE) AS day, u.name, round(seconds, 1) AS seconds, round(observed, 1) AS observed_seconds, coalesce(launches, 0) AS launches FROM u JOIN o ON o.source = u.source AND o.d = u.d LEFT JOIN c ON c.source = u.source AND c.d = u.d AND c.name = u.name",
    "foreground_gap": f"WITH {S}, b AS (SELECT {DAYS} AS day, source AS name, ts, lead(ts) OVER w - ts AS a, ts - lag(ts) OVER w AS p FROM s WINDOW w AS (PARTITION BY floor(ts / 86400) ORDER BY ts, source)) SELECT day, name, round(sum(least(coalesce(a, p), 600)), 1) AS seconds FROM b WHERE coalesce(a, p) IS NOT NULL GROUP BY 1, 2",
    "fingerprints": f"WITH {S}, b AS (SELECT source AS name, floor(ts / 3600) AS bucket, {DAYS} AS day, round(avg(value), 6) AS level, round(max(value), 6) AS peak FROM s GROUP BY 1, 2, 3), d AS (SELECT name, count(*) AS days FROM (SELECT name, day FROM b GROUP BY 1, 2 HAVING count(DISTINCT bucket) >= 12) GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT name, 'level' AS stat, level AS v FROM b UNION ALL SELECT name, 'peak', peak FROM b) SELECT t.name, stat, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, max(v) AS maximum, count(*) AS samples, any_value(days) AS days FROM t JOIN d ON d.name = t.name WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100",
    "day_index": f"WITH {S} SELECT source AS name, {DAYS} AS day, count(DISTINCT floor(ts / 3600)) AS buckets FROM s GROUP BY 1, 2",
    "two_tier_union": f"WITH {S}, x AS (SELECT *, CAST(floor((ts - {START}) / 86400) AS BIGINT) AS day FROM s), w AS (SELECT * FROM x WHERE day < 15) SELECT source, day, 'warm' AS tier, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2 UNION ALL SELECT source, day, 'hot', count(*), round(sum(value), 2) FROM x WHERE day >= 10 AND NOT EXISTS (SELECT 1 FROM w WHERE w.source = x.source AND w.day = x.day) GROUP BY 1, 2",
    "rolling_baseline": f"WITH {S}, m AS (SELECT *, median(value) OVER f AS median, mad(value) OVER f AS mad, count(value) OVER f AS samples FROM s WINDOW f AS (PARTITION BY source ORDER BY ts RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW)), g AS (SELECT *, greatest(mad * 1.4826, 0.001, abs(median) * 0.05) AS sg FROM m) SELECT id, round(median, 4) AS median, round(mad, 4) AS mad, samples, round(CASE WHEN samples >= 20 THEN (value - median) / sg END, 4) AS z FROM g",
    "sustained_rule": f"WITH {S}, r AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts) AS k FROM s), t AS (SELECT *, min(ts) OVER (PARTITION BY source, k) AS since FROM r WHERE value > 20) SELECT id, round(ts - since, 3) AS held FROM t WHERE ts - since >= 21600",
    "drift": f"""
WITH {S}, l AS (
    SELECT source, {DAYS} AS day, median(value) AS level FROM s WHERE value * 2 >= 80 GROUP BY 1, 2 HAVING count(*) >= 2
), r AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS n FROM l
), d AS (
    SELECT source, median(CASE WHEN n <= 3 THEN level END) AS a, median(CASE WHEN n > 3 AND n <= 17 THEN level END) AS b FROM r GROUP BY 1 HAVING count(*) >= 7
)
SELECT source, round(a, 3) AS recent_level, round(b, 3) AS usual_level, round(a - b, 3) AS rise, round(least(1.0, (a - b) / 3), 3) AS score FROM d WHERE a - b >= 1.0
""",
    "fusion": f"WITH {S}, {SESSION} SELECT source, round(min(ts), 3) AS ts_start, round(max(ts), 3) AS ts_end, count(*) AS signal_count, round(max(score), 6) AS peak_score FROM k GROUP BY source, session",
    "incident_severity": f"WITH RECURSIVE {S}, {SESSION}, o AS (SELECT *, row_number() OVER (PARTITION BY source, session ORDER BY ts, detector, score, rank) AS n, count(*) OVER (PARTITION BY source, session) AS m FROM k), f AS (SELECT source, session, n, m, rank, [detector] AS names, ts AS ts_start FROM o WHERE n = 1 UNION ALL SELECT o.source, o.session, o.n, o.m, CASE WHEN len(list_distinct(list_append(f.names, o.detector))) >= 2 THEN least(greatest(f.rank, o.rank) + 1, 2) ELSE greatest(f.rank, o.rank) END, list_distinct(list_append(f.names, o.detector)), f.ts_start FROM f JOIN o ON o.source = f.source AND o.session = f.session AND o.n = f.n + 1) SELECT source, session, {SEVERITY}[rank + 1] AS severity, array_to_string(list_sort(names), ',') AS detectors, round(ts_start, 3) AS ts_start FROM f WHERE n = m",
    "cooled_rule": f"WITH RECURSIVE {S}, r AS (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts) AS k FROM s), t AS (SELECT *, min(ts) OVER (PARTITION BY source, k) AS since FROM r WHERE value > 20), e AS (SELECT source, ts, id FROM t WHERE ts - since >= 3600), c AS (SELECT source, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT e.source, min(e.ts) FROM c JOIN e ON e.source = c.source AND e.ts - c.ts >= 86400 GROUP BY 1) SELECT id FROM e JOIN c ON e.source = c.source AND e.ts = c.ts",
    "notification_budget": f"WITH {S}, i AS (SELECT {H} AS source, id, ts, value FROM s WHERE value > 75), n AS (SELECT *, row_number() OVER (PARTITION BY source, floor(ts / 86400), value >= 120 ORDER BY ts, id) AS k FROM i) SELECT id, (value >= 120 AND k <= 5) OR value >= 200 AS notified, CASE WHEN value < 120 THEN 'severity' WHEN k > 5 AND value < 200 THEN 'budget' END AS notify_skipped FROM n",
    "alarm_clusters": f"WITH {S}, {ALARM} SELECT source, detector, round(first, 3) AS first, round(last, 3) AS last, round(peak, 6) AS peak, n FROM a",
    "attribution": "WITH t AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, c_mktsegment AS name, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT CAST(m + INTERVAL 1 MONTH AS DATE) AS m, name, v AS b FROM t), d AS (SELECT coalesce(t.m, b.m) AS month, coalesce(t.name, b.name) AS name, coalesce(v, 0) - coalesce(b, 0) AS delta FROM t FULL JOIN b ON t.m = b.m AND t.name = b.name), p AS (SELECT *, delta / sum(delta) OVER (PARTITION BY month) AS share, row_number() OVER (PARTITION BY month ORDER BY delta DESC, name) AS rank FROM d WHERE delta > 0) SELECT month, name, round(delta, 2) AS delta, round(share, 2) AS share, rank FROM p WHERE rank <= 8",
    "contributors": f"WITH {S}, i AS (SELECT id, ts AS st FROM s WHERE source = 'error' AND value > 75), o AS (SELECT i.id, s.pid, s.name, median(s.value) AS b FROM i JOIN s ON s.ts >= st - 36000 AND s.ts < st - 3600 GROUP BY ALL), n AS (SELECT i.id, s.pid, s.name, avg(s.value) AS a FROM i JOIN s ON s.ts >= st AND s.ts <= st + 7200 GROUP BY ALL), d AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.name, n.name) AS name, coalesce(a, 0) - coalesce(b, 0) AS delta FROM o FULL JOIN n ON o.id = n.id AND o.pid = n.pid), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY delta DESC, name) AS rank FROM d WHERE delta > 0) SELECT id, name, round(delta, 3) AS delta, rank FROM r WHERE rank <= 8",
    "compare_previous": f"WITH {S}, d AS (SELECT source, {DAYS} AS day, round(sum(value), 3) AS total FROM s GROUP BY 1, 2) SELECT *, round(total - lag(total) OVER (PARTITION BY source ORDER BY day), 3) AS delta FROM d",
    "threshold_sweep": f"WITH {S}, t(threshold) AS (VALUES (20.0::DOUBLE), (40.0), (60.0)) SELECT threshold, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS before, CASE WHEN value >= 2 * threshold THEN 'critical' WHEN value >= threshold THEN 'warning' ELSE 'info' END AS after, count(*) AS n FROM s, t GROUP BY 1, 2, 3",
    "label_rates": """
SELECT source, count(l) AS judged, count(*) FILTER (WHERE l = 'normal') AS normal, round(count(*) FILTER (WHERE l = 'normal') / nullif(count(l), 0), 6) AS rate
FROM (
    SELECT d.source, CASE WHEN toxic = 1 THEN 'real' WHEN quality = 1 THEN 'normal' WHEN quality = 0 THEN NULL
                          WHEN d.source IN ('src1', 'src2') THEN NULL WHEN lang = 'de' THEN 'normal' WHEN lang = 'fr' THEN 'real' END AS l
    FROM documents d LEFT JOIN labels USING (doc_id)
)
GROUP BY 1
""",
    "top_programs": f"WITH {S} SELECT source AS name, count(DISTINCT pid) AS pids, round(avg(value), 3) AS cpu_avg, round(max(value), 3) AS cpu_max, max(id) AS handles_max FROM s WHERE ts >= {START + 20 * DAY} GROUP BY 1 ORDER BY avg(value) DESC LIMIT 15",
    "growth_rates": f"WITH {S} SELECT source, pid, round(CASE WHEN (max(ts) - min(ts)) / 3600 > 24 THEN (arg_max(value, ts) - arg_min(value, ts)) / ((max(ts) - min(ts)) / 3600) END, 6) AS growth_per_hour FROM s WHERE value IS NOT NULL GROUP BY 1, 2",
    "gap_markers": f"WITH {S}, d AS (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) - ts AS g FROM s), t AS (SELECT source, list_sort(list(g))[count(g) // 2 + 1] AS u FROM d WHERE g IS NOT NULL GROUP BY 1 HAVING count(g) >= 2) SELECT d.source, round(ts + u, 3) AS ts FROM d JOIN t ON t.source = d.source WHERE g > 5 * u",
    "table_inventory": 'SELECT \'events\' AS "table", CAST(floor(min(epoch(ts))) AS BIGINT) AS first, CAST(floor(max(epoch(ts))) AS BIGINT) AS last, count(*) AS rows FROM events UNION ALL SELECT \'orders\', CAST(floor(min(epoch(o_orderdate))) AS BIGINT), CAST(floor(max(epoch(o_orderdate))) AS BIGINT), count(*) FROM orders',
}
QUERIES |= boards.QUERIES | detection.QUERIES | detectors.QUERIES | incidents.QUERIES | leaks.QUERIES | library.QUERIES | reading.QUERIES
ORACLE_SQL |= boards.ORACLE_SQL | detection.ORACLE_SQL | detectors.ORACLE_SQL | incidents.ORACLE_SQL | leaks.ORACLE_SQL | library.ORACLE_SQL | reading.ORACLE_SQL
