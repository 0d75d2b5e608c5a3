"""Registered queries on incidents, labels, boards and coverage, each with its SQL.

Incidents, faults and the observer's telemetry are made from ``events``: a machine is 25 users, large values are
incidents, very large errors are faults, and views are telemetry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import band, bucket_of, severity_name
from ..operators import baseline, decide, evaluate, explain, history, intervals, leak, rollup
from . import dashboards
from .base import DAY, HOUR, START, H, S, as_long, host_of, islands_sql, rounded, samples

NOW = START + 30 * DAY
KINDS = explain.KINDS


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("value > 75")
    kinds = F.array(*map(F.lit, KINDS))
    label = F.when(F.col("id") % 7 == 0, "real").when(F.col("id") % 7 == 1, "normal")
    leader = F.array(F.struct(F.col("name"), (F.col("value") / 400).alias("share")))
    end = F.when(F.col("ts") < NOW - DAY / 2, F.col("ts") + F.col("value") * 60)
    return s.select(host_of(), "id", F.col("ts").alias("ts_start"), end.alias("ts_end"), severity_name(band(F.col("value"), 120, 200)).alias("severity"), F.get(kinds, (F.col("id") % 6).cast("int")).alias("bottleneck"), (F.col("value") >= 120).alias("notified"), label.alias("user_label"), F.lit(None).cast("string").alias("auto_label"), leader.alias("contributors"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("source = 'error' and value > 150")
    return s.select(host_of(), "id", F.col("ts").alias("ts_start"), (F.col("ts") + 1800).alias("ts_end"), (F.col("id") % 2 == 0).alias("completed"))


I = f"inc AS (SELECT {H} AS source, id, ts AS ts_start, CASE WHEN ts < {NOW - DAY / 2} THEN ts + value * 60 END AS ts_end, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 120 THEN 'warning' ELSE 'info' END AS severity, {list(KINDS)}[id % 6 + 1] AS bottleneck, value >= 120 AS notified, CASE id % 7 WHEN 0 THEN 'real' WHEN 1 THEN 'normal' END AS user_label, name, value / 400 AS share FROM s WHERE value > 75), flt AS (SELECT {H} AS source, id, ts AS ts_start, ts + 1800 AS ts_end, id % 2 = 0 AS completed FROM s WHERE source = 'error' AND value > 150), d AS (SELECT *, EXISTS (SELECT 1 FROM flt WHERE flt.source = inc.source AND flt.ts_start <= coalesce(inc.ts_end, inc.ts_start) AND flt.ts_end >= inc.ts_start) AS during FROM inc)"  # noqa: E741
QUEUE = f"q AS (SELECT source, id FROM d WHERE (notified AND ts_start >= {NOW - 14 * DAY} OR NOT notified AND bottleneck = 'THERMAL' AND ts_start >= {NOW - 7 * DAY}) AND user_label IS NULL AND NOT during)"


def auto_labels(spark, sf_dir):
    """Users are leaders; one that ever bought was in the foreground, and one whose number ends in 3 may be the observer itself."""
    s = samples(spark, sf_dir)
    seen = s.where("source = 'purchase'").select(host_of(), "name", F.lit(True).alias("foreground_seen")).distinct()
    views = s.where("source = 'view'").select(host_of(), "ts", F.col("value").alias("cpu_percent"), (F.col("value") > 150).cast("int").alias("throttle_level"), F.lit(0).cast("long").alias("drop_count"))
    i = incidents(spark, sf_dir)
    return decide.auto_label(i, faults(spark, sf_dir), seen, decide.observer_window(i, views), ["U7", "u11"], observer_pattern=".*3").select("source", "id", "auto_label", "auto_label_reason")


def answer_queue(spark, sf_dir):
    return dashboards.answer_queue(incidents(spark, sf_dir), faults(spark, sf_dir), NOW).select("source", "id")


def incident_board(spark, sf_dir):
    """A top-k report: the newest 200 incidents."""
    return dashboards.incident_list(incidents(spark, sf_dir), faults(spark, sf_dir), NOW).select("source", "id", "status", "pending_answer", "attributable")


def health_board(spark, sf_dir):
    i = incidents(spark, sf_dir)
    queue = dashboards.answer_queue(i, faults(spark, sf_dir), NOW)
    return rounded(dashboards.health(i, samples(spark, sf_dir).select(host_of(), "ts"), queue, NOW, DAY), "last_end", "last_sample")


def usage_board(spark, sf_dir):
    """A top-k report: programs by seconds, without views; the time observed counts views too."""
    s = samples(spark, sf_dir).select(host_of(), F.to_date(F.timestamp_seconds("ts")).alias("day"), F.col("source").alias("name"), "value")
    usage = s.groupBy("source", "day", "name").agg(F.sum("value").alias("seconds"), F.count("*").alias("launches"))
    usage = usage.join(usage.groupBy("source", "day").agg(F.sum("seconds").alias("observed_seconds")), ["source", "day"])
    info = s.groupBy("source", "name").agg((F.max("value") > 250).alias("foreground_seen"), F.concat_ws(" on ", "name", "source").alias("description"))
    out = dashboards.usage_board(usage, info, "2024-01-11", ["view"])
    return rounded(out.select("source", "name", "seconds", "launches", "days", "description", "foreground_seen", "hours", "share"), "seconds", "hours", "share", places=3)


def leak_grades(spark, sf_dir):
    """Each user's last value against their own p99; steady is who rises in most steps."""
    s = samples(spark, sf_dir)
    from pyspark.sql import Window

    steps = s.withColumn("up", (F.col("value") >= F.lag("value").over(Window.partitionBy("pid").orderBy("ts"))).cast("int"))
    own = steps.groupBy("pid").agg(F.max_by("value", "ts").alias("last"), rollup.pct_rank("value", 0.99).alias("p99"), F.avg("up").alias("monotone"), F.count("*").alias("n"))
    p99 = F.when(F.col("n") >= 60, F.col("p99") / 4)
    rank, label = leak.leak_risk(F.col("last"), p99, F.col("monotone") + 0.5)
    return own.select("pid", severity_name(rank).alias("severity"), label.alias("label"))


def _peaks(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir).select(host_of(), "ts", "value").withColumn("id", bucket_of(F.col("ts"), 6 * HOUR).cast("long"))
    v, a, m = F.max("value"), F.avg("value"), F.min("value")
    made = {"cpu_total": v / 2, "cpu_total_z": v / 30, "disk_resp_ms": a / 5, "disk_resp_ms_z": a / 12, "disk_queue": m / 2, "mem_percent": 100 - m, "mem_percent_z": m * 2, "swap_used_mb": m - 1, "ctx_switches_ps_z": a / 15, "cpu_perf_percent": v, "gpu_util_percent": v, "gpu_temp_c": v}
    out = s.groupBy("source", "id").agg(*(F.round(x, 6).alias(k) for k, x in made.items()))
    triggers = F.array(*map(F.lit, explain.METRIC_KIND))
    reasons = F.when(F.col("cpu_total") > 95, "SwThermal, SwPowerCap").when(F.col("cpu_total") > 90, "SwPowerCap")
    return out.withColumn("throttle_reasons", reasons).withColumn("trigger_metric", F.get(triggers, F.pmod(F.col("id") / 21600, F.lit(11)).cast("int")))


def bottlenecks(spark, sf_dir):
    """The kind of each machine's six hours, as its peak and the rule that fired tell."""
    return explain.choose_kind(explain.classify(_peaks(spark, sf_dir))).select("source", "id", "bottleneck", "overridden_from")


def thinned_samples(spark, sf_dir):
    return baseline.thinned(samples(spark, sf_dir), DAY, ("source", "pid")).select("id")


def observed_time(spark, sf_dir):
    return rounded(baseline.observed_seconds(samples(spark, sf_dir).select(host_of(), "ts")), "seconds")


def warm_baseline(spark, sf_dir):
    """The second half of the samples, their baselines warmed up by the day before it."""
    out = baseline.rolling_since(samples(spark, sf_dir), START + 15 * DAY, config=baseline.Baseline(DAY, 20, 0.001))
    return rounded(out.select("id", "median", "mad", "samples", "least", "most"), "median", "mad", "least", "most", places=4)


def foreground_top(spark, sf_dir):
    s = samples(spark, sf_dir).select(host_of(), F.when(F.col("value") > 20, F.col("source")).alias("fg_program"))
    return rounded(dashboards.foreground_share(s, 3), "share", places=6)


def current_labels(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return decide.label_now(o.select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("labeled_at")))


def free_segments(spark, sf_dir):
    """What errors leave of each purchase's day."""
    s = samples(spark, sf_dir)
    span = lambda kind, length: s.where(F.col("source") == kind).select(F.col("pid").alias("source"), "id", F.col("ts").alias("lo"), (F.col("ts") + length).alias("hi"))
    return rounded(intervals.subtract(span("purchase", DAY), span("error", DAY / 4)), "lo", "hi")


def retained_rows(spark, sf_dir):
    """Rows that stay after ten days, with those in and around faults."""
    s = samples(spark, sf_dir).select(host_of(), "ts", "id")
    f = faults(spark, sf_dir)
    kept, gone = decide.retention(s, NOW, 10 * DAY, [NOW - 5 * DAY], f)
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    return count(kept, "kept").join(count(gone, "deletable"), "source", "full_outer").fillna(0, ["kept", "deletable"])


def fault_batches(spark, sf_dir):
    return rounded(evaluate.batch_progress(faults(spark, sf_dir), DAY).select("source", "lo", "hi", "n", "done"), "lo", "hi")


def covered_episodes(spark, sf_dir):
    s = samples(spark, sf_dir)
    episodes = s.where("source = 'error' and value > 60").select(host_of(), "id", F.col("ts").alias("lo"), (F.col("ts") + 6 * HOUR).alias("hi"))
    ticks = s.select(host_of(), "ts", (F.col("value") < 5).alias("suspect"))
    return evaluate.covered(episodes, ticks).select("source", "id", "reason")


def coverage(spark, sf_dir):
    s = samples(spark, sf_dir).select(host_of(), bucket_of(F.col("ts"), HOUR).alias("bucket"), F.floor(F.col("ts") / DAY).cast("long").alias("day"))
    return history.day_coverage(s, HOUR)


def day_changes(spark, sf_dir):
    """A day's seconds and each program's against the day before, one row a program."""
    s = samples(spark, sf_dir).select(host_of(), F.floor(F.col("ts") / DAY).cast("long").alias("day"), F.col("source").alias("name"), "value")
    sums = s.groupBy("source", "day", "name").agg(F.round(F.sum("value"), 3).alias("v"))
    reports = sums.groupBy("source", "day").agg(F.sum("v").alias("seconds"), F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("by_category"))
    out = dashboards.compare_days(reports)
    return rounded(out.select("source", "day", "delta", F.explode("category_delta").alias("name", "category_delta")), "delta", "category_delta")


def incident_days(spark, sf_dir):
    """Days' hours that incidents of each severity touch."""
    i = incidents(spark, sf_dir).select("severity", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    return as_long(intervals.touched_buckets(i.withColumnRenamed("severity", "source"), HOUR), "bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (auto_labels, answer_queue, incident_board, health_board, usage_board, leak_grades, bottlenecks, thinned_samples, observed_time, warm_baseline, foreground_top, current_labels, free_segments, retained_rows, fault_batches, covered_episodes, coverage, day_changes, incident_days)}

_STATUS = "CASE WHEN user_label IS NOT NULL THEN user_label WHEN during THEN 'injection' WHEN q.id IS NOT NULL THEN 'pending' ELSE '' END"
_PEAK = f"p AS (SELECT {H} AS source, CAST(floor(ts / 21600) * 21600 AS BIGINT) AS id, max(value) AS v, avg(value) AS a, min(value) AS m FROM s GROUP BY 1, 2), z AS (SELECT source, id, round(v / 2, 6) AS cpu, round(v / 30, 6) AS cpu_z, round(a / 5, 6) AS resp, round(a / 12, 6) AS resp_z, round(m / 2, 6) AS queue, round(100 - m, 6) AS mem, round(m * 2, 6) AS mem_z, round(m - 1, 6) AS swap, round(a / 15, 6) AS ctx_z, round(v, 6) AS perf FROM p)"
_POINTS = "k AS (SELECT source, id, [{'s': CASE WHEN cpu >= 70 THEN 0.5::DOUBLE + CASE WHEN cpu_z >= 3 THEN 0.3::DOUBLE ELSE 0.0 END WHEN cpu_z >= 3 AND cpu >= 40 THEN 0.4::DOUBLE ELSE 0.0 END, 'o': 0, 'k': 'CPU'}, {'s': CASE WHEN resp_z >= 3 AND resp >= 5 THEN 0.5::DOUBLE + CASE WHEN queue >= 2 THEN 0.3::DOUBLE ELSE 0.0 END WHEN queue >= 4 THEN 0.4::DOUBLE ELSE 0.0 END, 'o': -1, 'k': 'IO'}, {'s': CASE WHEN mem >= 85 THEN 0.5::DOUBLE ELSE 0.0 END + CASE WHEN swap > 0 AND mem >= 60 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN mem_z >= 3 AND mem >= 60 THEN 0.3::DOUBLE ELSE 0.0 END, 'o': -2, 'k': 'MEMORY'}, {'s': CASE WHEN perf >= 90 THEN 0.6::DOUBLE ELSE 0.0 END, 'o': -3, 'k': 'GPU'}, {'s': CASE WHEN cpu > 95 THEN 0.7::DOUBLE ELSE 0.0 END + CASE WHEN perf < 80 THEN 0.3::DOUBLE ELSE 0.0 END + CASE WHEN perf >= 80 AND perf < 80 THEN 0.2::DOUBLE ELSE 0.0 END, 'o': -4, 'k': 'THERMAL'}, {'s': CASE WHEN ctx_z >= 3 AND cpu < 60 THEN 0.5::DOUBLE ELSE 0.0 END, 'o': -5, 'k': 'CONTENTION'}] AS l FROM z)"
_TRIGGER = f"t AS (SELECT source, id, l, list_reverse(list_sort(list_filter(l, lambda x: x.s > 0)))[1] AS top, {[*explain.METRIC_KIND.values()]}[CAST(id / 21600 AS BIGINT) % 11 + 1] AS own FROM k), w AS (SELECT *, coalesce(list_filter(l, lambda x: x.k = own)[1].s, 0) AS pts FROM t), y AS (SELECT *, own IS NULL OR coalesce(top.s >= 1.5 * pts AND top.s >= pts + 0.3::DOUBLE AND top.k <> own, false) AS beaten FROM w)"

ORACLE_SQL: dict[str, str] = {
    "auto_labels": f"WITH {S}, {I}, seen AS (SELECT DISTINCT {H} AS source, name FROM s WHERE source = 'purchase'), vw AS (SELECT {H} AS source, ts, value > 150 AS throttled FROM s WHERE source = 'view'), ob AS (SELECT d.source, d.id, count(*) AS n, bool_or(throttled) AS bad FROM d JOIN vw ON vw.source = d.source AND vw.ts BETWEEN d.ts_start AND coalesce(d.ts_end, d.ts_start) GROUP BY ALL), r AS (SELECT d.source, d.id, CASE WHEN NOT notified THEN 'not_notified' WHEN user_label IS NOT NULL THEN 'labelled' WHEN during THEN 'during_fault' WHEN bottleneck = 'THERMAL' THEN 'hardware_limit' WHEN bottleneck NOT IN ('CPU', 'CONTENTION') THEN 'no_workload' WHEN share < 0.15 THEN 'no_leader' WHEN d.name IN ('u7', 'u11') THEN 'excluded' WHEN d.name LIKE '%3' AND ob.n IS NULL THEN 'observer_unseen' WHEN d.name LIKE '%3' AND bad THEN 'observer_busy' WHEN seen.name IS NULL THEN 'never_foreground' ELSE 'user_workload' END AS reason FROM d LEFT JOIN ob ON ob.source = d.source AND ob.id = d.id LEFT JOIN seen ON seen.source = d.source AND seen.name = d.name) SELECT source, id, CASE reason WHEN 'hardware_limit' THEN 'real' WHEN 'user_workload' THEN 'normal' END AS auto_label, reason AS auto_label_reason FROM r",
    "answer_queue": f"WITH {S}, {I}, {QUEUE} SELECT source, id FROM q",
    "incident_board": f"WITH {S}, {I}, {QUEUE} SELECT d.source, d.id, {_STATUS} AS status, q.id IS NOT NULL AS pending_answer, bottleneck IN ('CPU', 'IO', 'MEMORY') AS attributable FROM d LEFT JOIN q ON q.source = d.source AND q.id = d.id ORDER BY ts_start DESC, d.source, d.id LIMIT 200",
    "health_board": f"WITH {S}, {I}, {QUEUE}, a AS (SELECT {H} AS source, max(ts) AS last_sample FROM s GROUP BY 1), b AS (SELECT source, count(*) FILTER (WHERE ts_end IS NULL) AS open, max(ts_end) AS last_end FROM inc GROUP BY 1), c AS (SELECT source, count(*) AS pending FROM q GROUP BY 1), m AS (SELECT a.source, round(last_sample, 3) AS last_sample, coalesce(open, 0) AS open, round(last_end, 3) AS last_end, coalesce(pending, 0) AS pending, CASE WHEN {NOW} - last_sample > {DAY} THEN 'stale' WHEN open > 0 THEN 'incident' ELSE 'normal' END AS status FROM a LEFT JOIN b ON b.source = a.source LEFT JOIN c ON c.source = a.source) SELECT *, status IN ('incident', 'normal') AND pending > 0 AS prompt FROM m",
    "usage_board": f"WITH {S}, u AS (SELECT {H} AS source, CAST(floor(ts / 86400) AS BIGINT) AS day, source AS name, sum(value) AS seconds, count(*) AS launches, max(value) > 250 AS fg FROM s GROUP BY 1, 2, 3), i AS (SELECT source, name, bool_or(fg) AS foreground_seen FROM u GROUP BY 1, 2), r AS (SELECT * FROM u WHERE day >= {int(START // DAY) + 10}), o AS (SELECT source, sum(seconds) AS observed FROM r GROUP BY 1) SELECT r.source, r.name, round(sum(seconds), 3) AS seconds, CAST(sum(launches) AS BIGINT) AS launches, count(*) AS days, r.name || ' on ' || r.source AS description, any_value(foreground_seen) AS foreground_seen, round(sum(seconds) / 3600, 3) AS hours, round(sum(seconds) / any_value(observed), 3) AS share FROM r JOIN i ON i.source = r.source AND i.name = r.name JOIN o ON o.source = r.source WHERE r.name <> 'view' GROUP BY r.source, r.name ORDER BY sum(seconds) DESC, r.source, r.name LIMIT 30",
    "leak_grades": f"WITH {S}, t AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY pid ORDER BY ts) IS NOT NULL THEN CAST(value >= lag(value) OVER (PARTITION BY pid ORDER BY ts) AS INT) END AS up FROM s), g AS (SELECT pid, arg_max(value, ts) AS last, CASE WHEN count(*) >= 60 THEN quantile_disc(value, 0.99) / 4 END AS p99, avg(up) + 0.5 AS mono FROM t GROUP BY 1), r AS (SELECT pid, p99, CASE WHEN p99 IS NULL OR p99 <= 0 THEN 1 ELSE greatest(CASE WHEN last >= 2 * p99 THEN 2 WHEN last >= p99 THEN 1 ELSE 0 END - CASE WHEN mono < 0.95 THEN 1 ELSE 0 END, 0) END AS rank FROM g) SELECT pid, ['info', 'warning', 'critical'][rank + 1] AS severity, CASE WHEN p99 IS NULL OR p99 <= 0 THEN 'unknown_leak' ELSE 'leak' END AS label FROM r",
    "bottlenecks": f"WITH {S}, {_PEAK}, {_POINTS}, {_TRIGGER} SELECT source, id, CASE WHEN beaten THEN coalesce(top.k, 'NONE') ELSE own END AS bottleneck, CASE WHEN beaten AND own IS NOT NULL AND top IS NOT NULL THEN own END AS overridden_from FROM y",
    "thinned_samples": f"WITH RECURSIVE {S}, c AS (SELECT source, pid, min(ts) AS ts FROM s GROUP BY 1, 2 UNION ALL SELECT s.source, s.pid, min(s.ts) FROM c JOIN s ON s.source = c.source AND s.pid = c.pid AND s.ts - c.ts >= 86400 GROUP BY 1, 2) SELECT id FROM s JOIN c ON s.source = c.source AND s.pid = c.pid AND s.ts = c.ts",
    "observed_time": f"WITH {S}, g AS (SELECT {H} AS source, lead(ts) OVER (PARTITION BY floor(pid / 25) ORDER BY ts) - ts AS g FROM s), m AS (SELECT source, median(g) AS m FROM g WHERE g IS NOT NULL GROUP BY 1) SELECT g.source, round(sum(CASE WHEN g <= 3 * m THEN g END), 3) AS seconds FROM g JOIN m ON m.source = g.source WHERE g IS NOT NULL GROUP BY 1",
    "warm_baseline": f"WITH {S}, m AS (SELECT id, ts, median(value) OVER f AS median, mad(value) OVER f AS mad, count(value) OVER f AS samples, min(value) OVER f AS least, max(value) OVER f AS most FROM s WINDOW f AS (PARTITION BY source ORDER BY ts RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW)) SELECT id, round(median, 4) AS median, round(mad, 4) AS mad, samples, round(least, 4) AS least, round(most, 4) AS most FROM m WHERE ts >= {START + 15 * DAY}",
    "foreground_top": f"WITH {S}, g AS (SELECT {H} AS source, source AS fg_program, count(*) AS n FROM s WHERE value > 20 GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, fg_program) AS k FROM g) SELECT source, fg_program, n, round(share, 6) AS share FROM r WHERE k <= 3",
    "current_labels": "SELECT o_orderpriority AS source, o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS user_label FROM orders GROUP BY 1, 2",
    "free_segments": f"WITH {S}, x AS (SELECT pid AS source, id, ts AS lo, ts + {DAY} AS hi FROM s WHERE source = 'purchase'), b AS (SELECT pid AS source, ts AS lo, ts + {DAY / 4} AS hi FROM s WHERE source = 'error'), {islands_sql('b', 'm')}, z AS (SELECT x.source, x.id, greatest(m.lo, x.lo) AS lo, least(m.hi, x.hi) AS hi FROM x JOIN m ON m.source = x.source AND m.lo < x.hi AND m.hi > x.lo UNION ALL SELECT source, id, lo, lo FROM x UNION ALL SELECT source, id, hi, hi FROM x), y AS (SELECT source, id, hi AS lo, lead(lo) OVER (PARTITION BY source, id ORDER BY lo, hi) AS hi FROM z) SELECT source, id, round(lo, 3) AS lo, round(hi, 3) AS hi FROM y WHERE hi > lo",
    "retained_rows": f"WITH {S}, {I}, r AS (SELECT {H} AS source, ts FROM s), k AS (SELECT source, ts >= {NOW - 10 * DAY} OR EXISTS (SELECT 1 FROM flt WHERE flt.source = r.source AND r.ts BETWEEN flt.ts_start - 900 AND flt.ts_end + 900) AS keep FROM r) SELECT source, count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS deletable FROM k GROUP BY 1",
    "fault_batches": f"WITH {S}, {I}, n AS (SELECT *, CASE WHEN ts_start - lag(ts_start) OVER (PARTITION BY source ORDER BY ts_start) > 86400 THEN 1 ELSE 0 END AS nw FROM flt), b AS (SELECT *, sum(nw) OVER (PARTITION BY source ORDER BY ts_start) AS k FROM n) SELECT source, round(min(ts_start), 3) AS lo, round(max(ts_end), 3) AS hi, count(*) AS n, count(*) FILTER (WHERE completed) AS done FROM b GROUP BY source, k",
    "covered_episodes": f"WITH {S}, e AS (SELECT {H} AS source, id, ts AS lo, ts + 21600 AS hi FROM s WHERE source = 'error' AND value > 60), c AS (SELECT {H} AS source, ts FROM s WHERE value >= 5), g AS (SELECT e.source, e.id, count(c.ts) AS n, max(c.ts) - min(c.ts) AS seen FROM e LEFT JOIN c ON c.source = e.source AND c.ts BETWEEN e.lo AND e.hi GROUP BY 1, 2) SELECT source, id, CASE WHEN n < 3 THEN 'few_ticks' WHEN seen < 10800 THEN 'short_span' END AS reason FROM g",
    "coverage": f"WITH {S} SELECT {H} AS source, CAST(floor(ts / 86400) AS BIGINT) AS day, count(DISTINCT floor(ts / 3600)) AS buckets, round(count(DISTINCT floor(ts / 3600)) * 1.0::DOUBLE, 3) AS hours FROM s GROUP BY 1, 2",
    "day_changes": f"WITH {S}, c AS (SELECT {H} AS source, CAST(floor(ts / 86400) AS BIGINT) AS day, source AS name, round(sum(value), 3) AS v FROM s GROUP BY 1, 2, 3), t AS (SELECT source, day, sum(v) AS v, lag(day) OVER (PARTITION BY source ORDER BY day) AS before FROM c GROUP BY 1, 2), n AS (SELECT t.source, t.day, t.before, x.name FROM t JOIN c x ON x.source = t.source AND (x.day = t.day OR x.day = t.before) WHERE before IS NOT NULL GROUP BY ALL) SELECT n.source, n.day, round(t.v - u.v, 3) AS delta, n.name, round(coalesce(a.v, 0) - coalesce(b.v, 0), 3) AS category_delta FROM n JOIN t ON t.source = n.source AND t.day = n.day JOIN t u ON u.source = n.source AND u.day = n.before LEFT JOIN c a ON a.source = n.source AND a.day = n.day AND a.name = n.name LEFT JOIN c b ON b.source = n.source AND b.day = n.before AND b.name = n.name",
    "incident_days": f"WITH {S}, {I} SELECT DISTINCT severity AS source, CAST(3600 * unnest(range(CAST(floor(ts_start / 3600) AS BIGINT), CAST(floor(coalesce(ts_end, ts_start) / 3600) AS BIGINT) + 1)) AS BIGINT) AS bucket FROM inc",
}
