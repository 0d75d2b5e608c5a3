"""Registered queries on incidents, scoring, analysis and process trees, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import band, severity_name
from ..operators import decide, evaluate, explain, joins
from .base import DAY, HOUR, H, S, host_of, islands_sql, rounded, samples


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where("value > 75")
    return s.select(host_of(), "ts", F.col("source").alias("detector"), F.least(F.col("value") / 200, F.lit(1.0)).alias("score"), severity_name(band(F.col("value"), 120, 200)).alias("severity"), "id")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident for each large value; those of views that are very large are still open."""
    s = samples(spark, sf_dir).where("value > 75")
    end = F.when(~((F.col("source") == "view") & (F.col("value") > 110)), F.col("ts") + F.col("value") * 60)
    return s.select(host_of(), "id", F.col("ts").alias("ts_start"), end.alias("ts_end"), severity_name(band(F.col("value"), 120, 200)).alias("severity"))


def suppression(spark, sf_dir):
    """Chains of incidents that hide each other on one machine, open ones among them."""
    return decide.suppress(incidents(spark, sf_dir)).select("source", "id", "severity", "suppressed_by")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("source = 'error' and value > 60").select(host_of(), F.col("ts").alias("lo"), (F.col("ts") + 1800).alias("hi"), "id")


def detector_scores(spark, sf_dir):
    """Every machine with an alarm or an episode, for every detector."""
    out = evaluate.scores(evaluate.alarms(signals(spark, sf_dir), HOUR), episodes(spark, sf_dir))
    return rounded(out.select("source", "detector", "tp", "fn", "fp", "precision", "recall", "f1", "latency"), "precision", "recall", "f1", "latency", places=6)


def descendants(spark, sf_dir):
    """Parts as processes, each the child of a seventh of its number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("all").alias("source"), (F.col("p_partkey") + 1).cast("long").alias("pid"))
    edges = p.withColumn("ppid", F.floor(F.col("pid") / 7).cast("long"))
    roots = edges.where("ppid = 0").select("source", "pid")
    return joins.descendants(edges, roots).select("root", "pid", F.col("depth").cast("long").alias("depth"))


def process_parents(spark, sf_dir):
    """Who was the parent when a process started: users are pids that start again and again."""
    starts = samples(spark, sf_dir).select(F.lit("all").alias("source"), "id", "ts", "pid", F.floor(F.col("pid") / 2).cast("long").alias("ppid"))
    return rounded(joins.process_parents(starts, 5 * DAY).select("id", "parent_ts"), "parent_ts")


def refined_bounds(spark, sf_dir):
    """Bounds of large errors by two metrics of their machine, what is usual being fixed by the five days before."""
    s = samples(spark, sf_dir)
    own = s.where("source = 'error' and value > 75").select(host_of(), "id", F.col("ts").alias("ts_start"), (F.col("ts") + F.col("value") * 60).alias("ts_end"))
    metrics = s.select(host_of(), "ts", F.col("value").alias("cpu_total"), F.when(F.col("source") != "click", F.col("value") + F.col("pid") % 25).alias("mem_percent"))
    return rounded(explain.refined_bounds(own, metrics, before=DAY, after=2 * DAY, look_back=5 * DAY, least=10, calm_run=3, least_hot=1, calm_after=2), "start", "end")


def busiest_gpu(spark, sf_dir):
    """Device 0's busiest sample inside each incident, whether or not the incident has a peak."""
    s = samples(spark, sf_dir)
    own = s.where("source = 'error' and value > 60").select(host_of(), "id", F.col("ts").alias("ts_start"), (F.col("ts") + F.col("value") * 1800).alias("ts_end"))
    peaks = own.where("id % 2 = 0").select("source", "id", F.col("ts_start").alias("peak_ts"))
    gpu = s.select(host_of(), "ts", F.when(F.col("source") != "signup", 0).otherwise(1).alias("gpu_index"), F.round("value").alias("util_percent"), F.col("pid").alias("temp_c"), F.col("source").alias("throttle_reasons"))
    return rounded(explain.with_gpu(peaks, own, gpu).select("source", "id", "peak_ts", "gpu_util_percent", "gpu_temp_c", "throttle_reasons"), "peak_ts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (suppression, detector_scores, descendants, process_parents, refined_bounds, busiest_gpu)}

_SIGNALS = f"g AS (SELECT {H} AS source, ts, source AS detector, least(value / 200, 1.0) AS score FROM s WHERE value > 75)"
_ALARMS = f"""{_SIGNALS}, a1 AS (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source, detector ORDER BY ts, score) > {HOUR} THEN 1 ELSE 0 END AS nw FROM g
), a2 AS (
    SELECT *, sum(nw) OVER (PARTITION BY source, detector ORDER BY ts, score) AS k FROM a1
), a AS (
    SELECT source, detector, k, min(ts) AS first, max(ts) AS last FROM a2 GROUP BY source, detector, k
)"""

ORACLE_SQL: dict[str, str] = {
    "suppression": f"""
WITH RECURSIVE {S}, i AS (
    SELECT {H} AS source, id, ts AS lo, CASE WHEN source = 'view' AND value > 110 THEN NULL ELSE ts + value * 60 END AS te,
           CASE WHEN value >= 200 THEN 2 WHEN value >= 120 THEN 1 ELSE 0 END AS rank
    FROM s WHERE value > 75
), o AS (
    SELECT *, coalesce(te, 1e18) AS hi, row_number() OVER (PARTITION BY source ORDER BY rank DESC, lo, id) AS n, row_number() OVER (PARTITION BY source ORDER BY lo, id) AS e FROM i
), c AS (
    SELECT a.source, a.n, a.te, list(b.n) FILTER (WHERE b.n IS NOT NULL) AS above
    FROM o a LEFT JOIN o b ON b.source = a.source AND b.id <> a.id AND b.lo <= a.hi AND b.hi >= a.lo AND (b.rank > a.rank OR b.rank = a.rank AND b.lo < a.lo)
    GROUP BY ALL
), f AS (
    SELECT source, n, CAST([] AS BIGINT[]) AS hits, [n] AS free FROM c WHERE n = 1
    UNION ALL
    SELECT c.source, c.n, CASE WHEN c.te IS NULL THEN [] ELSE coalesce(list_intersect(f.free, c.above), []) END,
           CASE WHEN c.te IS NOT NULL AND len(coalesce(list_intersect(f.free, c.above), [])) > 0 THEN f.free ELSE list_append(f.free, c.n) END
    FROM f JOIN c ON c.source = f.source AND c.n = f.n + 1
), hit AS (
    SELECT source, n, unnest(hits) AS m FROM f
), best AS (
    SELECT hit.source, hit.n, arg_min(o.id, o.e) AS suppressed_by FROM hit JOIN o ON o.source = hit.source AND o.n = hit.m GROUP BY 1, 2
)
SELECT o.source, o.id, ['info', 'warning', 'critical'][o.rank + 1] AS severity, best.suppressed_by FROM o LEFT JOIN best USING (source, n)
""",
    "detector_scores": f"""
WITH {S}, {_ALARMS}, e AS (
    SELECT {H} AS source, id, ts AS lo, ts + 1800 AS hi FROM s WHERE source = 'error' AND value > 60
), grid AS (
    SELECT * FROM (SELECT source FROM a UNION SELECT source FROM e) CROSS JOIN (SELECT DISTINCT detector FROM a)
), hit AS (
    SELECT grid.source, grid.detector, e.id, e.lo, min(CASE WHEN a.first IS NOT NULL THEN greatest(a.first, e.lo) END) AS first
    FROM grid JOIN e ON e.source = grid.source
    LEFT JOIN a ON a.source = e.source AND a.detector = grid.detector AND a.first <= e.hi + 90 AND a.last >= e.lo
    GROUP BY ALL
), found AS (
    SELECT source, detector, count(first) AS tp, count(*) - count(first) AS fn, median(first - lo) AS latency FROM hit GROUP BY 1, 2
), b AS (
    SELECT source, lo, hi + 90 AS hi FROM e
), {islands_sql("b", "m")}, z AS (
    SELECT a.source, a.detector, a.k, a.first AS lo, a.last + 0.001 AS hi, m.lo AS blo, m.hi AS bhi FROM a JOIN m ON m.source = a.source AND m.lo < a.last + 0.001 AND m.hi > a.first
    UNION ALL SELECT source, detector, k, first, last + 0.001, first, first FROM a
    UNION ALL SELECT source, detector, k, first, last + 0.001, last + 0.001, last + 0.001 FROM a
), y AS (
    SELECT *, greatest(bhi, lo) AS f, lead(greatest(blo, lo)) OVER (PARTITION BY source, detector, k ORDER BY greatest(blo, lo), least(bhi, hi)) AS t FROM z
), wrong AS (
    SELECT source, detector, CAST(sum(greatest(1, floor((t - f) / 60))) AS BIGINT) AS fp FROM y WHERE t > f GROUP BY 1, 2
), x AS (
    SELECT source, detector, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, latency FROM grid LEFT JOIN found USING (source, detector) LEFT JOIN wrong USING (source, detector)
), r AS (
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM x
)
SELECT source, detector, tp, fn, fp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1, round(latency, 6) AS latency FROM r
""",
    "descendants": """
WITH RECURSIVE e AS (
    SELECT CAST(p_partkey + 1 AS BIGINT) AS pid, CAST(floor((p_partkey + 1) / 7) AS BIGINT) AS ppid FROM part
), r AS (
    SELECT pid AS root, pid, CAST(0 AS BIGINT) AS depth FROM e WHERE ppid = 0
    UNION ALL
    SELECT r.root, e.pid, r.depth + 1 FROM r JOIN e ON e.ppid = r.pid
)
SELECT root, pid, depth FROM r
""",
    "process_parents": f"""
WITH {S}, p AS (SELECT id, ts, pid, CAST(floor(pid / 2) AS BIGINT) AS ppid FROM s)
SELECT a.id, round(CASE WHEN a.ppid <> a.pid AND a.ts - b.ts <= {5 * DAY} THEN b.ts END, 3) AS parent_ts FROM p a ASOF LEFT JOIN p b ON a.ppid = b.pid AND a.ts >= b.ts
""",
    "refined_bounds": f"""
WITH {S}, h AS (
    SELECT {H} AS source, ts, value, source AS kind, pid, id FROM s
), v AS (
    SELECT source, ts, 'cpu_total' AS metric, 1 AS o, value FROM h UNION ALL SELECT source, ts, 'mem_percent', 2, value + pid % 25 FROM h WHERE kind <> 'click'
), i AS (
    SELECT source, id, ts AS st, ts + value * 60 AS te FROM h WHERE kind = 'error' AND value > 75
), prior AS (
    SELECT i.source, i.id, v.metric, median(value) AS md, greatest(mad(value) * 1.4826, abs(median(value)) * 0.05) AS sg
    FROM i JOIN v ON v.source = i.source AND v.ts >= st - {5 * DAY} AND v.ts < st GROUP BY ALL HAVING count(*) >= 10
), m AS (
    SELECT i.*, v.ts, v.metric, o, value >= md + 2 * sg AS hot
    FROM i JOIN v ON v.source = i.source AND v.ts BETWEEN st - {DAY} AND te + {2 * DAY} JOIN prior p ON p.source = i.source AND p.id = i.id AND p.metric = v.metric WHERE sg > 0
), back AS (
    SELECT *, sum(hot::INT) OVER (PARTITION BY source, id, metric ORDER BY ts DESC) AS run FROM m WHERE ts <= st
), calm AS (
    SELECT *, sum((NOT hot)::INT) OVER (PARTITION BY source, id, metric, run ORDER BY ts DESC) AS n FROM back
), stopped AS (
    SELECT *, max((n >= 3)::INT) OVER (PARTITION BY source, id, metric ORDER BY ts DESC) AS gone FROM calm
), onset AS (
    SELECT source, id, metric, min(ts) AS onset FROM stopped WHERE gone = 0 AND hot GROUP BY ALL
), ahead AS (
    SELECT *, sum(hot::INT) OVER (PARTITION BY source, id, metric ORDER BY ts) AS run FROM m WHERE ts >= te
), cooled AS (
    SELECT *, row_number() OVER (PARTITION BY source, id, metric, run ORDER BY ts) AS n FROM ahead WHERE NOT hot
), recovery AS (
    SELECT source, id, metric, min(ts) AS recovery FROM cooled WHERE n = 2 GROUP BY ALL
), spans AS (
    SELECT source, id, metric, coalesce(onset, st) AS lo, coalesce(recovery, te) AS hi FROM onset FULL JOIN recovery USING (source, id, metric) JOIN i USING (source, id)
), widest AS (
    SELECT source, id, arg_max(lo, (hi - lo) * 1e3 - CASE metric WHEN 'cpu_total' THEN 1 ELSE 2 END * 1e-4) AS lo, arg_max(hi, (hi - lo) * 1e3 - CASE metric WHEN 'cpu_total' THEN 1 ELSE 2 END * 1e-4) AS hi FROM spans GROUP BY ALL
)
SELECT source, id, round(CASE WHEN hi - lo > te - st THEN lo ELSE st END, 3) AS start, round(CASE WHEN hi - lo > te - st THEN hi ELSE te END, 3) AS "end" FROM i LEFT JOIN widest USING (source, id)
""",
    "busiest_gpu": f"""
WITH {S}, h AS (
    SELECT {H} AS source, ts, value, source AS kind, pid, id FROM s
), i AS (
    SELECT source, id, ts AS st, ts + value * 1800 AS te FROM h WHERE kind = 'error' AND value > 60
), met AS (
    SELECT i.source, i.id, row_number() OVER (PARTITION BY i.source, i.id ORDER BY round(h.value) DESC, h.ts) AS n, round(h.value) AS util, h.pid AS temp, h.kind
    FROM i JOIN h ON h.source = i.source AND h.ts BETWEEN st AND te WHERE h.kind <> 'signup'
)
SELECT source, id, CASE WHEN i.id % 2 = 0 THEN round(st, 3) END AS peak_ts, util AS gpu_util_percent, temp AS gpu_temp_c, kind AS throttle_reasons
FROM i LEFT JOIN (SELECT * FROM met WHERE n = 1) USING (source, id)
WHERE i.id % 2 = 0 OR util IS NOT NULL
""",
}
