"""Registered queries on rollups with all parts, rules, gated baselines and onsets, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket_of
from ..operators import baseline, explain, rollup, rules
from .base import DAY, HOUR, H, S, as_long, carried_sql, host_of, rounded, samples, settled_sql

#: Rules over samples of a machine: each is sustained and cooled down by itself.
PACK = (
    rules.Rule("any", (rules.Condition("value", ">", "40"),), 0, DAY, "info", "all", "value {value}"),
    rules.Rule("large", (rules.Condition("value", ">", "30"), rules.Condition("kind", "contains", "C")), 0, 2 * DAY, "warning", "all", "{kind} has {value}"),
    rules.Rule("long", (rules.Condition("value", ">", "15"), rules.Condition("kind", "contains", "sign")), 2 * HOUR, 3 * DAY, "critical", "any", "long"),
)


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(host_of(), "ts", "pid", F.col("source").alias("name"), "value", "id")


def rule_pack(spark, sf_dir):
    ticks = _hosts(spark, sf_dir).withColumnRenamed("name", "kind")
    out = rules.rule_signals(ticks, PACK)
    return rounded(out.select("source", "ts", "rule", "severity", F.concat_ws(",", "fired").alias("fired"), "explanation", "score"), "ts")


def minute_board(spark, sf_dir):
    """The minute rollup with all its parts, over six hours in place of a minute. The programs' load is scaled so that no sum ends in a half thousandth, which two engines may round apart."""
    h, size = _hosts(spark, sf_dir), 6 * HOUR
    metrics = h.select("source", "ts", F.col("value").alias("cpu_total"), (F.col("value") + F.col("pid") % 7).alias("cpu_max_core"))
    gpu = h.where("name = 'view'").select("source", "ts", F.lit(0).alias("gpu_index"), F.col("value").alias("util_percent"), F.col("pid").alias("vram_used_mb"), F.col("value").alias("temp_c"), F.col("value").alias("power_w"), F.col("value").alias("clock_sm_mhz"))
    processes = h.select("source", "ts", "name", (F.col("value") * 1.00071).alias("cpu_percent"), (F.col("value") > 50).alias("foreground"))
    gaps = h.where("name = 'error' and value > 150").select("source", F.col("ts").alias("lo"), (F.col("ts") + HOUR).alias("hi"))
    out = rollup.metrics_1m(metrics, gpu, processes, gaps, size)
    return as_long(out.select("source", "bucket", "sample_count", "cpu_total_mean", "cpu_total_max", "cpu_total_p95", "cpu_total_std", "cpu_max_core_mean", "cpu_imbalance_mean", "gpu_util_mean", "gpu_temp_max", "gpu_clock_min", "fg_program", "fg_ratio", "top_cpu_program", "top_cpu_share", "has_gap"), "bucket")


def net_board(spark, sf_dir):
    h = _hosts(spark, sf_dir)
    c = h.select("source", F.floor("ts").alias("ts"), "name", F.when(F.col("value") > 5, F.concat(F.lit("r"), F.col("pid") % 11)).alias("raddr"), (F.col("pid") % 7).alias("rport"), F.when(F.col("value") < 10, "LISTEN").otherwise("ESTABLISHED").alias("status"))
    return as_long(rollup.net_rollup(c, DAY), "bucket")


def backfilled(spark, sf_dir):
    """Hours without a rollup (here those whose samples are all small) are folded again."""
    h = _hosts(spark, sf_dir)
    there = h.where("value > 20").select("source", bucket_of(F.col("ts"), HOUR).alias("bucket"))
    missing = rollup.missing_buckets(h, there, HOUR, 0.0, 1e12)
    fold = lambda raw: raw.groupBy("source", bucket_of(F.col("ts"), HOUR).cast("long").alias("bucket")).agg(F.count("*").alias("n"), rollup.max3("value").alias("max"))
    return rollup.backfill(h, missing, fold, HOUR)


def gated_baseline(spark, sf_dir):
    """Baselines learnt under load alone (all large values) and carried to the other samples; null until five are learnt."""
    config = baseline.Baseline(DAY, 5)
    out = baseline.load_gated(_hosts(spark, sf_dir), "value", "value", 30.0, config=config)
    return rounded(out.select("id", "median", "samples", "most"), "median", "most", places=4)


def program_baselines(spark, sf_dir):
    """A known program's own baselines, of samples two hours apart at least and null until there are three; the machine's for samples without one."""
    h = _hosts(spark, sf_dir).withColumn("metric", F.lit("value")).withColumn("program", F.when(F.col("name") != "view", F.col("name")))
    out = baseline.conditional(h, config=baseline.Baseline(DAY, 3), spacing=2 * HOUR)
    return rounded(out.select("id", "median", "mad", "samples"), "median", "mad", places=4)


def onsets(spark, sf_dir):
    """Where each large error's hot time began and ended, by the machine's samples around it."""
    h = _hosts(spark, sf_dir)
    marks = h.where("name = 'error' and value > 100").select("source", F.col("id").alias("incident"), F.col("ts").alias("signal_ts"))
    from ..operators.joins import in_spans

    spans = marks.select("source", "incident", "signal_ts", (F.col("signal_ts") - DAY).alias("lo"), (F.col("signal_ts") + DAY).alias("hi"))
    met = in_spans(h.select("source", "ts", "value", F.lit(30.0).alias("median"), F.lit(10.0).alias("sigma")), spans).withColumnRenamed("incident", "id")
    a = explain.onset(met, calm_run=4, least_hot=2).select("source", "id", "onset", "hot")
    b = explain.recovery(met, calm_run=3)
    return rounded(a.join(b, ["source", "id"], "full_outer"), "onset", "recovery")


def stock_growth(spark, sf_dir):
    """Programs whose level grew most in the two days before each large error."""
    h = _hosts(spark, sf_dir)
    i = h.where("name = 'error' and value > 100").select("source", "id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    out = explain.stock_contributors(i, h, "value", 2 * DAY)
    return rounded(out.select("source", "id", "name", "delta", "after", F.col("rank").cast("long").alias("rank"), F.size("pids").cast("long").alias("n_pids")), "delta", "after")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rule_pack, minute_board, net_board, backfilled, gated_baseline, program_baselines, onsets, stock_growth)}

T = f"h AS (SELECT {H} AS source, ts, pid, source AS name, value, id FROM s)"


def _fired(k: str, condition: str, hold: float, cooldown: float) -> str:
    """CTEs for one rule: ``f{k}`` has the (source, ts) at which it fires."""
    return f"""r{k} AS (SELECT *, sum(CASE WHEN {condition} THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts) AS run FROM h), t{k} AS (SELECT *, min(ts) OVER (PARTITION BY source, run) AS since FROM r{k} WHERE {condition}), e{k} AS (SELECT * FROM t{k} WHERE ts - since >= {hold}), f{k} AS (SELECT source, min(ts) AS ts FROM e{k} GROUP BY 1 UNION ALL SELECT e{k}.source, min(e{k}.ts) FROM f{k} JOIN e{k} ON e{k}.source = f{k}.source AND e{k}.ts - f{k}.ts >= {cooldown} GROUP BY 1)"""


_SHOWN = "CAST(round(value, 1) AS VARCHAR)"
ORACLE_SQL: dict[str, str] = {
    "rule_pack": f"WITH RECURSIVE {S}, {T}, {_fired('0', 'value > 40', 0, DAY)}, {_fired('1', "value > 30 AND contains(lower(name), 'c')", 0, 2 * DAY)}, {_fired('2', "(value > 15 OR contains(name, 'sign'))", 2 * HOUR, 3 * DAY)}, u AS (SELECT source, ts, 0 AS o, 'any' AS rule, 0 AS rank FROM f0 UNION ALL SELECT source, ts, 1, 'large', 1 FROM f1 UNION ALL SELECT source, ts, 2, 'long', 2 FROM f2), n AS (SELECT source, ts, string_agg(rule, ',' ORDER BY o) AS fired, arg_max(rule, rank) AS rule, max(rank) AS rank FROM u GROUP BY 1, 2) SELECT n.source, round(n.ts, 3) AS ts, rule, ['info', 'warning', 'critical'][rank + 1] AS severity, fired, CASE rule WHEN 'any' THEN 'value ' || {_SHOWN} WHEN 'large' THEN name || ' has ' || {_SHOWN} ELSE 'long' END AS explanation, 0.5::DOUBLE AS score FROM n JOIN h ON h.source = n.source AND h.ts = n.ts",
    "minute_board": f"WITH {S}, {T}, b AS (SELECT *, CAST(floor(ts / 21600) * 21600 AS BIGINT) AS bucket FROM h), m AS (SELECT source, bucket, count(*) AS sample_count, {settled_sql("avg(value)", 3)} AS cpu_total_mean, round(max(value), 3) AS cpu_total_max, round(list_sort(list(value))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 3) AS cpu_total_p95, {settled_sql("stddev_pop(value)", 3)} AS cpu_total_std, {settled_sql("avg(value + pid % 7)", 3)} AS cpu_max_core_mean, {settled_sql("avg((value + pid % 7) - value)", 3)} AS cpu_imbalance_mean FROM b GROUP BY 1, 2), g AS (SELECT source, bucket, {settled_sql("avg(value)", 3)} AS gpu_util_mean, round(max(value), 3) AS gpu_temp_max, round(min(value), 3) AS gpu_clock_min FROM b WHERE name = 'view' GROUP BY 1, 2), c AS (SELECT source, bucket, name, count(*) AS n, sum(count(*)) OVER (PARTITION BY source, bucket) AS al, row_number() OVER (PARTITION BY source, bucket ORDER BY count(*) DESC, name) AS k FROM b WHERE value > 50 GROUP BY 1, 2, 3), d AS (SELECT source, bucket, name, round(sum(value * 1.00071::DOUBLE), 9) AS v, row_number() OVER (PARTITION BY source, bucket ORDER BY round(sum(value * 1.00071::DOUBLE), 9) DESC, name) AS k FROM b WHERE value > 0 GROUP BY 1, 2, 3), tk AS (SELECT source, bucket, count(DISTINCT ts) AS n FROM b WHERE value > 0 GROUP BY 1, 2), gp AS (SELECT DISTINCT source, CAST(21600 * unnest(range(CAST(floor(ts / 21600) AS BIGINT), CAST(floor((ts + 3600) / 21600) AS BIGINT) + 1)) AS BIGINT) AS bucket FROM h WHERE name = 'error' AND value > 150) SELECT m.*, gpu_util_mean, gpu_temp_max, gpu_clock_min, c.name AS fg_program, {settled_sql("c.n / c.al", 3)} AS fg_ratio, d.name AS top_cpu_program, {settled_sql("d.v / tk.n", 3)} AS top_cpu_share, gp.bucket IS NOT NULL AS has_gap FROM m LEFT JOIN g ON g.source = m.source AND g.bucket = m.bucket LEFT JOIN c ON c.source = m.source AND c.bucket = m.bucket AND c.k = 1 LEFT JOIN d ON d.source = m.source AND d.bucket = m.bucket AND d.k = 1 LEFT JOIN tk ON tk.source = m.source AND tk.bucket = m.bucket LEFT JOIN gp ON gp.source = m.source AND gp.bucket = m.bucket",
    "net_board": f"WITH {S}, {T} SELECT source, CAST(floor(floor(ts) / 86400) * 86400 AS BIGINT) AS bucket, name, round(count(*) / count(DISTINCT floor(ts)), 3) AS conns_mean, count(DISTINCT CASE WHEN value > 5 THEN pid % 11 END) AS remotes, count(DISTINCT CASE WHEN value > 5 THEN pid % 7 END) AS ports, count(*) FILTER (WHERE value < 10) AS listens FROM h GROUP BY 1, 2, 3",
    "backfilled": f"WITH {S}, {T} SELECT source, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n, round(max(value), 3) AS max FROM h GROUP BY 1, 2 HAVING max(value) <= 20",
    "gated_baseline": f"""
WITH {S}, {T}, l AS (
    SELECT source, ts, median(value) OVER w AS md, count(*) OVER w AS n, max(value) OVER w AS mx FROM h WHERE value >= 30
    WINDOW w AS (PARTITION BY source ORDER BY ts RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)
)
SELECT h.id, CASE WHEN n >= 5 THEN round(md, 4) END AS median, n AS samples, CASE WHEN n >= 5 THEN round(mx, 4) END AS most FROM h ASOF LEFT JOIN l ON h.source = l.source AND h.ts >= l.ts
""",
    "program_baselines": f"""
WITH RECURSIVE {S}, {T}, g AS (
    SELECT source, name, ts, value AS v FROM h WHERE name <> 'view'
), {carried_sql("p", "g", "source, name", 2 * HOUR, DAY, 3)}, a AS (
    SELECT id, name, median(value) OVER f AS md, mad(value) OVER f AS ma, count(*) OVER f AS n FROM h
    WINDOW f AS (PARTITION BY source ORDER BY ts RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)
)
SELECT h.id, round(p.md, 4) AS median, round(p.ma, 4) AS mad, p.n AS samples FROM h ASOF JOIN p ON h.source = p.source AND h.name = p.name AND h.ts >= p.ts
UNION ALL
SELECT id, round(md, 4), round(ma, 4), n FROM a WHERE name = 'view'
""",
    "onsets": f"WITH {S}, {T}, i AS (SELECT source, id, ts AS st FROM h WHERE name = 'error' AND value > 100), m AS (SELECT i.source, i.id, i.st, h.ts, h.value >= 50 AS hot FROM i JOIN h ON h.source = i.source AND h.ts BETWEEN st - 86400 AND st + 86400), a AS (SELECT *, sum(hot::INT) OVER (PARTITION BY source, id ORDER BY ts DESC) AS run FROM m WHERE ts <= st), c AS (SELECT *, sum((NOT hot)::INT) OVER (PARTITION BY source, id, run ORDER BY ts DESC) AS calm FROM a), d AS (SELECT *, max((calm >= 4)::INT) OVER (PARTITION BY source, id ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS stopped FROM c), o AS (SELECT source, id, min(ts) AS onset, count(*) AS hot FROM d WHERE stopped = 0 AND hot GROUP BY 1, 2 HAVING count(*) >= 2), e AS (SELECT *, sum(hot::INT) OVER (PARTITION BY source, id ORDER BY ts) AS run FROM m WHERE ts >= st), f AS (SELECT *, row_number() OVER (PARTITION BY source, id, run ORDER BY ts) AS n FROM e WHERE NOT hot), r AS (SELECT source, id, min(ts) AS recovery FROM f WHERE n = 3 GROUP BY 1, 2) SELECT coalesce(o.source, r.source) AS source, coalesce(o.id, r.id) AS id, round(onset, 3) AS onset, hot, round(recovery, 3) AS recovery FROM o FULL JOIN r ON r.source = o.source AND r.id = o.id",
    "stock_growth": f"WITH {S}, {T}, i AS (SELECT source, id, ts AS st FROM h WHERE name = 'error' AND value > 100), m AS (SELECT i.source, i.id, h.pid, h.name, h.ts, h.value FROM i JOIN h ON h.source = i.source AND h.ts BETWEEN st - 172800 AND st), p AS (SELECT *, max(value) OVER (PARTITION BY source, id, pid, name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM m), t AS (SELECT *, sum(CASE WHEN value < 0.5 * pk THEN 1 ELSE 0 END) OVER (PARTITION BY source, id, pid, name ORDER BY ts) AS tr FROM p), l AS (SELECT *, max(tr) OVER (PARTITION BY source, id, pid, name) AS lt FROM t), q AS (SELECT *, count(*) OVER (PARTITION BY source, id, pid, name) AS n, row_number() OVER (PARTITION BY source, id, pid, name ORDER BY ts) AS k FROM l WHERE tr = lt), g AS (SELECT source, id, pid, name, median(CASE WHEN k > n - greatest(floor(n / 4), 1) THEN value END) AS af, median(CASE WHEN k <= greatest(floor(n / 4), 1) THEN value END) AS be FROM q GROUP BY 1, 2, 3, 4), u AS (SELECT source, id, name, round(sum(greatest(af - be, 0)), 9) AS delta, sum(af) AS after, count(DISTINCT pid) AS n_pids FROM g GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY delta DESC, name) AS rank FROM u WHERE delta > 0) SELECT source, id, name, round(delta, 3) AS delta, round(after, 3) AS after, rank, n_pids FROM r WHERE rank <= 8",
}
