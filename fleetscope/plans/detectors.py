"""Registered queries on the assembled rule detector and on carried baselines, each with its SQL.

Hours take the place of seconds: a machine's events are its ticks, small values are suspect, and the value is the load.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..operators.baseline import Baseline
from ..operators.rules import Condition, Rule
from .base import DAY, HOUR, H, S, carried_sql, host_of, rounded, samples, settled_sql

RULES = (
    Rule("high", (Condition("cpu_total", ">", "cpu_total_median + 2 * cpu_total_sigma"), Condition("cpu_total", ">", "30")), 0, 12 * HOUR, "warning"),
    Rule("kept", (Condition("cpu_total", ">=", "cpu_total_median"),), 2 * HOUR, DAY, "info", explain="kept by {kind}"),
    Rule("either", (Condition("mem_percent", ">", "70"), Condition("cpu_total", ">", "90")), 0, 2 * DAY, "critical", "any"),
    Rule("named", (Condition("kind", "contains", "IGN"), Condition("cpu_total", ">", "5")), 0, 6 * HOUR, "warning"),
    Rule("loaded", (Condition("mem_percent", ">", "mem_percent_load_median + 5"),), 0, DAY, "info"),
)
SETUP = detect.Setup(usual=Baseline(3 * DAY, 20), load=Baseline(6 * DAY, 5), load_spacing=6 * HOUR, gates={"mem_percent": detect.LoadGate("load", 25.0)}, chunk=2 * DAY)
BY_PROGRAM = detect.Setup(usual=Baseline(3 * DAY, 20), program=Baseline(5 * DAY, 6), program_spacing=2 * HOUR, load=SETUP.load, load_spacing=SETUP.load_spacing, gates=SETUP.gates, chunk=2 * DAY)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return samples(spark, sf_dir).select(
        host_of(), "ts", F.when(~value.between(1.0, 1.2), value).alias("cpu_total"), (value * 0.5 + F.col("pid") % 25).alias("mem_percent"), value.alias("load"),
        F.col("source").alias("kind"), F.when(F.col("source") != "view", F.upper("source")).alias("foreground_program"), (value < 0.5).alias("suspect"),
    )


def _shown(signals: DataFrame) -> DataFrame:
    """Signals with the evidence of both metrics as columns."""
    of = lambda m, p: F.element_at("evidence", m)[p]
    out = signals.select("source", "ts", "rule", "severity", F.concat_ws(",", "fired").alias("fired"), F.col("sustained_s").alias("held"), "score", "explanation", of("cpu_total", "median").alias("cpu_median"), of("cpu_total", "z").alias("cpu_z"), of("mem_percent", "sigma").alias("mem_sigma"))
    numbers = ("score", "cpu_median", "cpu_z", "mem_sigma")
    # Eleven places first: a product's last bits decide no half.
    return rounded(rounded(rounded(out, "ts", "held"), *numbers, places=11), *numbers, places=5)


def rule_detector(spark, sf_dir):
    """Five rules from raw ticks: usual and load axes, holds, cooldowns, suspect ticks, unknown values, scores and evidence."""
    return _shown(detect.rule_detector(_ticks(spark, sf_dir).withColumn("foreground_program", F.lit(None).cast("string")), RULES, SETUP))


def rule_detector_programs(spark, sf_dir):
    """The same with the program axis: a known program's own baseline decides relative conditions, and nothing does until it is ready."""
    return _shown(detect.rule_detector(_ticks(spark, sf_dir), RULES, BY_PROGRAM))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (rule_detector, rule_detector_programs)}


def _detector_sql(programs: bool) -> str:
    own = "CASE WHEN p.program IS NULL THEN cm ELSE pc.md END", "CASE WHEN p.program IS NULL THEN cs ELSE pc.sg END"
    median, sigma = own if programs else ("cm", "cs")
    return f"""
WITH RECURSIVE {S}, t AS (
    SELECT {H} AS source, ts, CASE WHEN NOT value BETWEEN 1.0 AND 1.2 THEN value END AS c, value * 0.5 + pid % 25 AS m, value AS load, source AS kind,
           CASE WHEN source <> 'view' THEN upper(source) END AS program
    FROM s WHERE value >= 0.5
), gated AS (
    SELECT source, ts, m AS v FROM t WHERE load >= 25
), played AS (
    SELECT source, program, ts, c AS v FROM t WHERE program IS NOT NULL AND c IS NOT NULL
), {carried_sql("ld", "gated", "source", 6 * HOUR, 6 * DAY, 5)}, {carried_sql("pg", "played", "source, program", 2 * HOUR, 5 * DAY, 6)}, u AS (
    SELECT *, median(c) OVER w AS cm0, mad(c) OVER w AS ca, count(c) OVER w AS cn, median(m) OVER w AS mm0, mad(m) OVER w AS ma, count(m) OVER w AS mn
    FROM t WINDOW w AS (PARTITION BY source ORDER BY ts RANGE BETWEEN {3 * DAY} PRECEDING AND CURRENT ROW)
), r AS (
    SELECT *, CASE WHEN cn >= 20 THEN cm0 END AS cm, CASE WHEN cn >= 20 THEN nullif(greatest(ca * 1.4826, abs(cm0) * 0.05), 0) END AS cs,
           CASE WHEN mn >= 20 THEN mm0 END AS mm, CASE WHEN mn >= 20 THEN nullif(greatest(ma * 1.4826, abs(mm0) * 0.05), 0) END AS ms
    FROM u WHERE cn >= 20 OR mn >= 20
), a AS (
    SELECT p.*, {median} AS xm, {sigma} AS xs, ld.md AS lm
    FROM r p ASOF LEFT JOIN ld ON p.source = ld.source AND p.ts >= ld.ts ASOF LEFT JOIN pg pc ON p.source = pc.source AND p.program = pc.program AND p.ts >= pc.ts
), x AS (
    SELECT 0 AS k, source, ts, coalesce(c > xm + 2 * xs AND c > 30, false) AS ok, 0 AS hold, {12 * HOUR} AS cool FROM a
    UNION ALL SELECT 1, source, ts, coalesce(c >= xm, false), {2 * HOUR}, {DAY} FROM a
    UNION ALL SELECT 2, source, ts, coalesce(m > 70, false) OR coalesce(c > 90, false), 0, {2 * DAY} FROM a
    UNION ALL SELECT 3, source, ts, coalesce(contains(lower(kind), 'ign') AND c > 5, false), 0, {6 * HOUR} FROM a
    UNION ALL SELECT 4, source, ts, coalesce(m > lm + 5, false), 0, {DAY} FROM a
), h AS (
    SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY k, source ORDER BY ts) AS run FROM x
), e AS (
    SELECT * FROM (SELECT *, min(ts) OVER (PARTITION BY k, source, run) AS since FROM h WHERE ok) WHERE ts - since >= hold
), f AS (
    SELECT k, source, min(ts) AS ts FROM e GROUP BY 1, 2
    UNION ALL
    SELECT e.k, e.source, min(e.ts) FROM f JOIN e ON e.k = f.k AND e.source = f.source AND e.ts - f.ts >= e.cool GROUP BY 1, 2
), fired AS (
    SELECT f.source, f.ts, string_agg(['high', 'kept', 'either', 'named', 'loaded'][f.k + 1], ',' ORDER BY f.k) AS fired,
           arg_max(f.k, 10 * [1, 0, 2, 1, 0][f.k + 1] - f.k) AS k
    FROM f GROUP BY 1, 2
)
SELECT a.source, round(a.ts, 3) AS ts, ['high', 'kept', 'either', 'named', 'loaded'][fired.k + 1] AS rule, ['warning', 'info', 'critical', 'warning', 'info'][fired.k + 1] AS severity,
       fired.fired, round(round(a.ts - e.since, 1), 3) AS held,
       {settled_sql('coalesce(nullif(least(1.0, CASE fired.k WHEN 4 THEN abs((m - mm) / ms) WHEN 2 THEN greatest(abs((m - mm) / ms), abs((c - cm) / cs)) ELSE abs((c - cm) / cs) END / 8), 0), 0.5)', 5)} AS score,
       CASE fired.k WHEN 1 THEN 'kept by ' || kind ELSE '' END AS explanation,
       CASE WHEN fired.k <> 4 THEN {settled_sql('cm', 5)} END AS cpu_median, CASE WHEN fired.k <> 4 THEN {settled_sql('(c - cm) / cs', 5)} END AS cpu_z, CASE WHEN fired.k IN (2, 4) THEN {settled_sql('ms', 5)} END AS mem_sigma
FROM fired JOIN a USING (source, ts) JOIN e ON e.k = fired.k AND e.source = a.source AND e.ts = a.ts
"""


ORACLE_SQL: dict[str, str] = {"rule_detector": _detector_sql(False), "rule_detector_programs": _detector_sql(True)}
