"""Registered queries on leak tracks, groups and signals, each with SQL that holds what a track holds, sample by sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leak
from .base import DAY, H, S, host_of, rounded, rounded_as_sql, samples

RULE = leak.LeakRule("value", delta=5.0, ratio=1.2, monotone=0.4, duration=DAY, samples=4, window=8 * DAY, grid=DAY, cooldown=3 * DAY, reset_share=0.1)
CHUNK = 16 * DAY


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as processes of a machine; five of them share a program."""
    return samples(spark, sf_dir).select(host_of(), "pid", F.concat(F.lit("p"), F.floor(F.col("pid") / 5)).alias("name"), "ts", "value")


def leak_verdicts(spark, sf_dir):
    """Every user judged once a day over eight days, from its last deep fall on."""
    out = leak.leak_verdicts(_users(spark, sf_dir), RULE, chunk=CHUNK)
    return rounded_as_sql(out.select("source", "pid", "ts", "delta", "ratio", "monotone", "seconds", "last", "reason").withColumn("ts", F.floor("ts")), "delta", "ratio", "monotone", "seconds", "last", places=7)


def group_growth(spark, sf_dir):
    """How much the users of a program have grown together, as each one's last value within the window left it."""
    out = leak.group_growth(leak.tracks(_users(spark, sf_dir), RULE, chunk=CHUNK, verdicts=False), RULE.window, CHUNK)
    return rounded(out.select("source", "name", F.floor("ts").alias("ts"), "growth", "members", "pid"), "growth", places=5)


def leak_signals(spark, sf_dir):
    """One signal a machine and day: the best leaking user that is above its program's usual level and has not spoken for three days."""
    s = _users(spark, sf_dir)
    usual = s.groupBy("source", "name").agg(F.round(F.avg("value") * 2, 6).alias("p99")).where("p99 > 45").withColumn("stat", F.lit("value"))
    out = leak.leak_signals(leak.leak_verdicts(s, RULE, chunk=CHUNK), RULE, usual)
    return rounded(out.select("source", "pid", F.floor("ts").alias("ts"), "score", "last", "severity", "severity_reason"), "score", "last", places=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (leak_verdicts, group_growth, leak_signals)}

W, LEAST = RULE.window, RULE.reset_share
#: ``held``: what each track holds at each of its samples, oldest first.
_HELD = f"""
h AS (
    SELECT {H} AS source, pid, 'p' || CAST(floor(pid / 5) AS BIGINT) AS name, ts, value AS v, row_number() OVER (PARTITION BY pid ORDER BY ts) AS n FROM s
), held AS (
    SELECT source, pid, name, ts, v, n, [struct_pack(t := ts, x := v)] AS own FROM h WHERE n = 1
    UNION ALL
    SELECT h.source, h.pid, h.name, h.ts, h.v, h.n,
           CASE WHEN h.ts - held.ts > {W} OR list_max(list_transform(held.own, lambda e: e.x)) > 0 AND h.v < {LEAST} * list_max(list_transform(held.own, lambda e: e.x))
                THEN [struct_pack(t := h.ts, x := h.v)]
                ELSE list_append(list_filter(held.own, lambda e: e.t >= h.ts - {W}), struct_pack(t := h.ts, x := h.v)) END
    FROM held JOIN h ON h.pid = held.pid AND h.n = held.n + 1
)"""


def _judged(ratio: str) -> str:
    """CTEs with each track's verdict, ``ratio`` being the SQL of the last to the first quarter."""
    return f"""{_HELD}, first AS (
    SELECT source, pid, name, ts, v, list_transform(own, lambda e: e.x) AS x, ts - own[1].t AS seconds, greatest(1, len(own) // 4) AS q, len(own) AS n
    FROM held QUALIFY row_number() OVER (PARTITION BY pid, floor(ts / {RULE.grid}) ORDER BY ts) = 1
), sides AS (
    SELECT *, list_median(x[: q]) AS a, list_median(x[n - q + 1 :]) AS b, CASE WHEN n > 1 THEN len(list_filter(range(1, n), lambda k: x[k + 1] >= x[k])) / (n - 1) ELSE 0.0 END AS monotone FROM first
), judged AS (
    SELECT *, b - a AS delta, {ratio} AS ratio,
           CASE WHEN n < {RULE.samples} THEN 'samples' WHEN seconds < {RULE.duration} THEN 'duration' WHEN b - a < {RULE.delta} THEN 'delta' WHEN {ratio} < {RULE.ratio} THEN 'ratio' WHEN monotone < {RULE.monotone} THEN 'monotone' ELSE '' END AS reason
    FROM sides
)"""


#: As ``judge`` has it: from nothing to nothing nothing has grown, from nothing to something without bound.
_RATIO = "CASE WHEN a > 0 THEN b / a WHEN b > 0 THEN CAST('inf' AS DOUBLE) ELSE 1.0 END"

ORACLE_SQL: dict[str, str] = {
    "leak_verdicts": f"""
WITH RECURSIVE {S}, {_judged(_RATIO)}
SELECT source, pid, CAST(floor(ts) AS BIGINT) AS ts, round(delta, 7) AS delta, round(ratio, 7) AS ratio, round(monotone, 7) AS monotone, round(seconds, 7) AS seconds, round(v, 7) AS last, reason FROM judged
""",
    "group_growth": f"""
WITH RECURSIVE {S}, {_HELD}, g AS (
    SELECT source, pid, name, ts, greatest(0, v - own[1].x) AS g FROM held
), others AS (
    SELECT a.source, a.name, a.ts, a.pid AS who, a.g AS mine, b.pid, arg_max(b.g, b.ts) AS g
    FROM g a JOIN g b ON b.source = a.source AND b.name = a.name AND b.ts BETWEEN a.ts - {W} AND a.ts GROUP BY ALL
)
SELECT source, name, CAST(floor(ts) AS BIGINT) AS ts, round(sum(g), 5) AS growth, count(*) AS members, who AS pid FROM others GROUP BY source, name, others.ts, who, mine HAVING count(*) >= 2
""",
    "leak_signals": f"""
WITH RECURSIVE {S}, {_judged("b / a")}, usual AS (
    SELECT source, name, round(avg(v) * 2, 6) AS p99 FROM h GROUP BY 1, 2 HAVING round(avg(v) * 2, 6) > 45
), c AS (
    SELECT source, pid, ts, least(1.0, ratio / {2 * RULE.ratio}) AS score, v, monotone, p99, CAST(floor(ts / {RULE.grid}) AS BIGINT) AS step
    FROM judged LEFT JOIN usual USING (source, name) WHERE reason = '' AND (p99 IS NULL OR v > p99)
), o AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY step, score DESC, 'p' || CAST(floor(pid / 5) AS BIGINT), pid) AS n FROM c
), f AS (
    SELECT source, n, true AS fires, step AS done, map([pid], [ts]) AS spoke FROM o WHERE n = 1
    UNION ALL
    SELECT o.source, o.n, o.step <> f.done AND coalesce(o.ts - f.spoke[o.pid] >= {RULE.cooldown}, true),
           CASE WHEN o.step <> f.done AND coalesce(o.ts - f.spoke[o.pid] >= {RULE.cooldown}, true) THEN o.step ELSE f.done END,
           CASE WHEN o.step <> f.done AND coalesce(o.ts - f.spoke[o.pid] >= {RULE.cooldown}, true) THEN map_concat(f.spoke, map([o.pid], [o.ts])) ELSE f.spoke END
    FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1
), r AS (
    SELECT o.*, CASE WHEN v >= 2 * p99 THEN 2 WHEN v >= p99 THEN 1 ELSE 0 END AS rank FROM f JOIN o USING (source, n) WHERE fires
)
SELECT source, pid, CAST(floor(ts) AS BIGINT) AS ts, round(score, 7) AS score, round(v, 7) AS last,
       CASE WHEN p99 IS NULL THEN 'warning' ELSE ['info', 'warning', 'critical'][CASE WHEN monotone < 0.95 THEN greatest(rank - 1, 0) ELSE rank END + 1] END AS severity,
       CASE WHEN p99 IS NULL THEN 'unknown_leak' ELSE 'leak' END AS severity_reason
FROM r
""",
}
