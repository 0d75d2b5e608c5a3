"""Registered queries on column functions, lifecycle, history, texts and scoring, each with its SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import derive, evaluate, explain, history, leak, rules, usage
from ..session import checkpoint_root
from ..sources import ranges
from .base import DAY, HOUR, START, H, S, as_long, host_of, islands_sql, rounded, samples
from .incidents import _ALARMS, episodes, signals

SLOTS = {"night": (22, 6), "work": (9, 18)}


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(host_of(), "id", "ts", "pid", F.col("source").alias("kind"), "value")


def column_functions(spark, sf_dir):
    """Names, groups, local days, slots, categories, per-core arrays, JSON, throttle masks, strict arithmetic and machine variables of every event."""
    h = _hosts(spark, sf_dir)
    name = F.when(F.col("kind") == "click", "SvcHost.EXE").when(F.col("kind") == "view", "Chrome.exe").otherwise(F.col("kind"))
    profile = h.select("source").distinct().where("source <> 'h0'").select("source", F.length("source").cast("double").alias("cores"), F.lit(2.0).alias("physical_cores"), F.lit(8192.0).alias("ram_mb"), F.lit(None).cast("double").alias("swap_total_mb"))
    categories = spark.createDataFrame([("CHROME", "web"), ("purchase.exe", "shop"), ("nothing", "x")], "name string, category string")
    h = C.categorize(C.with_host_profile(h.withColumn("name", name), profile), categories)
    mean, top = C.core_summary(C.json_array(F.concat(F.lit("["), F.col("pid"), F.lit(", "), F.col("id") % 7, F.lit(", 4]"))))
    told = C.features(F.when(F.col("kind") != "error", F.concat(F.lit('{"metric": "'), F.col("kind"), F.lit('", "pid": '), F.col("pid"), F.lit(', "rules": ["a", "b"]}'))).otherwise("{broken"))
    views = F.array(F.struct(F.lit(9).alias("pid"), F.lit("Late.exe").alias("name"), F.lit(True).alias("foreground")), F.struct((F.col("pid") % 13).alias("pid"), F.col("name"), (F.col("value") > 20).alias("foreground")))
    start, end = C.day_bounds(C.day_of(F.col("ts"), "Asia/Seoul"), "Asia/Seoul")
    big, odd = F.when(F.col("kind") != "view", F.col("value") > 50), F.col("pid") % 2 == 1
    value = F.when(F.col("kind") != "signup", F.col("value"))
    return h.select(
        "id", C.normal_name(F.col("name")).alias("normal"), C.group_key(F.col("name"), F.col("pid")).alias("grouped"), C.day_of(F.col("ts"), "Asia/Seoul").cast("string").alias("day"), start.cast("long").alias("day_start"), (end - start).cast("long").alias("day_seconds"),
        C.slot_of(F.hour(F.timestamp_seconds("ts")), SLOTS).alias("slot"), "category", F.round(mean, 6).alias("core_mean"), top.alias("core_top"), F.concat_ws(",", C.throttle_reasons(F.col("id") % 512)).alias("reasons"), told["metric"].alias("metric"), told["pid"].alias("told_pid"), F.size(told["rules"]).cast("long").alias("n_rules"),
        C.foreground_program(views).alias("foreground"), C.strict_and(big, odd).alias("both"), C.strict_or(big, odd).alias("either"), C.strict_min(value, F.col("pid").cast("double")).alias("low"), C.strict_max(value, F.col("pid").cast("double")).alias("high"),
        "cores", "ram_mb", C.duration_text(F.col("value") * 37).alias("lasted"), C.severity_name(C.worse(C.band(F.col("value"), 50, 100), C.band(F.col("pid").cast("double"), 10, 1000))).alias("worse"),
    )


def visible_connections(spark, sf_dir):
    """The first three shown connections of each machine's hours."""
    h = _hosts(spark, sf_dir)
    c = h.select("source", F.floor(F.col("ts") / HOUR).cast("long").alias("ts"), "pid", (F.col("id") % 9).alias("lport"), F.when(F.col("value") > 30, F.col("kind")).alias("raddr"), F.col("id").alias("rport"), F.when(F.col("kind") == "error", "NONE").when(F.col("value") < 10, "LISTEN").otherwise("ESTABLISHED").alias("status"))
    return C.visible_connections(c, 3)


def active_set(spark, sf_dir):
    """Rows that lead their machine's hour by load, memory or growth or are in the foreground, and all rows of each day's first hour."""
    h = _hosts(spark, sf_dir)
    p = h.groupBy("source", F.floor(F.col("ts") / HOUR).cast("double").alias("ts"), "pid").agg(F.round(F.max("value"), 6).alias("cpu_percent"), F.sum(F.col("id") % 101).alias("rss_mb"), F.count("*").alias("handles"), F.max(F.col("value") > 250).alias("foreground"))
    return derive.active_set(p, 1, 1, 1, 24.0).select("source", F.col("ts").cast("long").alias("hour"), "pid", F.col("tier").cast("long").alias("tier"))


def unclean_shutdowns(spark, sf_dir):
    """Users' sessions that were never ended: the last trace before the next start, and whether a boot lies between."""
    s = samples(spark, sf_dir)
    events = s.where("source in ('signup', 'purchase')").select(F.col("pid").alias("source"), "ts", F.when(F.col("source") == "signup", "startup").otherwise("shutdown").alias("event"))
    traces = s.where("source in ('click', 'view')").select(F.col("pid").alias("source"), "ts")
    boots = s.where("source = 'error' and value > 20").select(F.col("pid").alias("source"), F.col("ts").alias("boot_time"))
    return rounded(derive.unclean_shutdowns(events, traces, boots).select("source", "startup", "ts", "cause"), "startup", "ts", places=6)


def suspect_ticks(spark, sf_dir):
    """Machines' ticks close behind a gap or long after the one before."""
    h = _hosts(spark, sf_dir)
    marks = h.where("kind = 'error' and value > 90").select("source", "ts", F.when(F.col("pid") % 3 == 0, "startup").when(F.col("pid") % 3 == 1, "time_gap").otherwise("other").alias("event"))
    return derive.with_suspect(h.select("source", "ts", "id"), marks, 2 * HOUR, HOUR, 3 * HOUR).select("id", "suspect")


def daily_report(spark, sf_dir):
    """Foreground seconds of each machine's day, by category, slot and program, for days that are covered enough."""
    h = _hosts(spark, sf_dir)
    day = F.floor((F.col("ts") - START) / DAY).cast("long").alias("day")
    foreground = h.select("source", day, F.floor("ts").cast("double").alias("ts"), F.col("kind").alias("name"), F.when(F.col("kind").isin("click", "view"), "look").otherwise("act").alias("category"))
    report = usage.daily_report(foreground, SLOTS, 1800.0, 2)
    observed = foreground.select("source", "day").distinct().select("*", F.lit(20 * HOUR).alias("observed_seconds"))
    out = report.join(usage.coverage(foreground, observed, 1800.0, 0.25), ["source", "day"])
    top = F.array_join(F.transform("top_apps", lambda x: x["name"]), ",")
    return rounded(out.select("source", "day", "seconds", F.col("by_category")["look"].alias("look"), F.col("by_slot")["work"].alias("work"), top.alias("top"), "share"), "seconds", "look", "work", "share", places=5)


def history_overview(spark, sf_dir):
    """Coverage, busy buckets, span and readiness of each machine's hours, as one table of checks."""
    h = _hosts(spark, sf_dir)
    rolled = h.groupBy("source", (F.floor(F.col("ts") / HOUR) * HOUR).alias("bucket")).agg(F.max("value").alias("peak"), F.max(F.when(F.col("kind") == "nothing", 1)).alias("never")).withColumn("day", F.floor(F.col("bucket") / DAY).cast("long"))
    days, busy = history.day_coverage(rolled, HOUR), history.busy_minutes(rolled, "peak", 30.0).withColumn("busy", F.col("busy") * 30)
    index = h.groupBy("source", F.col("kind").alias("name"), F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(F.countDistinct(F.floor(F.col("ts") / HOUR)).alias("buckets"))
    ready = history.readiness(days, busy, index, h.where("kind = 'error' and value > 60").select("source")).select("source", "check", "required", "actual", "ok")
    span = history.span_of(rolled, ("peak", "never"))
    spans = span.select("source", F.lit("span").alias("check"), F.col("rows").alias("required"), (F.col("last") - F.col("first")).cast("long").alias("actual"), (F.col("has_peak") & ~F.col("has_never")).alias("ok"))
    return ready.unionByName(spans)


def detector_claims(spark, sf_dir):
    """The best claim of each incident (a machine's day) and its rules in order."""
    h = _hosts(spark, sf_dir).where("value > 60")
    said = h.select("source", "ts", F.col("kind").alias("detector"), F.round(F.col("value") / 100, 1).alias("score"), F.when(F.col("pid") % 3 == 0, "handles").when(F.col("pid") % 3 == 1, "rss_mb").otherwise("other").alias("metric"), F.concat(F.lit("p"), F.col("pid")).alias("process"), F.col("kind").alias("explanation"), F.col("value").alias("duration_s"), F.array(F.col("kind"), F.lit("all")).alias("rules"))
    linked = h.select("source", F.floor((F.col("ts") - START) / DAY).cast("long").alias("incident_id"), "ts", F.col("kind").alias("detector"))
    out = explain.detector_claim(linked, said)
    return rounded(out.select("source", "incident_id", "claim.process", "claim.metric", F.col("claim.at").alias("at"), F.concat_ws(",", "triggers").alias("triggers")), "at", places=6)


def incident_texts(spark, sf_dir):
    """Title and report of each large error, as a claim, a named program, evidence or nothing gives them."""
    h = _hosts(spark, sf_dir).where("kind = 'error' and value > 50")
    one = F.struct(F.concat(F.lit("p"), F.col("pid")).alias("name"), (F.floor(F.col("value")) % 90 / 100).alias("share"), F.when(F.col("pid") % 2 == 0, F.col("value")).alias("lead_s"), (F.col("pid") % 5 == 0).alias("is_new"))
    own = h.select("id", F.lit(0.0).alias("start"), F.col("value").alias("end"), F.when(F.col("pid") % 4 != 3, F.array(one)).alias("contributors"), F.when(F.col("value") > 80, F.array(F.lit("load"), F.lit("heat"))).otherwise(F.array().cast("array<string>")).alias("evidence"), F.array(F.lit("r1")).alias("triggers"), F.when(F.col("pid") % 7 == 0, "CPU").alias("overridden_from"), "pid", "value")
    title = C.incident_title(F.col("value") > 100, F.lit("claimed"), F.lit("label"), F.col("pid") % 3 != 0, F.col("contributors"), F.col("evidence"))
    return C.incident_report(own.withColumn("title", F.when(F.col("pid") % 11 != 0, title))).select("id", "title", "report")


def fault_hits(spark, sf_dir):
    """Labelled faults with the process trees below them: the first of the machine's three busiest users that is a right answer."""
    h = _hosts(spark, sf_dir)
    faults = h.where("kind = 'error' and value > 60").select("source", "id", F.when(F.col("pid") % 5 == 0, "manual").otherwise("cpu_spin").alias("scenario"), (F.floor(F.col("pid") / 2)).cast("long").alias("pid"), F.col("ts").alias("ts_start"), (F.col("ts") + 5 * HOUR).alias("ts_end"), (F.col("pid") % 7 != 0).alias("completed"))
    starts = h.where("kind in ('click', 'signup')").select("source", "ts", "pid", F.floor(F.col("pid") / 2).cast("long").alias("ppid"))
    answers = evaluate.fault_answers(faults, starts, h.where("kind = 'view'"), 2 * DAY)
    busy = h.groupBy("source", "pid").agg(F.round(F.sum("value"), 4).alias("v"))
    from pyspark.sql import Window

    ranked = busy.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("v"), "pid"))).where("rank <= 12").select("source", "rank", F.array("pid").alias("pids"))
    due = answers.where("skipped is null").select("source", "id", "answer_pids")
    hits = evaluate.attribution_hits(due.select("source", "id").join(ranked, "source"), due)
    return as_long(answers.join(hits, ["source", "id"], "left").select("source", "id", F.size("answer_pids").alias("answers"), "skipped", "hit_rank"), "answers", "hit_rank").withColumn("answers", F.when(F.col("answers") >= 0, F.col("answers")))


def scoreboard(spark, sf_dir):
    """Detectors by their scores over all machines, as a row of the history of runs."""
    from ..operators.evaluate import alarms, scores

    out = evaluate.scoreboard(scores(alarms(signals(spark, sf_dir), HOUR), episodes(spark, sf_dir)), (START, START + 30 * DAY), START + 31 * DAY, "run")
    return rounded(out, "precision", "recall", "f1", "latency", places=6)


def comparison_detectors(spark, sf_dir):
    """What a fixed limit, held for two hours, says on machines' ticks, beside gates by memory and grades of lost clock speed."""
    h = _hosts(spark, sf_dir)
    fixed = rules.fixed_threshold(h.select("source", "ts", "value"), "value", 40.0, 2 * HOUR).select("source", F.floor("ts").alias("ts"), "detector", F.round("score", 5).alias("score"))
    gated = h.select("source", F.floor("ts").alias("ts"), F.lit("gates").alias("detector"), F.round(leak.ram_gate(100.0, F.when(F.col("kind") != "view", F.col("value") * 500)), 5).alias("score"))
    risk, impact = C.band(F.col("value"), 50, 100), leak.clock_loss(F.when(F.col("kind") != "view", F.col("value")), F.lit(60.0))
    rank, axis = leak.combined(risk, impact)
    graded = h.select("source", F.floor("ts").alias("ts"), F.concat(F.lit("grade_"), axis).alias("detector"), rank.cast("double").alias("score"))
    return fixed.unionByName(gated).unionByName(graded)


def committed_rollup(spark, sf_dir):
    """Hours folded into a committed table in two runs, of which one is killed before its commit and run again, and a day refolded from fewer rows."""
    raw, root = _hosts(spark, sf_dir), f"{checkpoint_root(spark)}/committed-{uuid.uuid4().hex}"
    fold = lambda rows: rows.groupBy("source", (F.floor(F.col("ts") / HOUR) * HOUR).alias("bucket")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))

    def kill() -> None:
        raise InterruptedError

    ranges.fold_pending(raw, root, fold, HOUR, START + 10 * DAY + 100)
    with contextlib.suppress(InterruptedError):
        ranges.fold_pending(raw.where("value > 1"), root, fold, HOUR, START + 31 * DAY, committing=kill)
    ranges.fold_pending(raw, root, fold, HOUR, START + 31 * DAY)
    ranges.refold(raw.where("value > 20"), root, fold, START + 9 * DAY, START + 11 * DAY)
    return as_long(ranges.read(spark, root, "source string, bucket double, n long, peak double"), "bucket")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (column_functions, visible_connections, active_set, unclean_shutdowns, suspect_ticks, daily_report, history_overview, detector_claims, incident_texts, fault_hits, scoreboard, comparison_detectors, committed_rollup)}

T = f"h AS (SELECT {H} AS source, id, ts, pid, source AS kind, value FROM s)"
_BITS = C.THROTTLE_BITS.items()
_HOUR = "CAST(floor(ts / 3600) AS BIGINT) % 24"

ORACLE_SQL: dict[str, str] = {
    "column_functions": f"""
WITH {S}, {T}, n AS (
    SELECT *, CASE kind WHEN 'click' THEN 'SvcHost.EXE' WHEN 'view' THEN 'Chrome.exe' ELSE kind END AS name, CAST(floor((ts + 32400) / 86400) AS BIGINT) AS local_day, {_HOUR} AS hour, CAST(round(value * 37) AS BIGINT) AS s,
           CASE WHEN kind <> 'view' THEN value > 50 END AS big, pid % 2 = 1 AS odd, CASE WHEN kind <> 'signup' THEN value END AS v
    FROM h
)
SELECT id, regexp_replace(lower(name), '\\.exe$', '') AS normal, CASE kind WHEN 'click' THEN 'SvcHost.EXE#' || pid ELSE name END AS grouped,
       strftime(DATE '1970-01-01' + CAST(local_day AS INTEGER), '%Y-%m-%d') AS day, local_day * 86400 - 32400 AS day_start, 86400 AS day_seconds,
       CASE WHEN hour >= 22 OR hour < 6 THEN 'night' WHEN hour >= 9 AND hour < 18 THEN 'work' END AS slot,
       CASE kind WHEN 'view' THEN 'web' WHEN 'purchase' THEN 'shop' ELSE 'other' END AS category,
       round((pid + id % 7 + 4) / 3, 6) AS core_mean, CAST(greatest(pid, id % 7, 4) AS DOUBLE) AS core_top,
       concat_ws(',', {", ".join(f"CASE WHEN (id % 512) & {bit} > 0 THEN '{name}' END" for bit, name in _BITS)}) AS reasons,
       CASE WHEN kind <> 'error' THEN kind END AS metric, CASE WHEN kind <> 'error' THEN pid END AS told_pid, CASE WHEN kind <> 'error' THEN 2 END AS n_rules,
       CASE WHEN value > 20 AND (pid % 13 < 9 OR pid % 13 = 9 AND name < 'Late.exe') THEN lower(name) ELSE 'late.exe' END AS foreground,
       CASE WHEN big IS NULL THEN NULL ELSE big AND odd END AS both, CASE WHEN big IS NULL THEN NULL ELSE big OR odd END AS either,
       CASE WHEN v IS NOT NULL THEN least(v, pid) END AS low, CASE WHEN v IS NOT NULL THEN greatest(v, pid) END AS high,
       CASE WHEN source <> 'h0' THEN CAST(length(source) AS DOUBLE) END AS cores, CASE WHEN source <> 'h0' THEN 8192.0 END AS ram_mb,
       CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' END AS lasted,
       ['info', 'warning', 'critical'][greatest(CASE WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END, CASE WHEN pid >= 1000 THEN 2 WHEN pid >= 10 THEN 1 ELSE 0 END) + 1] AS worse
FROM n
""",
    "visible_connections": f"""
WITH {S}, {T}, c AS (
    SELECT source, CAST(floor(ts / 3600) AS BIGINT) AS ts, pid, id % 9 AS lport, CASE WHEN value > 30 THEN kind END AS raddr, id AS rport, CASE WHEN kind = 'error' THEN 'NONE' WHEN value < 10 THEN 'LISTEN' ELSE 'ESTABLISHED' END AS status FROM h
)
SELECT * FROM c WHERE status <> 'NONE' AND (raddr IS NOT NULL OR status = 'LISTEN') QUALIFY row_number() OVER (PARTITION BY source, ts ORDER BY pid, lport, raddr NULLS FIRST, rport) <= 3
""",
    "active_set": f"""
WITH {S}, {T}, p AS (
    SELECT source, floor(ts / 3600) AS ts, pid, round(max(value), 6) AS c, sum(id % 101) AS r, count(*) AS handles, bool_or(value > 250) AS fg FROM h GROUP BY 1, 2, 3
), g AS (
    SELECT *, handles - lag(handles) OVER (PARTITION BY source, pid ORDER BY ts) AS grown, ts = min(ts) OVER (PARTITION BY source, floor(ts / 24)) AS first FROM p
), k AS (
    SELECT *, row_number() OVER (PARTITION BY source, ts ORDER BY c DESC, pid) AS nc, row_number() OVER (PARTITION BY source, ts ORDER BY r DESC, pid) AS nr, row_number() OVER (PARTITION BY source, ts ORDER BY grown DESC NULLS LAST, pid) AS ng FROM g
), t AS (
    SELECT *, CASE WHEN nc <= 1 OR nr <= 1 OR ng <= 1 AND coalesce(grown > 0, false) OR fg THEN 1 WHEN first THEN 2 END AS tier FROM k
)
SELECT source, CAST(ts AS BIGINT) AS hour, pid, tier FROM t WHERE tier IS NOT NULL
""",
    "unclean_shutdowns": f"""
WITH {S}, e AS (
    SELECT pid, ts, source AS kind, lead(source) OVER o AS next_kind, lead(ts) OVER o AS next_ts FROM s WHERE source IN ('signup', 'purchase') WINDOW o AS (PARTITION BY pid ORDER BY ts)
), open AS (
    SELECT pid, ts AS startup, coalesce(next_ts, 1e18) AS until FROM e WHERE kind = 'signup' AND (next_kind = 'signup' OR next_kind IS NULL)
), last AS (
    SELECT open.pid, startup, until, max(t.ts) AS ts FROM open JOIN s t ON t.pid = open.pid AND t.source IN ('click', 'view') AND t.ts >= startup AND t.ts < until GROUP BY ALL
)
SELECT pid AS source, round(startup, 6) AS startup, round(last.ts, 6) AS ts,
       CASE WHEN EXISTS (SELECT 1 FROM s b WHERE b.pid = last.pid AND b.source = 'error' AND b.value > 20 AND b.ts > last.ts - 5 AND b.ts <= until + 5) THEN 'reboot' ELSE 'crash' END AS cause
FROM last
""",
    "suspect_ticks": f"""
WITH {S}, {T}, m AS (
    SELECT source, ts - 3600 AS lo, ts + 7200 AS hi FROM h WHERE kind = 'error' AND value > 90 AND pid % 3 < 2
), t AS (
    SELECT *, ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) > {3 * HOUR} AS late FROM h
)
SELECT id, coalesce(late, false) OR EXISTS (SELECT 1 FROM m WHERE m.source = t.source AND t.ts BETWEEN lo AND hi) AS suspect FROM t
""",
    "daily_report": f"""
WITH {S}, {T}, f AS (
    SELECT source, CAST(floor((ts - {START}) / 86400) AS BIGINT) AS day, floor(ts) AS ts, kind AS name, CASE WHEN kind IN ('click', 'view') THEN 'look' ELSE 'act' END AS category, {_HOUR} AS hour FROM h
), g AS (
    SELECT *, least(coalesce(lead(ts) OVER o - ts, ts - lag(ts) OVER o), 1800) AS sec, least(lead(ts) OVER o - ts, 1800) AS gap FROM f WINDOW o AS (PARTITION BY source, day ORDER BY ts, name)
), p AS (
    SELECT source, day, name, round(sum(sec), 3) AS s FROM g WHERE sec IS NOT NULL GROUP BY ALL
), top AS (
    SELECT source, day, string_agg(name, ',' ORDER BY s DESC, name) AS top FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source, day ORDER BY s DESC, name) <= 2) GROUP BY ALL
), d AS (
    SELECT source, day, sum(sec) AS seconds, sum(CASE WHEN category = 'look' THEN sec END) AS look, sum(CASE WHEN hour >= 9 AND hour < 18 THEN sec END) AS work, sum(gap) / {20 * HOUR} AS share FROM g WHERE sec IS NOT NULL GROUP BY ALL
)
SELECT source, day, round(seconds, 5) AS seconds, round(look, 5) AS look, round(work, 5) AS work, top, round(share, 5) AS share FROM d JOIN top USING (source, day) WHERE share >= 0.25
""",
    "history_overview": f"""
WITH {S}, {T}, r AS (
    SELECT source, floor(ts / 3600) * 3600 AS bucket, max(value) AS peak, CAST(floor(ts / 86400) AS BIGINT) AS day FROM h GROUP BY ALL
), days AS (
    SELECT source, day, count(DISTINCT bucket) AS hours, count(*) FILTER (WHERE peak >= 30) * 30 AS busy FROM r GROUP BY ALL
), idx AS (
    SELECT source, kind, count(*) AS d, sum(b) AS b FROM (SELECT source, kind, floor(ts / 86400) AS day, count(DISTINCT floor(ts / 3600)) AS b FROM h GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 3 AND sum(b) >= 100
), u AS (
    SELECT source, 'full_days' AS "check", 7 AS required, count(*) AS actual FROM days WHERE hours >= 6 GROUP BY ALL
    UNION ALL SELECT source, 'busy_days', 3, count(*) FROM days WHERE hours >= 6 AND busy >= 30 GROUP BY ALL
    UNION ALL SELECT source, 'programs', 1, count(*) FROM idx GROUP BY ALL
    UNION ALL SELECT source, 'labels', 7, count(*) FROM h WHERE kind = 'error' AND value > 60 GROUP BY ALL
)
SELECT *, actual >= required AS ok FROM u UNION ALL SELECT source, 'span', count(*), CAST(max(bucket) - min(bucket) AS BIGINT), true FROM r GROUP BY source
""",
    "detector_claims": f"""
WITH {S}, {T}, g AS (
    SELECT *, CAST(floor((ts - {START}) / 86400) AS BIGINT) AS incident_id, round(value / 100, 1) AS score FROM h WHERE value > 60
), best AS (
    SELECT * FROM g WHERE pid % 3 < 2 QUALIFY row_number() OVER (PARTITION BY source, incident_id ORDER BY score DESC, ts) = 1
), names AS (
    SELECT source, incident_id, rule, min(w) AS w FROM (SELECT source, incident_id, kind AS rule, ts * 2 AS w FROM g UNION ALL SELECT source, incident_id, 'all', ts * 2 + 1e-6 FROM g) GROUP BY ALL
), lists AS (
    SELECT source, incident_id, string_agg(rule, ',' ORDER BY w) AS triggers FROM names GROUP BY ALL
)
SELECT source, incident_id, CASE WHEN best.pid IS NOT NULL THEN 'p' || best.pid END AS process, CASE best.pid % 3 WHEN 0 THEN 'handles' WHEN 1 THEN 'rss_mb' END AS metric, round(best.ts, 6) AS "at", triggers FROM lists LEFT JOIN best USING (source, incident_id)
""",
    "incident_texts": f"""
WITH {S}, {T}, i AS (
    SELECT *, pid % 4 <> 3 AS known, CAST(floor(value) AS BIGINT) % 90 AS share, CAST(round(value) AS BIGINT) AS lasted FROM h WHERE kind = 'error' AND value > 50
), t AS (
    SELECT *, CASE WHEN pid % 11 = 0 THEN NULL WHEN value > 100 THEN 'claimed' WHEN pid % 3 <> 0 AND known THEN 'label — p' || pid || ' ' || share || '%' ELSE concat_ws(' — ', 'label', CASE WHEN value > 80 THEN 'load' END) END AS title FROM i
)
SELECT id, title, CASE WHEN title IS NOT NULL THEN concat_ws(chr(10), title, CASE WHEN lasted < 60 THEN lasted || 's' ELSE (lasted // 60) || 'm ' || lpad(CAST(lasted % 60 AS VARCHAR), 2, '0') || 's' END, CASE WHEN value > 80 THEN 'load; heat' END,
       'rules: r1', CASE WHEN pid % 7 = 0 THEN 'instead of CPU' END, CASE WHEN known THEN '- p' || pid || ' ' || share || '%' || CASE WHEN pid % 5 = 0 THEN ' (new)' WHEN pid % 2 = 0 THEN ' (' || CAST(floor(value) AS BIGINT) || 's before)' ELSE '' END END) END AS report
FROM t
""",
    "fault_hits": f"""
WITH RECURSIVE {S}, {T}, f AS (
    SELECT source, id, CAST(floor(pid / 2) AS BIGINT) AS root, ts AS lo, ts + {5 * HOUR} AS hi, CASE WHEN pid % 5 = 0 THEN 'no_load' WHEN pid % 7 = 0 THEN 'no_symptom' END AS why FROM h WHERE kind = 'error' AND value > 60
), e AS (
    SELECT DISTINCT f.id, h.pid, CAST(floor(h.pid / 2) AS BIGINT) AS ppid FROM f JOIN h ON h.source = f.source AND h.kind IN ('click', 'signup') AND h.ts BETWEEN f.lo - {2 * DAY} AND f.hi WHERE h.pid <> floor(h.pid / 2)
), r AS (
    SELECT id, root AS pid FROM f UNION SELECT r.id, e.pid FROM r JOIN e ON e.id = r.id AND e.ppid = r.pid
), ranked AS (
    SELECT source, pid, row_number() OVER (PARTITION BY source ORDER BY round(sum(value), 4) DESC, pid) AS rank FROM h GROUP BY source, pid QUALIFY rank <= 12
), k AS (
    SELECT f.*, coalesce(why, CASE WHEN NOT EXISTS (SELECT 1 FROM h WHERE h.source = f.source AND h.kind = 'view' AND h.ts BETWEEN f.lo AND f.hi) THEN 'no_process_metrics' END) AS skipped FROM f
)
SELECT k.source, k.id, (SELECT count(DISTINCT pid) FROM r WHERE r.id = k.id) AS answers, skipped, CASE WHEN skipped IS NULL THEN (SELECT min(rank) FROM ranked JOIN r ON r.pid = ranked.pid WHERE r.id = k.id AND ranked.source = k.source) END AS hit_rank FROM k
""",
    "scoreboard": f"""
WITH {S}, {_ALARMS}, e AS (
    SELECT {H} AS source, id, ts AS lo, ts + 1800 AS hi FROM s WHERE source = 'error' AND value > 60
), grid AS (
    SELECT * FROM (SELECT source FROM a UNION SELECT source FROM e) CROSS JOIN (SELECT DISTINCT detector FROM a)
), hit AS (
    SELECT grid.source, grid.detector, e.id, e.lo, min(CASE WHEN a.first IS NOT NULL THEN greatest(a.first, e.lo) END) AS first
    FROM grid JOIN e ON e.source = grid.source LEFT JOIN a ON a.source = e.source AND a.detector = grid.detector AND a.first <= e.hi + 90 AND a.last >= e.lo GROUP BY ALL
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
    SELECT detector, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(fp, 0)) AS BIGINT) AS fp, CAST(sum(coalesce(fn, 0)) AS BIGINT) AS fn, median(latency) AS latency
    FROM grid LEFT JOIN found USING (source, detector) LEFT JOIN wrong USING (source, detector) GROUP BY 1
), r AS (
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM x
)
SELECT {START + 31 * DAY}::DOUBLE AS ts, detector, {START}::DOUBLE AS window_start, {START + 30 * DAY}::DOUBLE AS window_end, tp, fp, fn, round(pr, 6) AS precision, round(rc, 6) AS recall,
       round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1, round(latency, 6) AS latency, 'run' AS notes
FROM r
""",
    "committed_rollup": f"""
WITH {S}, {T}
SELECT source, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n, max(value) AS peak FROM h
WHERE NOT (ts >= {START + 9 * DAY} AND ts < {START + 11 * DAY} AND value <= 20) AND ts >= {START} - 86400 AND ts < {START + 31 * DAY} GROUP BY ALL
""",
    "comparison_detectors": f"""
WITH {S}, {T}, x AS (
    SELECT *, sum(CASE WHEN value >= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts) AS run FROM h
), held AS (
    SELECT *, min(ts) OVER (PARTITION BY source, run) AS since FROM x WHERE value >= 40
), g AS (
    SELECT *, CASE WHEN value >= 100 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END AS risk, CASE WHEN kind = 'view' THEN NULL WHEN 1 - value / 60 >= 0.25 THEN 2 WHEN 1 - value / 60 >= 0.1 THEN 1 ELSE 0 END AS impact FROM h
)
SELECT source, CAST(floor(ts) AS BIGINT) AS ts, 'fixed_value' AS detector, round(greatest(0.05, least(1.0, (value - 40) / 20)), 5) AS score FROM held WHERE ts - since >= 7200
UNION ALL SELECT source, CAST(floor(ts) AS BIGINT), 'gates', round(CASE WHEN kind <> 'view' THEN greatest(128, value * 500 * 0.02) ELSE 100 END, 5) FROM h
UNION ALL SELECT source, CAST(floor(ts) AS BIGINT), CASE WHEN coalesce(impact, -1) >= risk THEN 'grade_impact' ELSE 'grade_risk' END, CAST(greatest(risk, impact) AS DOUBLE) FROM g
""",
}
