"""Reading queries of dashboards and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attributable
from ..operators import intervals
from ..operators.joins import latest, latest_ties, to_dimension


def latest_metrics(metrics: DataFrame) -> DataFrame:
    return latest(metrics, ["source"])


def latest_gpu(gpu: DataFrame) -> DataFrame:
    return latest_ties(gpu)


def recent(rows: DataFrame, now: float, seconds: float) -> DataFrame:
    return rows.where(F.col("ts") >= now - seconds).orderBy("source", "ts")


def top_programs(processes: DataFrame, now: float, seconds: float, limit: int = 15) -> DataFrame:
    """A top-k report of programs in a window by mean CPU."""
    own = processes.where(F.col("ts") >= now - seconds).groupBy("source", "name")
    return own.agg(F.countDistinct("pid").alias("pids"), F.avg("cpu_percent").alias("cpu_avg"), F.max("cpu_percent").alias("cpu_max"), F.avg("rss_mb").alias("rss_avg"), F.max("handles").alias("handles_max"), F.max("foreground").alias("foreground")).orderBy(F.desc("cpu_avg"), "source", "name").limit(limit)


def program_series(processes: DataFrame, name: str) -> DataFrame:
    return processes.where(F.col("name") == name).groupBy("source", "ts").agg(F.sum("cpu_percent").alias("cpu"), F.sum("rss_mb").alias("rss"))


def inventory(tables: Mapping[str, DataFrame], ts: str = "ts") -> DataFrame:
    """(table, first, last, rows)."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def live_signals(signals: DataFrame, limit: int = 200) -> DataFrame:
    return signals.where("run_id is null").orderBy(F.desc("ts"), "detector").limit(limit)


def rollup_state(progress: DataFrame, now: float) -> DataFrame:
    """(name, upto, lag_minutes) of rollups: how far each table (name, hi: the end of a commit) has come, and how long ago that is; a table without commits has nulls."""
    return progress.groupBy("name").agg(F.max("hi").alias("upto")).withColumn("lag_minutes", (now - F.col("upto")) / 60)


def exports_and_span(exports: DataFrame, warm_days: DataFrame) -> DataFrame:
    """(source, exports, exported_rows, first_day, last_day, days, missing_days): what has been exported (source, day, rows) beside the days that the warm tier has (source, day)."""
    made = exports.groupBy("source").agg(F.count("*").alias("exports"), F.sum("rows").alias("exported_rows"))
    span = warm_days.distinct().groupBy("source").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    out = made.join(span, "source", "full_outer").fillna(0, ["exports", "exported_rows", "days"])
    return out.withColumn("missing_days", F.datediff("last_day", "first_day") + 1 - F.col("days"))


def incident_signals(links: DataFrame, signals: DataFrame, limit: int = 50) -> DataFrame:
    """(source, incident_id, ts, detector, score, rank): an incident's latest signals, best first at a time; a top-k report."""
    met = links.select("source", "incident_id", "ts", "detector").join(signals.select("source", "ts", "detector", "score"), ["source", "ts", "detector"])
    order = Window.partitionBy("source", "incident_id").orderBy(F.desc("ts"), F.desc("score"), "detector")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def shares(report: DataFrame, part: str, whole: str, name: str = "share") -> DataFrame:
    """Adds ``name``: ``part`` of ``whole``, null where nothing was observed."""
    return report.withColumn(name, F.try_divide(F.col(part), F.when(F.col(whole) > 0, F.col(whole))))


def _during(incidents: DataFrame, faults: DataFrame) -> DataFrame:
    spans = incidents.select("source", "id", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    marks = faults.select("source", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    hit = intervals.touches_any(spans, marks).select("source", "id").withColumn("during_injection", F.lit(True))
    return incidents.join(hit, ["source", "id"], "left").withColumn("during_injection", F.coalesce("during_injection", F.lit(False)))


def answer_queue(incidents: DataFrame, faults: DataFrame, now: float, kinds: Sequence[str] = ("THERMAL",)) -> DataFrame:
    """Incidents that wait for an answer: notified within 14 days, or of a listed kind within 7; without a label; not during a fault."""
    day = 86_400.0
    fresh = (F.col("notified") & (F.col("ts_start") >= now - 14 * day)) | (~F.coalesce("notified", F.lit(False)) & F.upper("bottleneck").isin(*kinds) & (F.col("ts_start") >= now - 7 * day))
    return _during(incidents, faults).where(fresh & F.coalesce("user_label", "auto_label").isNull() & ~F.col("during_injection"))


def incident_list(incidents: DataFrame, faults: DataFrame, now: float, days: float = 30, limit: int = 200) -> DataFrame:
    queue = answer_queue(incidents, faults, now).select("source", "id").withColumn("pending_answer", F.lit(True))
    out = _during(incidents.where(F.col("ts_start") >= now - days * 86_400), faults).join(queue, ["source", "id"], "left")
    out = out.withColumn("pending_answer", F.coalesce("pending_answer", F.lit(False))).withColumn("attributable", attributable(F.col("bottleneck")))
    return out.withColumn("status", answer_status()).orderBy(F.desc("ts_start"), "source", "id").limit(limit)


def answer_status():
    return F.when(F.col("user_label").isNotNull(), F.col("user_label")).when(F.col("auto_label").isNotNull(), F.concat(F.lit("auto:"), F.col("auto_label"))).when(F.col("during_injection"), "injection").when(F.col("pending_answer"), "pending").otherwise("")


def health(incidents: DataFrame, metrics: DataFrame, queue: DataFrame, now: float, stale: float = 60.0) -> DataFrame:
    """(source, open, last_end, last_sample, pending, status, prompt); no data, stale, open incident, normal, in this order."""
    a = metrics.groupBy("source").agg(F.max("ts").alias("last_sample"))
    b = incidents.groupBy("source").agg(F.count_if(F.col("ts_end").isNull()).alias("open"), F.max("ts_end").alias("last_end"))
    c = queue.groupBy("source").agg(F.count("*").alias("pending"))
    out = a.join(b, "source", "full_outer").join(c, "source", "left").fillna(0, ["open", "pending"])
    status = F.when(F.col("last_sample").isNull(), "no_data").when(now - F.col("last_sample") > stale, "stale").when(F.col("open") > 0, "incident").otherwise("normal")
    return out.withColumn("status", status).withColumn("prompt", F.col("status").isin("incident", "normal") & (F.col("pending") > 0))


def usage_board(usage: DataFrame, info: DataFrame, since: str, exclude: Sequence[str] = (), user_only: bool = False, limit: int = 30) -> DataFrame:
    """A top-k report of programs by seconds in use, with descriptions, hours and share of the time observed.

    The time observed counts all days, also those that hold excluded programs alone; descriptions are those of the same source.
    """
    recent = usage.where(F.col("day") >= F.lit(since).cast("date"))
    total, own = observed_total(recent), recent.where(~F.col("name").isin(*exclude, ""))
    sums = own.groupBy("source", "name").agg(F.sum("seconds").alias("seconds"), F.sum("launches").alias("launches"), F.countDistinct("day").alias("days"))
    out = to_dimension(sums, info, ("source", "name")).join(total, "source").withColumn("hours", F.col("seconds") / 3600).withColumn("share", F.try_divide(F.col("seconds"), F.col("observed_seconds")))
    out = out.where("foreground_seen") if user_only else out
    return out.orderBy(F.desc("seconds"), "source", "name").limit(limit)


def observed_total(usage: DataFrame) -> DataFrame:
    return usage.groupBy("source", "day").agg(F.max("observed_seconds").alias("o")).groupBy("source").agg(F.sum("o").alias("observed_seconds"))


def compare_days(reports: DataFrame) -> DataFrame:
    """Each report with the change of its total and of every category since the previous recorded day."""
    order = Window.partitionBy("source").orderBy("day")
    before = F.lag(F.struct("seconds", "by_category")).over(order)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    delta = F.map_zip_with("by_category", F.coalesce(F.col("_b.by_category"), empty), lambda _, a, b: F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))
    return reports.withColumn("_b", before).withColumn("delta", F.col("seconds") - F.col("_b.seconds")).withColumn("category_delta", F.when(F.col("_b").isNotNull(), delta)).drop("_b")


def growth_per_hour(samples: DataFrame, value: str, least_hours: float, keys: Sequence[str] = ("source",)) -> DataFrame:
    hours = (F.max("ts") - F.min("ts")) / 3600
    own = samples.where(F.col(value).isNotNull()).groupBy(*keys)
    return own.agg(F.when(hours > least_hours, (F.max_by(value, "ts") - F.min_by(value, "ts")) / hours).alias("growth_per_hour"))


def foreground_share(minutes: DataFrame, limit: int = 10) -> DataFrame:
    own = minutes.where("fg_program is not null").groupBy("source", "fg_program").agg(F.count("*").alias("n"))
    ranked = own.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source"))).withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "fg_program")))
    return ranked.where(F.col("_r") <= limit).drop("_r")


def false_positive_rate(incidents: DataFrame) -> DataFrame:
    """(source, judged, normal, rate): user labels without ``unknown``, and automatic ones that no user label overrides outside faults."""
    label = F.when(F.col("user_label").isNotNull(), F.when(F.col("user_label") != "unknown", F.col("user_label"))).when(~F.col("during_injection"), F.col("auto_label"))
    out = incidents.withColumn("_l", label).groupBy("source").agg(F.count("_l").alias("judged"), F.count_if(F.col("_l") == "normal").alias("normal"))
    return out.withColumn("rate", F.try_divide(F.col("normal"), F.col("judged")))


def observer_alert(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("source").agg(F.max_by("drop_count", "ts").alias("drops"), F.count_if(F.col("throttle_level") > 0).alias("throttled"), F.max("throttle_level").alias("worst"))


def break_gaps(series: DataFrame, keys: Sequence[str] = ("source",), factor: float = 3.0) -> DataFrame:
    """The series (keys, ts, value) with a null point one typical step (upper median) after each point that a step over ``factor`` times it follows."""
    step = series.withColumn("_next", F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts"))).withColumn("_step", F.col("_next") - F.col("ts"))
    own = Window.partitionBy(*keys)
    ranked = step.where("_step is not null").withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy("_step")))
    typical = ranked.where((F.col("_n") >= 2) & (F.col("_i") == F.floor(F.col("_n") / 2) + 1)).select(*keys, F.col("_step").alias("_typical"))
    added = step.join(typical, list(keys)).where(F.col("_step") > factor * F.col("_typical")).select(*keys, (F.col("ts") + F.col("_typical")).alias("ts"), F.lit(None).cast("double").alias("value"))
    return series.select(*keys, "ts", "value").unionByName(added)
