"""Observation sessions, process spans, and daily usage of programs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import slot_of
from . import intervals


def sessions(events: DataFrame, hi: float, start: str = "startup", ends: Sequence[str] = ("shutdown", "unclean_shutdown")) -> DataFrame:
    """Merged spans (source, lo, hi) from a start to the next lifecycle event, open ones to ``hi``."""
    own = events.where(F.col("event").isin(start, *ends) & (F.col("ts") < hi))
    end = F.coalesce(F.lead("ts").over(Window.partitionBy("source").orderBy("ts", "event")), F.lit(hi))
    return intervals.union(own.withColumn("hi", end).where(F.col("event") == start).select("source", F.col("ts").alias("lo"), "hi"))


def process_spans(events: DataFrame, observed: DataFrame, hi: float) -> DataFrame:
    """(source, pid, name, lo, hi) from a named start to the pid's next start or exit, clamped to its session's end and ``hi``."""
    own = events.where(F.col("event").isin("start", "exit") & ((F.col("event") == "exit") | F.col("name").isNotNull()))
    until = F.coalesce(F.lead("ts").over(Window.partitionBy("source", "pid").orderBy("ts", "event")), F.lit(hi))
    spans = own.withColumn("hi", until).where("event = 'start'").select("source", "pid", "name", F.col("ts").alias("lo"), "hi")
    marks = observed.select("source", F.col("lo").alias("ts"), F.col("hi").alias("session_end"))
    from .joins import backward

    placed = backward(spans.withColumnRenamed("lo", "ts"), marks, "session_end").withColumnRenamed("ts", "lo")
    return placed.withColumn("hi", F.least("hi", F.coalesce("session_end", "hi"), F.lit(hi))).where("hi > lo").drop("session_end")


def by_day(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans cut at UTC days: (keys, day, lo, hi)."""
    days = spans.withColumn("_d", F.explode(F.sequence(F.floor(F.col("lo") / 86_400), F.floor(F.col("hi") / 86_400))))
    lo, hi = F.greatest(F.col("lo"), F.col("_d") * 86_400.0), F.least(F.col("hi"), (F.col("_d") + 1) * 86_400.0)
    return days.select(*keys, F.date_from_unix_date(F.col("_d").cast("int")).alias("day"), lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def daily_usage(spans: DataFrame, observed: DataFrame, starts: DataFrame, burst: float = 5.0) -> DataFrame:
    """Per (source, day, name): seconds in use, counted once where instances overlap and only inside sessions; launches not within ``burst`` of a session start; seconds observed."""
    keys = ["source", "name"]
    used = intervals.overlap_join(intervals.union(spans.select(*keys, "lo", "hi"), keys), observed, ["source"])
    used = by_day(used.select(*keys, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")), keys).groupBy("source", "day", "name").agg(F.sum(F.col("hi") - F.col("lo")).alias("seconds"))
    seen = by_day(observed, ["source"]).groupBy("source", "day").agg(F.sum(F.col("hi") - F.col("lo")).alias("observed_seconds"))
    calm = intervals.near_marks(starts, observed.select("source", F.col("lo").alias("ts")), burst, how="left_anti")
    launched = calm.groupBy("source", F.date_from_unix_date(F.floor(F.col("ts") / 86_400).cast("int")).alias("day"), "name").agg(F.count("*").alias("launches"))
    return used.join(seen, ["source", "day"]).join(launched, ["source", "day", "name"], "left").withColumn("launches", F.coalesce("launches", F.lit(0)))


def foreground_gaps(foreground: DataFrame, cap: float = 5.0, keys: Sequence[str] = ("source", "day")) -> DataFrame:
    """Adds ``seconds``: to the next foreground sample, ``cap`` at most; the last sample takes the gap before it, a single one goes."""
    order = Window.partitionBy(*keys).orderBy("ts", "name")
    after, before = F.lead("ts").over(order) - F.col("ts"), F.col("ts") - F.lag("ts").over(order)
    return foreground.withColumn("seconds", F.least(F.coalesce(after, before), F.lit(cap))).where("seconds is not null")


def coverage(samples: DataFrame, observed: DataFrame, cap: float = 5.0, least: float = 0.5) -> DataFrame:
    """(source, day, share) of days whose capped gaps between distinct ticks make up ``least`` of the seconds observed."""
    ticks = samples.select("source", "day", "ts").distinct()
    gaps = F.lead("ts").over(Window.partitionBy("source", "day").orderBy("ts")) - F.col("ts")
    covered = ticks.withColumn("_g", F.least(gaps, F.lit(cap))).groupBy("source", "day").agg(F.sum("_g").alias("_s"))
    return covered.join(observed, ["source", "day"]).withColumn("share", F.try_divide(F.col("_s"), F.col("observed_seconds"))).where(F.col("share") >= least).select("source", "day", "share")


def daily_report(foreground: DataFrame, slots: Mapping[str, tuple[int, int]], cap: float = 5.0, top: int = 5) -> DataFrame:
    """Per (source, day): foreground seconds in all, maps by category and slot, and the ``top`` programs. ``foreground`` has (source, day, ts, name, category)."""
    gaps = foreground_gaps(foreground, cap).withColumn("slot", F.coalesce(slot_of(F.hour(F.timestamp_seconds("ts")), slots), F.lit("none")))
    sums = gaps.groupingSets([["source", "day", "name"], ["source", "day", "category"], ["source", "day", "slot"]], "source", "day", "name", "category", "slot").agg(F.round(F.sum("seconds"), 3).alias("s"), F.grouping_id().alias("g"))
    entry = lambda g, c: F.when(F.col("g") == g, F.struct(F.col(c).alias("name"), F.col("s").alias("seconds")))
    out = sums.groupBy("source", "day").agg(F.collect_list(entry(3, "name")).alias("_n"), F.collect_list(entry(5, "category")).alias("_c"), F.collect_list(entry(6, "slot")).alias("_t"))
    order = lambda a: F.array_sort(a, lambda x, y: F.when(x["seconds"] > y["seconds"], -1).when(x["seconds"] < y["seconds"], 1).when(x["name"] < y["name"], -1).otherwise(1))
    total = F.round(F.aggregate("_n", F.lit(0.0), lambda acc, x: acc + x["seconds"]), 3)
    return out.select("source", "day", total.alias("seconds"), F.map_from_entries("_c").alias("by_category"), F.map_from_entries("_t").alias("by_slot"), F.slice(order(F.col("_n")), 1, top).alias("top_apps"))
