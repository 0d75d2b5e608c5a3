"""Rates, events, active sets and gaps derived from raw samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import backward, in_spans


def counter_rate(samples: DataFrame, value: str, out: str, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Adds ``out``: change a second since the sample before; null on the first, on no time passed and on a counter that fell."""
    order = Window.partitionBy(*keys).orderBy("ts")
    dv, dt = F.col(value) - F.lag(value).over(order), F.col("ts") - F.lag("ts").over(order)
    return samples.withColumn(out, F.when((dt > 0) & (dv >= 0), dv / dt))


def snapshot_events(snapshots: DataFrame, keys: Sequence[str] = ("source",), member: str = "pid") -> DataFrame:
    """(keys, ts, member, event): start where a member is new in a snapshot, exit at the first snapshot without it. The first snapshot gives no event."""
    times = snapshots.select(*keys, "ts").distinct()
    order = Window.partitionBy(*keys).orderBy("ts")
    numbered = times.withColumn("_i", F.row_number().over(order)).withColumn("_next", F.lead("ts").over(order))
    own = Window.partitionBy(*keys, member).orderBy("_i")
    seen = snapshots.select(*keys, "ts", member).distinct().join(numbered, [*keys, "ts"]).withColumn("_before", F.lag("_i").over(own)).withColumn("_after", F.lead("_i").over(own))
    starts = seen.where((F.col("_i") > 1) & (F.col("_before").isNull() | (F.col("_before") < F.col("_i") - 1))).select(*keys, "ts", member, F.lit("start").alias("event"))
    exits = seen.where(F.col("_next").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("_i") + 1))).select(*keys, F.col("_next").alias("ts"), member, F.lit("exit").alias("event"))
    return starts.unionByName(exits)


def active_set(processes: DataFrame, top_cpu: int = 15, top_rss: int = 10, top_growth: int = 10, full_every: float = 30.0) -> DataFrame:
    """Rows of each tick that lead by CPU, memory or positive handle growth or are in the foreground; all rows once each ``full_every`` seconds."""
    tick = Window.partitionBy("source", "ts")
    grown = F.col("handles") - F.lag("handles").over(Window.partitionBy("source", "pid").orderBy("ts"))
    first = F.min("ts").over(Window.partitionBy("source", F.floor(F.col("ts") / full_every)))
    ranked = processes.withColumn("_grown", grown).withColumn("_full", F.col("ts") == first)
    for name, column in (("_c", "cpu_percent"), ("_r", "rss_mb"), ("_h", "_grown")):
        ranked = ranked.withColumn(name, F.row_number().over(tick.orderBy(F.col(column).desc_nulls_last(), "pid")))
    kept = (F.col("_c") <= top_cpu) | (F.col("_r") <= top_rss) | ((F.col("_h") <= top_growth) & (F.col("_grown") > 0)) | F.coalesce("foreground", F.lit(False))
    return ranked.withColumn("tier", F.when(kept, 1).when(F.col("_full"), 2)).where("tier is not null").drop("_grown", "_full", "_c", "_r", "_h")


def time_gaps(ticks: DataFrame, expected: float = 1.0, threshold: float = 30.0, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Ticks (ts, mono) after a jump: gap_seconds and cause (clock_backwards, wall_jump, suspend_or_stall)."""
    order = Window.partitionBy(*keys).orderBy("mono")
    wall, mono = F.col("ts") - F.lag("ts").over(order), F.col("mono") - F.lag("mono").over(order)
    cause = F.when(wall < -1, "clock_backwards").when((wall > expected + threshold) & (mono <= expected + threshold), "wall_jump").when(wall > expected + threshold, "suspend_or_stall")
    return ticks.withColumn("gap_seconds", wall).withColumn("cause", cause).where("cause is not null")


def unclean_shutdowns(lifecycle: DataFrame, traces: DataFrame, boots: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Startups without an end before the next: (source, startup, ts of the last trace row, cause reboot or crash by the boot times)."""
    order = Window.partitionBy("source").orderBy("ts")
    open_ = lifecycle.where(F.col("event").isin("startup", "shutdown", "unclean_shutdown")).withColumn("next_event", F.lead("event").over(order)).withColumn("next_ts", F.lead("ts").over(order)).where("event = 'startup' and (next_event = 'startup' or next_event is null)").select("source", F.col("ts").alias("startup"), F.coalesce("next_ts", F.lit(float("inf"))).alias("until"))
    # The last trace row before the next event, by one pass over both; it counts if it comes after the startup.
    marks = traces.select("source", "ts", F.col("ts").alias("trace"))
    last = backward(open_.withColumn("ts", F.col("until") - 1e-6), marks, "trace").where("trace >= startup").select("source", "startup", "until", F.col("trace").alias("ts"))
    booted = last.join(boots.select("source", "boot_time"), "source", "left")
    between = (F.col("boot_time") > F.col("ts") - tolerance) & (F.col("boot_time") <= F.col("until") + tolerance)
    return booted.groupBy("source", "startup", "ts").agg(F.when(F.max(between.cast("int")) == 1, "reboot").otherwise("crash").alias("cause"))


def with_suspect(ticks: DataFrame, events: DataFrame, after: float = 30.0, before: float = 1.0, step: float = 10.0) -> DataFrame:
    """Adds ``suspect``: close behind a gap or startup, or long after the tick before."""
    marks = events.where(F.col("event").isin("time_gap", "startup")).select("source", (F.col("ts") - before).alias("lo"), (F.col("ts") + after).alias("hi"))
    near = in_spans(ticks, marks, how="left_semi").select("source", "ts").distinct().withColumn("_near", F.lit(True))
    late = F.col("ts") - F.lag("ts").over(Window.partitionBy("source").orderBy("ts")) > step
    return ticks.withColumn("_late", late).join(near, ["source", "ts"], "left").withColumn("suspect", F.coalesce("_near", F.lit(False)) | F.coalesce("_late", F.lit(False))).drop("_near", "_late")
