"""Two-tier history: day coverage, indices, fingerprints, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals
from .rollup import pct_rank


def warm_wins(warm: DataFrame, hot: DataFrame, day: str = "day", keys: Sequence[str] = ("source",)) -> DataFrame:
    """Both tiers as one table; a whole (keys, day) that the warm tier has is not read from the hot one."""
    own = [*keys, day]
    return warm.unionByName(hot.join(warm.select(*own).distinct(), own, "left_anti"), allowMissingColumns=True)


def day_coverage(rolled: DataFrame, size: float, day: str = "day") -> DataFrame:
    """(source, day, buckets, hours)."""
    return rolled.groupBy("source", day).agg(F.countDistinct("bucket").alias("buckets")).withColumn("hours", F.round(F.col("buckets") * (size / 3600), 3))


def busy_minutes(rolled: DataFrame, column: str, threshold: float, day: str = "day") -> DataFrame:
    return rolled.where(F.col(column) >= threshold).groupBy("source", day).agg(F.count("*").alias("busy"))


def span_of(rolled: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(source, first, last, rows) and for each column whether it has data."""
    return rolled.groupBy("source").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.count("*").alias("rows"), *((F.count(c) > 0).alias(f"has_{c}") for c in columns))


def day_index(stats: DataFrame, faults: DataFrame | None = None, size: float = 300.0, day: str = "day") -> DataFrame:
    """(source, name, day, buckets): distinct buckets that overlap no fault window (source, lo, hi)."""
    kept = intervals.outside(stats, faults, size) if faults is not None else stats
    return kept.groupBy("source", "name", day).agg(F.countDistinct("bucket").alias("buckets"))


def fingerprints(stats: DataFrame, values: Sequence[str], faults: DataFrame | None = None, size: float = 300.0, least_days: int = 3, least_buckets: int = 12, least_samples: int = 100, day: str = "day") -> DataFrame:
    """Per (source, name, stat): p50, p95, p99, maximum, samples, days; for names with enough days of enough buckets and enough samples."""
    kept = intervals.outside(stats, faults, size) if faults is not None else stats
    days = day_index(kept, None, size, day).where(F.col("buckets") >= least_buckets).groupBy("source", "name").agg(F.count("*").alias("days")).where(F.col("days") >= least_days)
    tall = kept.unpivot(["source", "name", "bucket"], list(values), "stat", "value").where("value is not null")
    made = tall.groupBy("source", "name", "stat").agg(pct_rank("value", 0.5).alias("p50"), pct_rank("value", 0.95).alias("p95"), pct_rank("value", 0.99).alias("p99"), F.max("value").alias("maximum"), F.count("*").alias("samples"))
    return made.where(F.col("samples") >= least_samples).join(days, ["source", "name"])


def replaced_model(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new model table; the old one where the new is empty."""
    return old if new.isEmpty() else new


def foreground_seen(old: DataFrame, rolled: DataFrame) -> DataFrame:
    """(source, name, foreground_seen): once seen, it stays."""
    now = rolled.where("fg_ratio > 0").select("source", F.col("fg_program").alias("name"), F.lit(True).alias("foreground_seen"))
    return old.select("source", "name", "foreground_seen").unionByName(now).groupBy("source", "name").agg(F.max("foreground_seen").alias("foreground_seen"))


def readiness(days: DataFrame, busy: DataFrame, index: DataFrame, labels: DataFrame, day: str = "day") -> DataFrame:
    """(source, check, required, actual, ok): days of at least 6 hours, of them busy for at least 30 minutes, programs with 3 days and 100 buckets, labels."""
    full = days.where("hours >= 6").groupBy("source").agg(F.count("*").alias("n"))
    hot = days.where("hours >= 6").join(busy.where("busy >= 30"), ["source", day]).groupBy("source").agg(F.count("*").alias("n"))
    programs = index.groupBy("source", "name").agg(F.count("*").alias("d"), F.sum("buckets").alias("b")).where("d >= 3 and b >= 100").groupBy("source").agg(F.count("*").alias("n"))
    counted = labels.groupBy("source").agg(F.count("*").alias("n"))
    out = None
    for name, required, df in (("full_days", 7, full), ("busy_days", 3, hot), ("programs", 1, programs), ("labels", 7, counted)):
        row = df.select("source", F.lit(name).alias("check"), F.lit(required).cast("long").alias("required"), F.col("n").alias("actual"), (F.col("n") >= required).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out
