"""Rollups to minutes and five minutes. Helper rules: means, maxima and minima to 3 places, null for nothing; percentiles by the element at round-half-even(q * (n - 1)); population deviation."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucket_of
from . import intervals


def settled(c: Column, places: int = 3) -> Column:
    """``c`` to some places, halves away from zero. Six places more are rounded first, so that the order in which numbers were added decides no half."""
    return F.round(F.round(c, places + 6), places)


def mean3(c: Column | str, places: int = 3) -> Column:
    """Settled at the three places of a rollup; more places are for comparisons and are rounded once."""
    return settled(F.avg(c)) if places == 3 else F.round(F.avg(c), places)


def max3(c: Column | str) -> Column:
    return F.round(F.max(c), 3)


def min3(c: Column | str) -> Column:
    return F.round(F.min(c), 3)


def std3(c: Column | str, places: int = 3) -> Column:
    return settled(F.stddev_pop(c)) if places == 3 else F.round(F.stddev_pop(c), places)


def pct_index(c: str, q: float) -> Column:
    """Element ``bround(q * (n - 1))`` of the sorted values; for groups of a bucket's size (60 or 300 samples a series)."""
    return F.round(F.element_at(F.sort_array(F.collect_list(c)), (F.bround(F.lit(q) * (F.count(c) - 1)).cast("int") + 1)), 3)


def pct_rank(c: str, q: float) -> Column:
    """Nearest rank ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})")


# The columns of the one-minute rollup, as (column, functions).
MINUTE_COLUMNS: Mapping[str, str] = {
    "cpu_total": "mean max p95 std", "cpu_max_core": "mean max", "cpu_freq_mhz": "mean min", "cpu_perf_percent": "mean min", "mem_used_mb": "mean max",
    "mem_avail_mb": "mean min", "mem_percent": "mean max", "swap_used_mb": "mean max", "disk_read_bps": "mean max", "disk_write_bps": "mean max", "disk_queue": "mean max",
    "disk_resp_ms": "mean max p95", "net_rx_bps": "mean max", "net_tx_bps": "mean max", "ctx_switches_ps": "mean max", "proc_count": "mean max", "thread_count": "mean max",
}
_MAKE = {"mean": mean3, "max": max3, "min": min3, "std": std3, "p95": lambda c: pct_index(c, 0.95)}


def minute_rollup(metrics: DataFrame, columns: Mapping[str, str] = MINUTE_COLUMNS, size: float = 60.0) -> DataFrame:
    """One row per (source, bucket): sample_count, statistics of each column that is there, and the mean imbalance of cores. One shuffle."""
    made = [_MAKE[f](c).alias(f"{c}_{f}") for c, fs in columns.items() if c in metrics.columns for f in fs.split()]
    if {"cpu_max_core", "cpu_total"} <= set(metrics.columns):
        made.append(mean3(F.col("cpu_max_core") - F.col("cpu_total")).alias("cpu_imbalance_mean"))
    return metrics.groupBy("source", bucket_of(F.col("ts"), size).alias("bucket")).agg(F.count("cpu_total").alias("sample_count"), *made)


def gpu_fold(gpu: DataFrame, size: float = 60.0) -> DataFrame:
    own = gpu.where("gpu_index = 0").groupBy("source", bucket_of(F.col("ts"), size).alias("bucket"))
    return own.agg(mean3("util_percent").alias("gpu_util_mean"), max3("util_percent").alias("gpu_util_max"), mean3("vram_used_mb").alias("gpu_vram_mean"), max3("vram_used_mb").alias("gpu_vram_max"), max3("temp_c").alias("gpu_temp_max"), mean3("power_w").alias("gpu_power_mean"), mean3("clock_sm_mhz").alias("gpu_clock_mean"), min3("clock_sm_mhz").alias("gpu_clock_min"))


def dominant(rows: DataFrame, name: str = "name", by: Sequence[str] = ("source", "bucket")) -> DataFrame:
    """Most frequent name of each bucket and its share; the least name on a tie."""
    counts = rows.groupBy(*by, name).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(name).alias("name")))
    return counts.groupBy(*by).agg(best.alias("_b"), F.sum("_n").alias("_all")).select(*by, F.col("_b.name").alias("dominant"), F.round(-F.col("_b.n") / F.col("_all"), 3).alias("dominant_ratio"))


def top_share(rows: DataFrame, value: str, name: str = "name", by: Sequence[str] = ("source", "bucket"), ts: str = "ts") -> DataFrame:
    """Name with the largest sum in each bucket and that sum over the bucket's distinct ticks; the least name on a tie."""
    sums = rows.groupBy(*by, name).agg(F.round(F.sum(value), 9).alias("_s"))
    ticks = rows.groupBy(*by).agg(F.countDistinct(ts).alias("_ticks"))
    best = F.min(F.struct((-F.col("_s")).alias("s"), F.col(name).alias("name")))
    return sums.groupBy(*by).agg(best.alias("_b")).join(ticks, list(by)).select(*by, F.col("_b.name").alias("top_name"), settled(-F.col("_b.s") / F.col("_ticks")).alias("top_share"))


def metrics_1m(metrics: DataFrame, gpu: DataFrame, processes: DataFrame, gaps: DataFrame, size: float = 60.0) -> DataFrame:
    """The whole minute rollup: system, GPU, foreground and top program, and ``has_gap`` where a gap (source, lo, hi) touches the minute."""
    keyed = processes.withColumn("bucket", bucket_of(F.col("ts"), size))
    fg = dominant(keyed.where("foreground")).withColumnsRenamed({"dominant": "fg_program", "dominant_ratio": "fg_ratio"})
    top = top_share(keyed.where("foreground or cpu_percent > 0"), "cpu_percent").withColumnsRenamed({"top_name": "top_cpu_program", "top_share": "top_cpu_share"})
    touched = intervals.touched_buckets(gaps, size).withColumn("_gap", F.lit(True))
    out = minute_rollup(metrics, size=size)
    for part in (gpu_fold(gpu, size), fg, top, touched):
        out = out.join(part, ["source", "bucket"], "left")
    return out.withColumn("has_gap", F.coalesce("_gap", F.lit(False))).drop("_gap")


def process_rollup(processes: DataFrame, size: float = 300.0, top: int = 20, value: str = "cpu_percent", second: str = "rss_mb", pid: str = "pid", places: int = 3, further: Sequence[str] = ()) -> DataFrame:
    """Two stages: sums over the pids of a name at each tick, then statistics per (source, bucket, name); the leaders by mean ``value`` and by largest ``second`` stay.

    Each of ``further`` (bytes read and written, handles, threads) gives its sums' mean and largest, as ``{name}_mean`` and ``{name}_max``.
    """
    sums = [F.sum(c).alias(f"_f{k}") for k, c in enumerate(further)]
    ticks = processes.groupBy("source", "name", "ts").agg(F.sum(value).alias("_v"), F.sum(second).alias("_w"), F.countDistinct(pid).alias("_pids"), *sums)
    stats = ticks.groupBy("source", bucket_of(F.col("ts"), size).alias("bucket"), "name").agg(
        F.count("*").alias("sample_count"), mean3("_v", places).alias("value_mean"), pct_index("_v", 0.5).alias("value_p50"), pct_index("_v", 0.95).alias("value_p95"), pct_index("_v", 0.99).alias("value_p99"), max3("_v").alias("value_max"), mean3("_w", places).alias("second_mean"), max3("_w").alias("second_max"), F.max("_pids").alias("pids_max"),
        *(x for k, c in enumerate(further) for x in (mean3(f"_f{k}", places).alias(f"{c}_mean"), max3(f"_f{k}").alias(f"{c}_max"))),
    )
    bucket = Window.partitionBy("source", "bucket")
    a = F.row_number().over(bucket.orderBy(F.col("value_mean").desc_nulls_last(), "name"))
    b = F.row_number().over(bucket.orderBy(F.col("second_max").desc_nulls_last(), "name"))
    return stats.withColumn("_a", a).withColumn("_b", b).where((F.col("_a") <= top) | (F.col("_b") <= top)).drop("_a", "_b")


def net_rollup(connections: DataFrame, size: float = 300.0, approximate: bool = False) -> DataFrame:
    """Connections a snapshot, distinct remotes and ports, listeners per (source, bucket, name); addresses don't leave."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return connections.groupBy("source", bucket_of(F.col("ts"), size).alias("bucket"), "name").agg(
        F.round(F.count("*") / F.countDistinct("ts"), 3).alias("conns_mean"), distinct("raddr").alias("remotes"), distinct(F.when(F.col("raddr").isNotNull(), F.col("rport"))).alias("ports"), F.count_if(F.col("status") == "LISTEN").alias("listens")
    )


def pending(rows: DataFrame, watermark: float, now: float, size: float, lag: float = 90.0, most_buckets: int = 720) -> tuple[DataFrame, float]:
    """Rows of closed buckets from the watermark on, and the next watermark; the open bucket waits. ``most_buckets`` bounds one run, the next goes on."""
    end = min((now - lag) // size * size, watermark + most_buckets * size)
    return rows.where((F.col("ts") >= watermark) & (F.col("ts") < end)), max(watermark, end)


def missing_buckets(raw: DataFrame, rolled: DataFrame, size: float, floor: float, watermark: float) -> DataFrame:
    """Buckets with raw rows and no rollup row, above the exported floor and below the watermark."""
    there = raw.where((F.col("ts") >= floor) & (F.col("ts") < watermark)).select("source", bucket_of(F.col("ts"), size).alias("bucket")).distinct()
    return there.join(rolled.select("source", "bucket").distinct(), ["source", "bucket"], "left_anti")


def backfill(raw: DataFrame, missing: DataFrame, fold, size: float) -> DataFrame:
    """``fold`` of the raw rows in the missing buckets alone."""
    keyed = raw.withColumn("bucket", bucket_of(F.col("ts"), size)).join(missing, ["source", "bucket"], "left_semi").drop("bucket")
    return fold(keyed)
