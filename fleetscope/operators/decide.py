"""Incidents from signals, suppression, notification budget, automatic labels, retention."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import severity_name, severity_rank
from ..session import cut
from . import intervals


# Bottlenecks by which hardware cut performance, and those that a user's own program makes.
HARDWARE_KINDS, WORKLOAD_KINDS = ("THERMAL",), ("CPU", "CONTENTION")


def fuse(signals: DataFrame, gap: float = 120.0, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Adds ``session`` per source; a new one starts after more than ``gap`` seconds without a signal."""
    return intervals.islands(signals, gap, keys, tie=("detector", "score")).withColumnRenamed("island", "session")


def fold(fused: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """One incident a session: bounds, count, peak, detectors, and severity: the largest so far, one step up for every further signal once two detectors have spoken.

    So one detector gives its largest; where a second one's first signal is also the last of all, that is one step up; with any
    further signal it is critical. Detectors are summed up before sessions are, and no session's signals are gathered.
    """
    order = F.struct("ts", "detector", "score", severity_rank(F.col("severity")).alias("rank"))
    per = fused.withColumn("_o", order).groupBy(*keys, "session", "detector").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("n"), F.max("score").alias("peak"), F.max("_o.rank").alias("rank"))
    firsts = F.array_sort(F.collect_list(F.struct("first", "n")))
    out = per.groupBy(*keys, "session").agg(F.min("first.ts").alias("ts_start"), F.max("last.ts").alias("ts_end"), F.sum("n").alias("signal_count"), F.max("peak").alias("peak_score"), firsts.alias("_f"), F.max("last").alias("_last"), F.max("rank").alias("_rank"), F.array_sort(F.collect_list("detector")).alias("detectors"))
    second = F.get("_f", F.lit(1))
    rank = F.when(F.size("_f") == 1, F.col("_rank")).when((second["first"] == F.col("_last")) & (second["n"] == 1), F.least(F.col("_rank") + 1, F.lit(2))).otherwise(2)
    return out.select(*keys, "session", "ts_start", "ts_end", "signal_count", "peak_score", severity_name(rank).alias("severity"), "detectors")


def _free_of_equals(level: DataFrame) -> DataFrame:
    """(source, id) of the incidents that no free one of the same severity hides: one that began strictly earlier and reaches them.

    Each task streams its sources' incidents by start and holds how far the free ones reach; an open incident is free.
    """
    own = level.select("source", "id", "lo", "hi", "open").repartition("source").sortWithinPartitions("source", "lo", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, start, reach, later = None, -np.inf, -np.inf, -np.inf
        for batch in batches:
            kept = []
            for k, (s, lo, hi, is_open) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "lo", "hi", "open")), strict=True)):
                if s != source:
                    source, start, reach, later = s, lo, -np.inf, -np.inf
                if lo > start:
                    start, reach = lo, max(reach, later)
                if is_open or reach < lo:
                    kept.append(k)
                    later = max(later, hi)
            yield batch.select(["source", "id"]).take(pa.array(kept, pa.int64()))

    return own.mapInArrow(run, own.select("source", "id").schema)


def suppress(incidents: DataFrame) -> DataFrame:
    """Adds ``suppressed_by``: of the incidents that overlap a closed one (ends included), are not suppressed themselves and are more
    severe, or as severe and began earlier, the one that began first (the smaller id on a tie). An open incident is never
    suppressed, and reaches on without an end.

    Severities are solved from the top: what a free, more severe incident overlaps is hidden; the rest is swept by start.
    """
    first = incidents.select("source", "id", F.col("ts_start").alias("lo"), F.col("ts_end").alias("hi"), severity_rank(F.col("severity")).alias("rank"))
    # An open incident reaches to the last time that its source has, which is as good as no end.
    last = first.groupBy("source").agg(F.max(F.greatest("lo", "hi")).alias("_last"))
    spans = cut(first.join(last, "source").select("source", "id", "lo", F.coalesce("hi", "_last").alias("hi"), "rank", F.col("hi").isNull().alias("open")))
    free = None
    for rank in (2, 1, 0):
        level = spans.where(F.col("rank") == rank)
        if free is not None:
            level = level.where("open").unionByName(intervals.touches_any(level.where("not open"), free, how="left_anti"))
        mine = level.join(_free_of_equals(level), ["source", "id"], "left_semi")
        free = cut(mine if free is None else free.unionByName(mine))
    hidden = spans.where("not open").join(free.select("source", "id"), ["source", "id"], "left_anti").withColumnsRenamed({"id": "own_id", "rank": "own_rank"})
    met = intervals.overlap_join(hidden, free.select("source", "lo", "hi", "id", "rank"), ends=True)
    hides = (F.col("rank") > F.col("own_rank")) | ((F.col("rank") == F.col("own_rank")) & (F.col("lo2") < F.col("lo")))
    by = met.where(hides).groupBy("source", F.col("own_id").alias("id")).agg(F.min_by("id", F.struct("lo2", "id")).alias("suppressed_by"))
    return incidents.drop("suppressed_by").join(by, ["source", "id"], "left")


def budget(incidents: DataFrame, per_day: int = 8, ts: str = "ts_start", by: Sequence[str] = ("source",)) -> DataFrame:
    """Adds ``notified`` and ``notify_skipped``: each UTC day the first ``per_day`` of warning or more, then critical ones only."""
    rank = severity_rank(F.col("severity"))
    day = F.floor(F.col(ts) / 86_400)
    order = Window.partitionBy(*by, day, rank >= 1).orderBy(ts, "id")
    n = F.when(rank >= 1, F.row_number().over(order))
    return incidents.withColumn("_n", n).withColumn("notified", F.coalesce((F.col("_n") <= per_day) | (rank == 2), F.lit(False))).withColumn("notify_skipped", F.when(rank < 1, "severity").when(~F.col("notified"), "budget")).drop("_n")


def observer_window(incidents: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(source, id, n, cpu_max, throttle_max, drops) of the observer's own telemetry in each incident."""
    from .joins import in_spans

    met = in_spans(telemetry.select("source", "ts", "cpu_percent", "throttle_level", "drop_count"), incidents.select("source", "id", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi")))
    return met.groupBy("source", "id").agg(F.count("*").alias("n"), F.max("cpu_percent").alias("cpu_max"), F.max("throttle_level").alias("throttle_max"), (F.max("drop_count") - F.min("drop_count")).alias("drops"))


def auto_label(incidents: DataFrame, faults: DataFrame, seen: DataFrame, observer: DataFrame, excluded: Sequence[str] = (), observers: Sequence[str] = (), least_share: float = 0.15, observer_pattern: str | None = None) -> DataFrame:
    """Adds ``auto_label`` and ``auto_label_reason`` for notified, unlabelled incidents outside faults: hardware limits are real; a user's program in the foreground is normal; else none, with the reason.

    A leader that may be the observer itself needs telemetry of the observer in the incident that shows neither throttling
    nor drops; without any sample there is no label. Names are compared without case; ``observer_pattern`` matches whole ones.
    """
    marks = faults.select("source", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    spans = incidents.select("source", "id", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    during = intervals.touches_any(spans, marks).select("source", "id").distinct().withColumn("_fault", F.lit(True))
    top = F.get("contributors", F.lit(0))
    rows = incidents.join(during, ["source", "id"], "left").join(observer, ["source", "id"], "left").withColumn("_name", top["name"]).withColumn("_share", top["share"])
    known = seen.groupBy("source", F.lower("name").alias("_lower")).agg(F.max("foreground_seen").alias("_seen"))
    rows = rows.withColumn("_lower", F.lower("_name")).join(known, ["source", "_lower"], "left")
    clean = F.coalesce((F.col("n") > 0) & (F.col("throttle_max") == 0) & (F.col("drops") == 0), F.lit(False))
    kind = F.upper(F.coalesce("bottleneck", F.lit("")))
    observing = F.col("_lower").isin(*(x.lower() for x in observers), "")
    if observer_pattern is not None:
        observing = observing | F.col("_lower").rlike(f"^(?i:{observer_pattern})$")
    reason = (
        F.when(~F.coalesce("notified", F.lit(False)), "not_notified").when(F.coalesce("user_label", "auto_label").isNotNull(), "labelled").when(F.col("_fault"), "during_fault")
        .when(kind.isin(*HARDWARE_KINDS), "hardware_limit").when(~kind.isin(*WORKLOAD_KINDS), "no_workload")
        .when(F.col("_name").isNull() | ~F.coalesce(F.col("_share") >= least_share, F.lit(False)), "no_leader").when(F.col("_lower").isin(*(x.lower() for x in excluded), ""), "excluded")
        .when(observing & ~clean, F.when(F.coalesce("n", F.lit(0)) == 0, "observer_unseen").otherwise("observer_busy")).when(~F.coalesce("_seen", F.lit(False)), "never_foreground").otherwise("user_workload")
    )
    label = F.when(F.col("_reason") == "hardware_limit", "real").when(F.col("_reason") == "user_workload", "normal")
    own = incidents.drop("auto_label", "auto_label_reason").columns
    return rows.withColumn("_reason", reason).withColumn("auto_label", F.coalesce("auto_label", label)).withColumn("auto_label_reason", F.col("_reason")).select(*own, "auto_label", "auto_label_reason")


def retention(rows: DataFrame, now: float, keep: float, watermarks: Sequence[float], faults: DataFrame, guard: float = 900.0) -> tuple[DataFrame, DataFrame]:
    """(kept, deletable): rows newer than ``keep`` seconds, not yet folded by the slowest rollup, or inside a fault (open ones to their planned end or now) and a guard around it, are kept."""
    until = F.coalesce("ts_end", "planned_end", F.lit(now)) if "planned_end" in faults.columns else F.coalesce("ts_end", F.lit(now))
    windows = intervals.union(faults.select("source", (F.col("ts_start") - guard).alias("lo"), (until + guard).alias("hi")), keep_empty=True)
    old = rows.where((F.col("ts") < now - keep) & (F.col("ts") < min(watermarks, default=now)))
    from .joins import in_spans

    deletable = in_spans(old, windows, how="left_anti")
    kept = rows.where((F.col("ts") >= now - keep) | (F.col("ts") >= min(watermarks, default=now))).unionByName(in_spans(old, windows, how="left_semi"))
    return kept, deletable


def label_now(log: DataFrame) -> DataFrame:
    """(source, id, user_label): the last answer of an append-only label log."""
    return log.groupBy("source", "id").agg(F.max_by("label", "labeled_at").alias("user_label"))
