"""Interval algebra over rows (keys, lo, hi). Every window and join carries the keys, so work spreads over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(spans: DataFrame, keys: Sequence[str] = ("source",), keep_empty: bool = False) -> DataFrame:
    """Merged spans; overlapping and touching ones become one, zero-length ones go unless ``keep_empty``."""
    own = spans.where(F.col("hi") >= F.col("lo") if keep_empty else F.col("hi") > F.col("lo"))
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    return marked.withColumn("_island", F.sum("_new").over(order)).groupBy(*keys, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def _days(df: DataFrame, lo: str, hi: str, size: float) -> DataFrame:
    """One row per ``size`` seconds that a span touches, so that overlap joins hash on (keys, cell)."""
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("source",), cell: float = 86_400.0, ends: bool = False) -> DataFrame:
    """Pairs of overlapping spans: left's columns, ``lo2``, ``hi2`` and right's other columns; each pair once, in the cell where the overlap starts. With ``ends`` touching spans overlap."""
    a = _days(left, "lo", "hi", cell)
    b = _days(right.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), "lo2", "hi2", cell)
    lo, hi, lo2, hi2 = map(F.col, ("lo", "hi", "lo2", "hi2"))
    met = a.join(b, [*keys, "_cell"]).where((lo <= hi2) & (hi >= lo2) if ends else (lo < hi2) & (hi > lo2))
    return met.where(F.floor(F.greatest("lo", "lo2") / cell) == F.col("_cell")).drop("_cell")


def intersection_seconds(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Seconds that two lists of merged spans share, per keys."""
    shared = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    return overlap_join(a, b, keys).groupBy(*keys).agg(F.sum(shared).alias("seconds"))


def complement(merged: DataFrame, span: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """What merged spans leave free of each span (keys, lo, hi)."""
    ends = span.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = overlap_join(span.select(*keys, "lo", "hi"), merged.select(*keys, "lo", "hi"), keys)
    blocks = met.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
    marks = blocks.unionByName(ends.select(*keys, "_lo", "_hi", F.col("_lo").alias("lo"), F.col("_lo").alias("hi"))).unionByName(ends.select(*keys, "_lo", "_hi", F.col("_hi").alias("lo"), F.col("_hi").alias("hi")))
    order = Window.partitionBy(*keys, "_lo", "_hi").orderBy("lo", "hi")
    free = marks.select(*keys, F.greatest(F.col("hi"), F.col("_lo")).alias("_from"), F.lead("lo").over(order).alias("_to"))
    return free.where(F.col("_to") > F.col("_from")).select(*keys, F.col("_from").alias("lo"), F.col("_to").alias("hi"))


def subtract(segments: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Each segment (keys, id, lo, hi) less all blocks: rows (keys, id, lo, hi)."""
    own = [*keys, "id"]
    cut = overlap_join(segments, union(blocks, keys), keys).select(*own, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"))
    return complement(cut, segments.select(*own, "lo", "hi"), own)


def touches_any(spans: DataFrame, others: DataFrame, keys: Sequence[str] = ("source",), how: str = "left_semi") -> DataFrame:
    """Spans (keys, id, lo, hi) that overlap another, ends included (``left_semi``), or that overlap none (``left_anti``)."""
    met = overlap_join(spans.select(*keys, "id", "lo", "hi"), others.select(*keys, "lo", "hi"), keys, ends=True).select(*keys, "id").distinct()
    return spans.join(met, [*keys, "id"], how)


def longest_overlap(spans: DataFrame, others: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """For each span (keys, id) the other (id2) that it overlaps longest; the earlier one on a tie."""
    met = overlap_join(spans, others.withColumnRenamed("id", "id2"), keys).withColumn("overlap_s", F.least("hi", "hi2") - F.greatest("lo", "lo2"))
    first = Window.partitionBy(*keys, "id").orderBy(F.desc("overlap_s"), "lo2", "id2")
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*keys, "id", "id2", "overlap_s")


def near_marks(points: DataFrame, marks: DataFrame, tolerance: float, keys: Sequence[str] = ("source",), how: str = "left_semi") -> DataFrame:
    """Points (keys, ts) within ``tolerance`` of a mark (keys, ts), or not (``left_anti``)."""
    cells = F.explode(F.array(*(F.floor(F.col("ts") / tolerance) + d for d in (-1, 0, 1))))
    b = marks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("ts").alias("_mark"), cells.alias("_cell"))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return points.join(b, [*same, F.floor(F.col("ts") / tolerance) == F.col("_cell"), F.abs(F.col("ts") - F.col("_mark")) <= tolerance], how)


def touched_buckets(spans: DataFrame, size: float, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Every bucket (keys, bucket) that a span touches, once."""
    cells = F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))
    return spans.select(*keys, F.explode(cells).alias("_cell")).select(*keys, (F.col("_cell") * size).alias("bucket")).distinct()


def outside(buckets: DataFrame, windows: DataFrame, size: float, column: str = "bucket", keys: Sequence[str] = ("source",)) -> DataFrame:
    """Buckets that overlap no window: ``column < hi`` and ``column > lo - size`` for none of them. Windows are laid out in cells of ``size``."""
    cells = F.explode(F.sequence(F.floor((F.col("lo") - size) / size), F.floor(F.col("hi") / size)))
    b = windows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), cells.alias("_cell"))
    same = [*(F.col(k) == F.col(f"_{k}") for k in keys), F.floor(F.col(column) / size) == F.col("_cell")]
    return buckets.join(b, [*same, F.col(column) < F.col("_hi"), F.col(column) > F.col("_lo") - size], "left_anti")


def islands(df: DataFrame, gap: float, keys: Sequence[str] = ("source",), ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Adds ``island``: a new one starts where more than ``gap`` passed since the row before."""
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    new = F.when(F.col(ts) - F.lag(ts).over(order) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order)).drop("_new")
