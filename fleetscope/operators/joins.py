"""Joins by time: nearest, backward as of, point in span, latest per key, and the closure of a parent relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def nearest(left: DataFrame, right: DataFrame, tolerance: float, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """Left rows with ``match_ts`` and right's columns of the nearest right time within ``tolerance``; the later one on a tie; nulls without one.

    Both sides hash on (keys, cell of the tolerance); a left row looks into its cell and both neighbours.
    """
    b = right.withColumnRenamed(ts, "match_ts").withColumn("_cell", F.explode(F.array(*(F.floor(F.col("match_ts") / tolerance) + d for d in (-1, 0, 1)))))
    a = left.withColumn("_row", F.monotonically_increasing_id()).withColumn("_cell", F.floor(F.col(ts) / tolerance))
    apart = F.abs(F.col(ts) - F.col("match_ts"))
    met = a.join(b, [*keys, "_cell"], "left").withColumn("_apart", F.when(apart <= tolerance, apart))
    own = [c for c in b.columns if c not in (*keys, "_cell")]
    best = Window.partitionBy("_row").orderBy(F.col("_apart").asc_nulls_last(), F.desc("match_ts"))
    one = met.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    for c in own:
        one = one.withColumn(c, F.when(F.col("_apart").isNotNull(), F.col(c)))
    return one.drop("_n", "_apart", "_row", "_cell")


def backward(left: DataFrame, right: DataFrame, value: str, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """Left rows with right's ``value`` at the last right time not after theirs; null before the first. One shuffle on the keys."""
    marks = right.select(*keys, F.col(ts).alias(ts), F.struct(value).alias("_value"), F.lit(0).alias("_side"))
    rows = left.withColumn("_value", F.lit(None).cast(marks.schema["_value"].dataType)).withColumn("_side", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_value", ignorenulls=True).over(order)).where("_side = 1").withColumn(value, F.col(f"_last.{value}")).drop("_value", "_side", "_last")


def in_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str] = ("source",), ts: str = "ts", how: str = "inner", cell: float = 3600.0) -> DataFrame:
    """Points inside spans (ends included), with the spans' columns for ``inner``; the spans are laid out in cells so that the join hashes."""
    b = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    if how in ("left_semi", "left_anti"):
        b = b.select(*(F.col(k).alias(f"_{k}") for k in keys), "lo", "hi", "_cell")
        same = [F.col(k) == F.col(f"_{k}") for k in keys]
        return points.join(b, [*same, F.floor(F.col(ts) / cell) == F.col("_cell"), F.col(ts) >= F.col("lo"), F.col(ts) <= F.col("hi")], how)
    return points.withColumn("_cell", F.floor(F.col(ts) / cell)).join(b, [*keys, "_cell"], how).where((F.col(ts) >= F.col("lo")) & (F.col(ts) <= F.col("hi"))).drop("_cell")


def latest(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The latest row of each key, whole."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), ts).alias("_r")).select("_r.*")


def latest_ties(df: DataFrame, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """All rows at each key's latest time."""
    return df.withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where("_n = 1").drop("_n")


def pending_lookups(names: DataFrame, info: DataFrame, most_attempts: int) -> DataFrame:
    """Distinct names without a description yet and with fewer than ``most_attempts`` tries."""
    known = info.groupBy("source", "name").agg(F.max_by(F.struct("description", "attempts"), "checked_at").alias("i"))
    left = names.select("source", "name").distinct().join(known, ["source", "name"], "left")
    return left.where(F.col("i.description").isNull() & (F.coalesce("i.attempts", F.lit(0)) < most_attempts)).select("source", "name")


def process_parents(starts: DataFrame, look_back: float | None = None) -> DataFrame:
    """Start events (source, pid, ppid, ts) with ``parent_ts``: when the instance of ``ppid`` that ran then had started; null if none is known.

    A pid is used again, so an instance is a pid and its start. With ``look_back`` a start so much earlier is no parent.
    """
    marks = starts.select("source", F.col("pid").alias("ppid"), "ts", F.col("ts").alias("parent_ts"))
    own = starts.where("ppid is not null and ppid <> pid")
    out = backward(own, marks, "parent_ts", ("source", "ppid"))
    near = F.col("parent_ts") if look_back is None else F.when(F.col("ts") - F.col("parent_ts") <= look_back, F.col("parent_ts"))
    alone = starts.where("ppid is null or ppid = pid").withColumn("parent_ts", F.lit(None).cast("double"))
    return out.withColumn("parent_ts", near).select(*starts.columns, "parent_ts").unionByName(alone)


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, root, pid, depth) of all processes below the roots (source, pid), by parent edges (source, ppid, pid); depth is the shortest.

    By doubling: who is a root's descendant within 2^k steps, and everyone's 2^k-th ancestor, give the same for 2^(k+1); so a
    chain of n takes log n joins. Cycles end once steps outnumber the processes.
    """
    up = cut(edges.select("source", F.col("pid").alias("node"), F.col("ppid").alias("above")).where("node <> above and above is not null").distinct())
    reached = cut(roots.select("source", F.col("pid").alias("root"), "pid", F.lit(0).alias("depth")).distinct())
    n, steps = up.count(), 1
    while steps <= max(n, 1) and not up.isEmpty():
        far = reached.withColumnRenamed("pid", "above").join(up, ["source", "above"])
        found = far.select("source", "root", F.col("node").alias("pid"), (F.col("depth") + steps).alias("depth"))
        reached = cut(reached.unionByName(found).groupBy("source", "root", "pid").agg(F.min("depth").alias("depth")))
        via = up.select("source", F.col("node").alias("above"), F.col("above").alias("top"))
        up = cut(up.join(via, ["source", "above"]).select("source", "node", F.col("top").alias("above")).where("node <> above").distinct())
        steps *= 2
    return reached


def to_dimension(facts: DataFrame, info: DataFrame, keys: Sequence[str] = ("source", "name")) -> DataFrame:
    """Facts with the dimension's columns; one dimension row per keys (the least by all columns), so the facts' grain stays."""
    one = info.groupBy(*keys).agg(F.min(F.struct(*[c for c in info.columns if c not in keys])).alias("_d")).select(*keys, "_d.*")
    return facts.join(one, list(keys), "left")
