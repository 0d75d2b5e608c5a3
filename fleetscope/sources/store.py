"""Reading, exporting and snapshotting the telemetry tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import intervals
from ..operators.joins import in_spans, nearest
from ..schemas import FINDINGS, TABLES
from ..session import cut


def scan(spark: SparkSession, root: str, name: str, streaming: bool = False) -> DataFrame:
    """A table with its declared schema; columns that a file lacks read as null."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TABLES[name]).parquet(f"{root}/{name}")


def tail(spark: SparkSession, root: str, name: str, lag: str = "5 seconds", files: int = 100) -> DataFrame:
    """The live stream of a table: rows after the checkpoint, bounded per batch, with a watermark on ``event_time``."""
    rows = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files).parquet(f"{root}/{name}")
    return rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", lag)


def warm(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Exported days with the partition column restored; older files' missing columns are null."""
    return spark.read.schema(f"{schema}, date date").parquet(root)


def exported_days(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Dates there are, from the partitions alone; none where nothing has been exported."""
    try:
        return warm(spark, root, schema).select("date").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "date date")


def export_days(rows: DataFrame, done: DataFrame, root: str, today: str, after_days: int) -> DataFrame:
    """Writes the days that are old enough and not done yet, one partition a day, and returns (date, written, read) of these after a read back; equal counts allow a purge."""
    due = rows.withColumn("date", F.to_date(F.timestamp_seconds("ts"))).where(F.col("date") <= F.date_sub(F.lit(today).cast("date"), after_days)).join(done.select("date"), "date", "left_anti")
    written = cut(due.groupBy("date").agg(F.count("*").alias("written")))
    due.repartitionByRange("date", "source", "ts").sortWithinPartitions("date", "source", "ts").write.partitionBy("date").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    # A row for each day, so its dates prune the partitions that are read back.
    there = rows.sparkSession.read.schema(due.schema).parquet(root).join(F.broadcast(written.select("date")), "date", "left_semi").groupBy("date").agg(F.count("*").alias("read"))
    return written.join(there, "date")


def upsert(existing: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``new`` replaces rows of ``existing`` with its keys; a repeated run gives the same table."""
    one = new.dropDuplicates(list(keys))
    return one.unionByName(existing.join(one.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def pinned(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, list[str]]:
    """The files that each table consists of now; a table that is not there has None. Listing all before any is read makes one point in time of them."""
    out = {}
    for name in names:
        try:
            out[name] = scan(spark, root, name).inputFiles()
        except AnalysisException:
            out[name] = None
    return out


def export_findings(spark: SparkSession, root: str, out: str, listed: Callable[[], None] = lambda: None) -> DataFrame:
    """Copies the allowed tables as they are at one point in time and returns the manifest (table, row_count, missing, excluded_reason).

    Rows that are added while it runs, in files of their own, are in none of the copies. Tables that may not leave, and those that
    are not there, are told. ``listed`` is called between the listing and the first read.
    """
    files, manifest = pinned(spark, root, sorted(TABLES)), []
    listed()
    for name, own in files.items():
        if name not in FINDINGS or own is None:
            manifest.append((name, None, own is None, "raw or private" if name not in FINDINGS else None))
            continue
        rows = spark.read.schema(TABLES[name]).parquet(*own) if own else spark.createDataFrame([], TABLES[name])
        rows.write.mode("overwrite").parquet(f"{out}/{name}")
        manifest.append((name, spark.read.schema(TABLES[name]).parquet(f"{out}/{name}").count(), False, None))
    return spark.createDataFrame(manifest, "table string, row_count long, missing boolean, excluded_reason string")


def snapshot_windows(faults: DataFrame, span: DataFrame, guard: float, quiet_hours: float) -> DataFrame:
    """Merged fault windows with a guard, and the latest ``quiet_hours`` of time outside them (span: source, lo, hi)."""
    from pyspark.sql import Window

    injected = intervals.union(faults.select("source", (F.col("ts_start") - guard).alias("lo"), (F.coalesce("ts_end", "ts_start") + guard).alias("hi")), keep_empty=True)
    free = intervals.complement(injected, span)
    later = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("source").orderBy(F.desc("lo")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.lit(quiet_hours * 3600) - later
    quiet = free.withColumn("_left", left).where("_left > 0").select("source", F.greatest("lo", F.col("hi") - F.col("_left")).alias("lo"), "hi")
    return intervals.union(injected.unionByName(quiet))


def snapshot(rows: DataFrame, windows: DataFrame) -> DataFrame:
    return in_spans(rows, windows, how="left_semi")


def observations(metrics: DataFrame, processes: DataFrame, gpu: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """System ticks with the arrays ``processes`` and ``gpus`` of the nearest process and GPU tick within the tolerance."""
    parts = []
    for df, name in ((processes, "processes"), (gpu, "gpus")):
        inner = [c for c in df.columns if c not in ("source", "ts")]
        parts.append(df.groupBy("source", "ts").agg(F.sort_array(F.collect_list(F.struct(*inner))).alias(name)))
    out = metrics
    for part in parts:
        out = nearest(out, part, tolerance).drop("match_ts")
    return out


def label_log(spark: SparkSession, path: str, answers: DataFrame) -> DataFrame:
    """Appends answers (source, id, label, labeled_at) and returns the whole log; ``decide.label_now`` reads it."""
    answers.where(F.col("label").isin("normal", "real", "unknown")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
