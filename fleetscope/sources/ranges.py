"""A table of folded time ranges with a log of commits, so that progress is stored with the rows and no range counts twice.

Each run writes the rows of one range of time into a folder of its own and then adds a commit to the log by a rename, which is
the only step that changes what readers see. A run that ends between the two leaves a folder that nobody reads; the next run
of the same range overwrites it. A later commit replaces earlier rows of its range, which is how a backfill works.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, root: str) -> list[dict]:
    """(number, lo, hi, rows) of every commit, in order; one small line for each run."""
    place, fs = _files(spark, f"{root}/_commits")
    if not fs.exists(place):
        return []
    rows = spark.read.schema("number long, lo double, hi double, rows long").json(f"{root}/_commits").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["number"])


def _commit(spark: SparkSession, root: str, entry: dict) -> None:
    """Adds a commit; an error if another run has taken its number."""
    draft, fs = _files(spark, f"{root}/_drafts/{entry['number']:08d}.json")
    final, _ = _files(spark, f"{root}/_commits/{entry['number']:08d}.json")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"commit {entry['number']} of {root} is taken by another run")


def watermark(spark: SparkSession, root: str) -> float | None:
    """The end of what has been folded; None for a new table."""
    return max((c["hi"] for c in commits(spark, root)), default=None)


def read(spark: SparkSession, root: str, schema: str, ts: str = "bucket") -> DataFrame:
    """The table as its commits have it: rows of committed runs that no later commit's range replaces."""
    log = commits(spark, root)
    rows = spark.read.schema(f"{schema}, run long").option("basePath", root)
    if not log:
        return spark.createDataFrame([], schema)
    parts = []
    for k, c in enumerate(log):
        later = [(d["lo"], d["hi"]) for d in log[k + 1 :] if d["lo"] < c["hi"] and d["hi"] > c["lo"]]
        replaced = [(F.col(ts) >= lo) & (F.col(ts) < hi) for lo, hi in later]
        own = F.col("run") == c["number"]
        parts.append(own & ~reduce(lambda a, b: a | b, replaced) if replaced else own)
    paths = [f"{root}/run={c['number']}" for c in log if c["rows"]]
    return rows.parquet(*paths).where(reduce(lambda a, b: a | b, parts)).drop("run") if paths else spark.createDataFrame([], schema)


def write(made: DataFrame, root: str, lo: float, hi: float, committing: Callable[[], None] = lambda: None) -> dict:
    """Writes ``made``, the rows of [lo, hi), and commits them. ``committing`` is called between the two."""
    spark = made.sparkSession
    number = len(commits(spark, root))
    path = f"{root}/run={number}"
    made.write.mode("overwrite").option("compression", "zstd").parquet(path)
    entry = {"number": number, "lo": lo, "hi": hi, "rows": spark.read.schema(made.schema).parquet(path).count()}
    committing()
    _commit(spark, root, entry)
    return entry


def fold_pending(raw: DataFrame, root: str, fold: Fold, size: float, upto: float, since: float = 0.0, ts: str = "ts", committing: Callable[[], None] = lambda: None) -> dict | None:
    """Folds the raw rows between the watermark (``since`` for a new table) and the last whole bucket before ``upto``, and commits; None if no bucket has ended since."""
    done = watermark(raw.sparkSession, root)
    lo, hi = since if done is None else done, upto // size * size
    if hi <= lo:
        return None
    return write(fold(raw.where((F.col(ts) >= lo) & (F.col(ts) < hi))), root, lo, hi, committing)


def refold(raw: DataFrame, root: str, fold: Fold, lo: float, hi: float, ts: str = "ts") -> dict:
    """Folds [lo, hi), whole buckets, again from the raw rows; the commit replaces what was there."""
    return write(fold(raw.where((F.col(ts) >= lo) & (F.col(ts) < hi))), root, lo, hi)


def compact(spark: SparkSession, root: str, schema: str, ts: str = "bucket") -> dict | None:
    """All committed rows as one run, so that the log's ranges need not be laid over each other any more; None for a table of fewer than two commits."""
    log = commits(spark, root)
    if len(log) < 2:
        return None
    return write(read(spark, root, schema, ts), root, min(c["lo"] for c in log), max(c["hi"] for c in log))
