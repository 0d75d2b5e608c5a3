"""Committed ranges over crashes, the tailing source, exports at one point in time, typed scans."""

import pytest
from pyspark.sql import functions as F

from fleetscope.schemas import FINDINGS, TABLES
from fleetscope.sources import ranges, store, tail

SCHEMA = "source string, bucket double, n long, total double"


def fold(raw):
    return raw.groupBy("source", (F.floor(F.col("ts") / 60) * 60).cast("double").alias("bucket")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def raw_rows(spark, lo, hi):
    return spark.createDataFrame([("h", float(t), float(t % 7)) for t in range(lo, hi)], "source string, ts double, v double")


def rows(df):
    return sorted(map(tuple, df.collect()))


class Killed(Exception):
    pass


def kill():
    raise Killed


def test_a_run_killed_between_write_and_commit_leaves_the_same_table(spark, tmp_path):
    root, raw = f"{tmp_path}/t", raw_rows(spark, 0, 1000)
    assert ranges.watermark(spark, root) is None and rows(ranges.read(spark, root, SCHEMA)) == []
    ranges.fold_pending(raw, root, fold, 60, 500.0)
    assert ranges.watermark(spark, root) == 480.0
    with pytest.raises(Killed):
        ranges.fold_pending(raw, root, fold, 60, 900.0, committing=kill)
    # What was written and not committed is not seen, and the next run writes it again.
    assert ranges.watermark(spark, root) == 480.0 and rows(ranges.read(spark, root, SCHEMA)) == rows(fold(raw.where("ts < 480")))
    assert ranges.fold_pending(raw, root, fold, 60, 970.0)["lo"] == 480.0
    assert ranges.fold_pending(raw, root, fold, 60, 1000.0) is None
    assert rows(ranges.read(spark, root, SCHEMA)) == rows(fold(raw.where("ts < 960")))


def test_a_backfill_replaces_its_range_and_compaction_keeps_the_rows(spark, tmp_path):
    root, raw = f"{tmp_path}/t", raw_rows(spark, 0, 600)
    ranges.fold_pending(raw, root, fold, 60, 300.0)
    ranges.fold_pending(raw, root, fold, 60, 600.0)
    more = raw.unionByName(raw_rows(spark, 100, 200))
    ranges.refold(more, root, fold, 60.0, 240.0)
    want = rows(fold(more))
    assert rows(ranges.read(spark, root, SCHEMA)) == want and ranges.watermark(spark, root) == 600.0
    ranges.compact(spark, root, SCHEMA)
    assert rows(ranges.read(spark, root, SCHEMA)) == want and len(ranges.commits(spark, root)) == 4
    ranges.refold(raw.where("ts > 1e9"), root, fold, 0.0, 120.0)
    assert rows(ranges.read(spark, root, SCHEMA)) == rows(fold(more.where("ts >= 120")))


def test_two_runs_of_one_range_commit_once(spark, tmp_path):
    root, raw = f"{tmp_path}/t", raw_rows(spark, 0, 600)
    other = lambda: ranges.fold_pending(raw, root, fold, 60, 300.0)
    with pytest.raises(RuntimeError):
        ranges.fold_pending(raw, root, fold, 60, 300.0, committing=other)
    assert rows(ranges.read(spark, root, SCHEMA)) == rows(fold(raw.where("ts < 300")))


def followed(spark, tmp_path, **options):
    stream = tail.tail_stream(spark, f"{tmp_path}/in", "ts double, v double, later string", **options)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(r["ts"] for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())


def test_the_tail_gives_each_row_once_after_its_lag_and_skips_a_long_gap(spark, tmp_path):
    raw_rows(spark, 0, 1000).drop("source").coalesce(2).write.parquet(f"{tmp_path}/in")
    own = {"since": "99", "lag": "10", "slice": "50", "skipafter": "400"}
    assert followed(spark, tmp_path, upto="310", **own) == [float(t) for t in range(100, 301)]
    # A restart goes on from the checkpoint.
    assert followed(spark, tmp_path, upto="410", **own) == [float(t) for t in range(100, 401)]
    # 490 seconds at once are a sleep: they are passed over, and what comes after is read.
    assert followed(spark, tmp_path, upto="900", **own)[-1] == 400.0
    assert followed(spark, tmp_path, upto="960", **own) == [*(float(t) for t in range(100, 401)), *(float(t) for t in range(891, 951))]


def test_an_export_does_not_show_what_is_added_while_it_runs(spark, tmp_path):
    def add(n):
        for name in ("anomaly_signals", "incident_signals", "metrics_raw"):
            one = spark.range(n).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], TABLES[name]).schema))
            one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/store/{name}")

    add(3)
    manifest = {r["table"]: r for r in store.export_findings(spark, f"{tmp_path}/store", f"{tmp_path}/out", listed=lambda: add(5)).collect()}
    assert (manifest["anomaly_signals"]["row_count"], manifest["incident_signals"]["row_count"]) == (3, 3)
    assert manifest["metrics_raw"]["excluded_reason"] == "raw or private" and manifest["incidents"]["missing"] and set(manifest) == set(TABLES)
    assert {n for n, r in manifest.items() if r["row_count"] is not None} < set(FINDINGS)
    assert store.scan(spark, f"{tmp_path}/store", "anomaly_signals").count() == 8


def test_scan_reads_a_table_by_its_declared_schema(spark, tmp_path):
    spark.createDataFrame([("h", 1.0)], "source string, ts double").write.parquet(f"{tmp_path}/metrics_raw")
    row = store.scan(spark, str(tmp_path), "metrics_raw").first()
    assert (row["source"], row["ts"], row["cpu_total"]) == ("h", 1.0, None)


def test_exported_days_are_written_once_and_read_back(spark, tmp_path):
    day, root = 86_400.0, f"{tmp_path}/warm"
    data = spark.createDataFrame([("h", k * day / 4, float(k)) for k in range(20)], "source string, ts double, v double")
    done = store.exported_days(spark, root, "source string, ts double, v double")
    first = store.export_days(data, done, root, "1970-01-05", 2).orderBy("date").collect()
    assert [(str(r["date"]), r["written"], r["read"]) for r in first] == [(f"1970-01-0{k}", 4, 4) for k in (1, 2, 3)]
    again = store.export_days(data, store.exported_days(spark, root, "source string, ts double, v double"), root, "1970-01-06", 2).collect()
    assert [(str(r["date"]), r["written"], r["read"]) for r in again] == [("1970-01-04", 4, 4)]
    assert store.warm(spark, root, "source string, ts double, v double, w double").where("w is null").count() == 16
