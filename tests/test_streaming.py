"""Streams over files, held against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import baseline, decide, rollup
from fleetscope.streaming import jobs

START = 1_704_067_200


def run(stream, path, mode="append"):
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def fed(spark, tmp_path, parts, schema):
    """A stream that reads one file a micro-batch, in this order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={k}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_rollup_stream_equals_batch_and_drops_what_comes_after_the_watermark(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("h", float(START + k), float(v)) for k, v in enumerate(rng.normal(50, 5, 600))]
    end = [("h", float(START + 4000), 0.0)]
    late = [("h", float(START + 30), 1e6)]
    stream = fed(spark, tmp_path, [rows, end, late, [("h", float(START + 8000), 0.0)]], "source string, ts double, value double")
    got = run(jobs.rollup_stream(stream.withColumn("event_time", F.timestamp_seconds("ts")), "value"), tmp_path)
    want = spark.createDataFrame(rows, "source string, ts double, value double").groupBy("source", (F.floor(F.col("ts") / 60) * 60).cast("double").alias("bucket")).agg(F.count("value").alias("sample_count"), rollup.mean3("value").alias("mean"), rollup.max3("value").alias("max"), rollup.std3("value").alias("std"))
    key = lambda df: sorted(tuple(r) for r in df.select("source", "bucket", "sample_count", "mean", "max", "std").collect())
    assert key(got.where(F.col("bucket") < START + 600)) == key(want)


def test_session_stream_equals_fused_incidents(spark, tmp_path):
    rng = np.random.default_rng(1)
    times = START + np.cumsum(rng.choice([20, 60, 400], 80))
    rows = [("h", float(t), "a", float(k % 7) / 7) for k, t in enumerate(times)]
    far = [("h", float(times[-1] + 5000), "a", 0.0)]
    stream = fed(spark, tmp_path, [rows[:40], rows[40:], far], "source string, ts double, detector string, score double")
    got = run(jobs.session_stream(stream.withColumn("event_time", F.timestamp_seconds("ts"))), tmp_path)
    batch = decide.fold(decide.fuse(spark.createDataFrame(rows, "source string, ts double, detector string, score double").withColumn("severity", F.lit("info")), 120))
    key = lambda df: sorted(tuple(r) for r in df.select("ts_start", "ts_end", "signal_count", "peak_score").collect())
    assert key(got) == key(batch)


@pytest.mark.parametrize("parts", [1, 4])
def test_baseline_stream_equals_the_batch_baseline(spark, tmp_path, parts):
    rng = np.random.default_rng(2)
    values = rng.normal(50, 2, 400)
    values[300:360] += 60
    rows = [("h", "cpu", float(START + k), float(v), k < 100) for k, v in enumerate(values)]
    size = len(rows) // parts
    stream = fed(spark, tmp_path, [rows[k * size : (k + 1) * size] for k in range(parts)], "source string, metric string, ts double, value double, warm boolean")
    got = [(r["ts"], round(r["median"], 6), round(r["sigma"], 6)) for r in run(jobs.baseline_stream(stream, cooldown=20), tmp_path).orderBy("ts").collect()]
    made = baseline.rolling_dense(spark.createDataFrame(rows, "source string, metric string, ts double, value double, warm boolean"), keys=("source", "metric"))
    hot = made.where("value >= median + 3 * sigma and not warm")
    want = {r["ts"]: (round(r["median"], 6), round(r["sigma"], 6)) for r in hot.collect()}
    assert [t for t, *_ in got] == [START + 330, START + 350]
    assert all(want[t] == (m, s) for t, m, s in got)


def test_a_late_row_joins_the_window_and_fires_nothing(spark, tmp_path):
    rows = [("h", "cpu", float(START + k), 50.0 + k % 3) for k in range(100)]
    late = [("h", "cpu", START + 20.5, 1e9), ("h", "cpu", START - 1e6, 1e9)]
    after = [("h", "cpu", float(START + k), 90.0) for k in range(100, 140)]
    stream = fed(spark, tmp_path, [rows, late, after], "source string, metric string, ts double, value double")
    got = run(jobs.baseline_stream(stream), tmp_path).collect()
    assert [r["ts"] for r in got] == [START + 130]


def test_each_batch_replaces_itself(spark, tmp_path):
    stream = fed(spark, tmp_path, [[("h", 1.0)], [("h", 2.0)]], "source string, ts double")
    query = jobs.for_each_batch(stream, lambda df: df.groupBy("source").agg(F.sum("ts").alias("v")), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1.0, 2.0]
