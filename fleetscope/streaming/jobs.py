"""The same work on live streams: windows with watermarks, session windows, and per-key state."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollup import max3, mean3, std3


def rollup_stream(rows: DataFrame, value: str, size: str = "1 minute", late: str = "90 seconds", ts: str = "event_time") -> DataFrame:
    """Closed tumbling windows per source: a window is given out once the watermark has passed it; later rows are dropped and left to a backfill."""
    own = rows.withWatermark(ts, late).groupBy("source", F.window(ts, size)).agg(F.count(value).alias("sample_count"), mean3(value).alias("mean"), max3(value).alias("max"), std3(value).alias("std"))
    return own.select("source", F.col("window.start").cast("double").alias("bucket"), "sample_count", "mean", "max", "std")


def session_stream(signals: DataFrame, gap: str = "120 seconds", late: str = "15 seconds", ts: str = "event_time") -> DataFrame:
    """Incident sessions of signals; a session is given out when nothing more can join it."""
    own = signals.withWatermark(ts, late).groupBy("source", F.session_window(ts, gap)).agg(F.min(ts).cast("double").alias("ts_start"), F.max(ts).cast("double").alias("ts_end"), F.count("*").alias("signal_count"), F.max("score").alias("peak_score"))
    return own.drop("session_window")


def baseline_stream(samples: DataFrame, window: float = 1800.0, least: int = 60, hold: float = 30.0, k: float = 3.0, cooldown: float = 300.0, reset: float = 30.0, floor: float = 0.0, idle: float = 86_400.0) -> DataFrame:
    """Signals of values above median + k sigma for ``hold`` seconds, per (source, metric), with the window, the hold clock and the cooldown as state.

    A gap over ``reset`` seconds drops the clock. A late row joins the window at its place and fires nothing; one that is
    older than the window is dropped. The state of a key goes once the watermark, which trails by the window, has left its
    last row behind by ``idle`` seconds. A column ``warm``, where there is
    one, marks rows that fill the window only, so that a look-back read can warm a new stream up.
    """
    schema = "source string, metric string, ts double, value double, median double, sigma double"
    warm = F.coalesce("warm", F.lit(False)) if "warm" in samples.columns else F.lit(False)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t, x, since, fired = ([*map(list, state.get[:2]), *state.get[2:]]) if state.exists else ([], [], None, None)
        rows = pd.concat(list(batches)).dropna(subset=["ts", "value"]).sort_values("ts")
        out: list[tuple] = []
        for ts, value, filling in zip(rows["ts"].tolist(), rows["value"].tolist(), rows["warm"].tolist(), strict=True):
            late = bool(t) and ts < t[-1]
            if late and ts < t[-1] - window:
                continue
            if t and ts - t[-1] > reset:
                since = None
            at = bisect_right(t, ts)
            t.insert(at, ts)
            x.insert(at, value)
            first = bisect_left(t, t[-1] - window)
            del t[:first], x[:first]
            if late or filling:
                continue
            own = np.asarray(x)
            median = float(np.median(own))
            sigma = max(1.4826 * float(np.median(np.abs(own - median))), 0.05 * abs(median), floor)
            if len(x) < least or sigma <= 0 or value < median + k * sigma:
                since = None
                continue
            since = ts if since is None else since
            if ts - since >= hold and (fired is None or ts - fired >= cooldown):
                fired = ts
                out.append((*key, ts, value, median, sigma))
        if not t:
            return
        state.update((t, x, since, fired))
        state.setTimeoutTimestamp(max(int((t[-1] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "metric", "ts", "value", "median", "sigma"])

    own = samples.select("source", "metric", "ts", "value", warm.alias("warm"), F.timestamp_seconds("ts").alias("event_time"))
    grouped = own.withWatermark("event_time", f"{int(window)} seconds").groupBy("source", "metric")
    return grouped.applyInPandasWithState(run, schema, "t array<double>, x array<double>, since double, fired double", "append", GroupStateTimeout.EventTimeTimeout)


def for_each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs a batch transform on each micro-batch and appends its result under the batch's number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
