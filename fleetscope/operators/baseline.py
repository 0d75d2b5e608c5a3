"""Rolling robust baselines: median, scaled MAD with floors, over trailing time windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import backward
from .order_stats import sorted_groups, window_stats


@dataclass(frozen=True)
class Baseline:
    """Window in seconds, samples needed, and the floors of sigma (absolute, and as a share of the median)."""

    window: float = 1800.0
    least_samples: int = 60
    floor: float = 0.0
    relative_floor: float = 0.05


def _middle(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def rolling(samples: DataFrame, value: str = "value", keys: Sequence[str] = ("source",), ts: str = "ts", config: Baseline = Baseline()) -> DataFrame:
    """Adds median, mad, sigma, samples, least, most over [ts - window, ts]. For windows of up to some 2000 samples; ``rolling_dense`` is for more."""
    frame = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-int(config.window), 0)
    held = samples.withColumn("median", F.expr(f"percentile({value}, 0.5)").over(frame)).withColumn("_list", F.collect_list(value).over(frame))
    held = held.withColumn("samples", F.count(value).over(frame)).withColumn("least", F.min(value).over(frame)).withColumn("most", F.max(value).over(frame))
    return with_sigma(held.withColumn("mad", _middle(F.transform("_list", lambda x: F.abs(x - F.col("median"))))).drop("_list"), config)


def sigma_of(median: Column, mad: Column, config: Baseline = Baseline()) -> Column:
    """The scaled MAD or the larger floor; null where that is not above 0."""
    sigma = F.greatest(mad * 1.4826, F.lit(float(config.floor)), F.abs(median) * config.relative_floor)
    return F.when(sigma > 0, sigma)


def with_sigma(df: DataFrame, config: Baseline = Baseline()) -> DataFrame:
    """Adds ``sigma`` from median and mad; null below the samples needed or where it is not above 0."""
    return df.withColumn("sigma", F.when(F.col("samples") >= config.least_samples, sigma_of(F.col("median"), F.col("mad"), config)))


def rolling_dense(samples: DataFrame, value: str = "value", keys: Sequence[str] = ("source",), ts: str = "ts", config: Baseline = Baseline(), chunk: float | None = None, judged: Column | None = None) -> DataFrame:
    """``rolling`` for dense series: each (keys, chunk of time) is one task's group, with the window before it looked back to.

    A chunk has six hours, and two windows at least, so that a row is looked back to once at most. All rows are learnt;
    with ``judged`` only those of which it is true come out.
    """
    chunk = max(6 * 3600.0, 2 * config.window) if chunk is None else chunk
    named = samples if judged is None else samples.withColumn("_judged", F.coalesce(judged, F.lit(False)))
    columns, some = samples.columns, judged is not None
    spread = named.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col(ts) / chunk), F.floor((F.col(ts) + config.window) / chunk))))
    dealt = spread.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", ts)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields] + ["median double", "mad double", "samples long", "least double", "most double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, (*keys, "_chunk")):
            t, x = (group.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (ts, value))
            here = np.floor(t / chunk) == group.column("_chunk")[0].as_py()
            if some:
                here &= group.column("_judged").to_numpy(zero_copy_only=False)
            mine = np.flatnonzero(here)
            if not len(mine):
                continue
            out, own = window_stats(t, x, config.window, mine), group.select(columns).take(pa.array(mine))
            none = out[:, 2] == 0
            for k, name in enumerate(("median", "mad", "samples", "least", "most")):
                own = own.append_column(name, pa.array(out[:, k].astype("int64")) if name == "samples" else pa.array(out[:, k], mask=none))
            yield from own.to_batches()

    return with_sigma(dealt.mapInArrow(run, schema), config)


def rolling_since(samples: DataFrame, since: float, value: str = "value", keys: Sequence[str] = ("source",), ts: str = "ts", config: Baseline = Baseline()) -> DataFrame:
    """``rolling_dense`` of the rows from ``since`` on, warmed up: the window before ``since`` is read back, so that the first rows have a full baseline."""
    return rolling_dense(samples.where(F.col(ts) >= since - config.window), value, keys, ts, config).where(F.col(ts) >= since)


def median_by(df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "median") -> DataFrame:
    """(keys, name): the median of each group. One shuffle and a sort, so that many small groups and a very large one cost alike."""
    own = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy(value)))
    return ranked.where((2 * F.col("_i")).between(F.col("_n"), F.col("_n") + 2)).groupBy(*keys).agg(F.avg(value).alias(name))


def z_score(value: Column, median: Column, sigma: Column) -> Column:
    return F.when(sigma > 0, (value - median) / sigma)


def threshold(median: Column, sigma: Column, k: float) -> Column:
    return F.when(sigma > 0, median + k * sigma)


def thinned(samples: DataFrame, spacing: float, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """Greedy thinning: a sample stays if ``spacing`` passed since the last that stayed."""
    kept = spaced(samples.select(*keys, ts).distinct(), spacing, keys, ts)
    return samples.join(kept, [*keys, ts], "left_semi")


def spaced(times: DataFrame, spacing: float, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """(keys, ts) kept by greedy spacing per key. Each task streams its keys' times in order and holds one batch and the last kept time."""
    own = times.select(*keys, F.col(ts).cast("double").alias(ts)).where(F.col(ts).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, -np.inf
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True))
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            t, kept = batch.column(len(keys)).to_numpy(), []
            for first, end in zip(starts, starts[1:], strict=False):
                if first == end:
                    continue
                if names[first] != key:
                    key, last = names[first], -np.inf
                at = first
                while at < end:
                    # The bisection may stop a rounding short of ``spacing``; the subtraction decides.
                    at += int(np.searchsorted(t[at:end], np.nextafter(last + spacing, -np.inf)))
                    while at < end and t[at] - last < spacing:
                        at += 1
                    if at < end:
                        kept.append(at)
                        last = t[at]
                        at += 1
            yield batch.take(pa.array(kept, pa.int64()))

    return own.repartition(*keys).sortWithinPartitions(*keys, ts).mapInArrow(run, own.schema)


def carried_stats(samples: DataFrame, learnt: DataFrame, value: str, keys: Sequence[str], config: Baseline, spacing: float = 0.0, ts: str = "ts") -> DataFrame:
    """``samples`` with median, mad, sigma, samples, least and most of ``learnt`` (keys, ts, value) as its last row not after theirs left them.

    Learnt rows closer than ``spacing`` seconds to the last that stayed are passed over; without a value a row teaches
    nothing. Below ``least_samples`` all but the count is null, so that an unready baseline decides nothing.
    """
    own = learnt.where(F.col(value).isNotNull()).select(*keys, ts, F.col(value).cast("double").alias("_learnt"))
    own = thinned(own, spacing, keys, ts) if spacing > 0 else own
    made = rolling_dense(own, "_learnt", keys, ts, config).dropDuplicates([*keys, ts])
    names = ("median", "mad", "sigma", "samples", "least", "most")
    ready = F.col("samples") >= config.least_samples
    found = made.select(*keys, ts, F.struct(*(F.col(n) if n == "samples" else F.when(ready, F.col(n)).alias(n) for n in names)).alias("_stats"))
    return backward(samples, found, "_stats", keys, ts).select(*samples.columns, *(F.col(f"_stats.{n}").alias(n) for n in names))


def conditional(samples: DataFrame, program: str = "program", value: str = "value", keys: Sequence[str] = ("source", "metric"), config: Baseline = Baseline(3600.0, 60), spacing: float = 0.0, usual: Baseline | None = None) -> DataFrame:
    """Baselines per program: a known program's own, as its last sample left it and null until it has samples enough; the metric's over ``usual`` for rows without a program."""
    known = samples.where(F.col(program).isNotNull())
    own = carried_stats(known, known, value, [*keys, program], config, spacing)
    plain = rolling_dense(samples, value, keys, config=usual or config, judged=F.col(program).isNull())
    return own.unionByName(plain.select(*own.columns))


def load_gated(samples: DataFrame, value: str, gate: str, least: float, keys: Sequence[str] = ("source",), config: Baseline = Baseline(6 * 3600.0, 60), spacing: float = 0.0) -> DataFrame:
    """The baseline learns ``value`` only under load and is carried to the other rows; null until ready, no fallback."""
    return carried_stats(samples, samples.where(F.col(gate) >= least), value, keys, config, spacing)


def observed_seconds(ticks: DataFrame, keys: Sequence[str] = ("source",), factor: float = 3.0) -> DataFrame:
    """Sum of the gaps that are no longer than ``factor`` times the median gap."""
    gaps = ticks.withColumn("_g", F.lead("ts").over(Window.partitionBy(*keys).orderBy("ts")) - F.col("ts")).where("_g is not null")
    median = median_by(gaps, keys, "_g", "_m")
    return gaps.join(median, list(keys)).groupBy(*keys).agg(F.sum(F.when(F.col("_g") <= factor * F.col("_m"), F.col("_g"))).alias("seconds"))
