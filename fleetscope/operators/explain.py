"""Explanation of incidents: onset and recovery, bottleneck, contributors, lead time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import attributable, group_key, incident_report, incident_title
from ..session import cut, written
from .baseline import Baseline, median_by
from .joins import in_spans

# Kinds in the order that breaks ties, and the kind that a trigger metric speaks for.
KINDS = ("CPU", "IO", "MEMORY", "GPU", "THERMAL", "CONTENTION")
METRIC_KIND: Mapping[str, str] = {"cpu_total": "CPU", "cpu_max_core": "CPU", "disk_resp_ms": "IO", "disk_queue": "IO", "mem_percent": "MEMORY", "mem_used_mb": "MEMORY", "swap_used_mb": "MEMORY", "gpu_util_percent": "GPU", "gpu_temp_c": "THERMAL", "ctx_switches_ps": "CONTENTION"}


def onset(samples: DataFrame, calm_run: int = 15, least_hot: int = 3, k: float = 2.0, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """Per key the earliest hot sample (value at least median + k sigma) before ``calm_run`` calm ones in a row, looking back from ``signal_ts``; none with fewer than ``least_hot`` hot samples."""
    back = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    own = samples.where(F.col("ts") <= F.col("signal_ts")).withColumn("_hot", F.col("value") >= F.col("median") + k * F.col("sigma")).where("_hot is not null")
    runs = own.withColumn("_run", F.sum(F.col("_hot").cast("int")).over(back))
    counted = runs.withColumn("_calm", F.sum(F.when(~F.col("_hot"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_run").orderBy(F.desc("ts"))))
    stop = counted.withColumn("_stopped", F.max(F.when(F.col("_calm") >= calm_run, 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    return stop.where("_stopped = 0 and _hot").groupBy(*keys).agg(F.min("ts").alias("onset"), F.count("*").alias("hot")).where(F.col("hot") >= least_hot)


def recovery(samples: DataFrame, calm_run: int = 5, k: float = 2.0, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """Per key the time at which the first ``calm_run`` calm samples in a row after ``signal_ts`` are complete."""
    order = Window.partitionBy(*keys).orderBy("ts")
    own = samples.where(F.col("ts") >= F.col("signal_ts")).withColumn("_hot", F.col("value") >= F.col("median") + k * F.col("sigma")).where("_hot is not null")
    runs = own.withColumn("_run", F.sum(F.col("_hot").cast("int")).over(order)).where("not _hot").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("ts")))
    return runs.where(F.col("_n") == calm_run).groupBy(*keys).agg(F.min("ts").alias("recovery"))


#: Metrics that can tell where an incident began and ended, in the order that breaks ties.
BOUND_METRICS = ("cpu_total", "mem_percent", "disk_resp_ms", "disk_queue", "ctx_switches_ps")


def _middle(values: np.ndarray) -> float:
    """Median of sorted values; NaN is the largest, as in SQL."""
    return float(values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def _limit(prior: np.ndarray, least: int, k: float = 2.0) -> float | None:
    """Median + k sigma of the values before an incident; none with fewer than ``least`` or without a sigma above 0."""
    if len(prior) < max(least, 1):
        return None
    median, usual = _middle(np.sort(prior)), Baseline()
    sigma = float(np.max([_middle(np.sort(np.abs(prior - median))) * 1.4826, usual.floor, abs(median) * usual.relative_floor]))
    return None if sigma <= 0 else median + k * sigma


def _calm(t: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calm samples since the last time with a hot one, up to each sample and up to the end of its time; samples of one time are met together."""
    ends = np.append(t[1:] != t[:-1], True)
    end = np.flatnonzero(ends)[np.cumsum(ends) - ends]
    hots, calm = np.cumsum(hot)[end], np.cumsum(~hot)
    before = np.append(0, calm[end][:-1])
    base = np.maximum.accumulate(np.where(np.diff(hots, prepend=0) > 0, before, 0))
    return calm - base, calm[end] - base


def _onset(t: np.ndarray, hot: np.ndarray, calm_run: int, least_hot: int) -> float | None:
    """``onset`` of one incident's samples, by rising time."""
    t, hot = t[::-1], hot[::-1]
    if not hot.any():
        return None
    stopped = np.flatnonzero(_calm(t, hot)[1] >= calm_run)
    own = np.flatnonzero(hot[: stopped[0]] if len(stopped) else hot)
    return float(t[own[-1]]) if len(own) >= max(least_hot, 1) else None


def _recovery(t: np.ndarray, hot: np.ndarray, calm_run: int) -> float | None:
    """``recovery`` of one incident's samples, by rising time."""
    if not len(t):
        return None
    done = np.flatnonzero(~hot & (_calm(t, hot)[0] == calm_run))
    return float(t[done[0]]) if len(done) else None


def refined_bounds(incidents: DataFrame, metrics: DataFrame, columns: Sequence[str] = BOUND_METRICS, before: float = 300.0, after: float = 600.0, look_back: float = 1800.0, least: int = 60, calm_run: int = 15, least_hot: int = 3, calm_after: int = 5) -> DataFrame:
    """(source, id, start, end): over all metrics the widest span from onset to recovery within the margins; the incident's own where none is wider.

    What counts as usual is fixed by the time before the incident, so that a long one does not raise its own limit. A metric
    that tells only where the incident began, or only where it ended, keeps the incident's other bound.

    Incidents are dealt by source and chunk of time, by their starts and then by their ends, and samples to the chunks that
    need them, two or three times each; no sample is copied to every incident that holds it, and none for what lies inside a long one.
    """
    own = [c for c in columns if c in metrics.columns]
    back = max(look_back, before)
    chunk = max(back, after, 1.0)
    spans = incidents.select("source", "id", F.col("ts_start").cast("double").alias("ts_start"), F.coalesce("ts_end", "ts_start").cast("double").alias("ts_end"))
    samples = metrics.select("source", F.col("ts").cast("double").alias("ts"), *(F.col(c).cast("double").alias(c) for c in own))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    told = f"source {kinds['source']}, id {kinds['id']}, ts_start double, ts_end double, limits array<double>, onsets array<double>"
    names = ("source", "id", "ts_start", "ts_end")

    def dealt(df: DataFrame, at: str, lo: Column, hi: Column):
        """``df`` by chunk of ``at``, beside the samples between the least ``lo`` and the largest ``hi`` of each chunk."""
        by = df.withColumn("_chunk", F.floor(F.col(at) / chunk))
        needs = by.groupBy("source", F.col("_chunk").alias("_part")).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).where("lo <= hi")
        met = in_spans(samples, needs, cell=chunk).drop("lo", "hi")
        return by.groupBy("source", "_chunk").cogroup(met.groupBy("source", "_part"))

    def series(points: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """Times and values of each metric by rising time, without nulls."""
        points = points.sort_by("ts")
        kept = [points.filter(pc.is_valid(points.column(c))) for c in own]
        return [(p.column("ts").to_numpy(), p.column(c).to_numpy()) for p, c in zip(kept, own, strict=True)]

    def part(t: np.ndarray, x: np.ndarray, lo: float, hi: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Times from ``lo`` to ``hi`` and whether they are hot."""
        a, b = np.searchsorted(t, lo), np.searchsorted(t, hi, "right")
        return t[a:b], (x[a:b] >= limit) | np.isnan(x[a:b])

    def begin(spans: pa.Table, points: pa.Table) -> pa.Table:
        """Each metric's limit and onset."""
        held, limits, onsets = series(points), [], []
        for start, end in zip(*(spans.column(c).to_pylist() for c in names[2:]), strict=True):
            mine = [None if start is None else _limit(x[np.searchsorted(t, start - look_back) : np.searchsorted(t, start)], least) for t, x in held]
            limits.append(mine)
            onsets.append([None if limit is None else _onset(*part(t, x, start - before, min(start, end + after), limit), calm_run, least_hot) for (t, x), limit in zip(held, mine, strict=True)])
        kind = pa.list_(pa.float64())
        return spans.select(names).append_column("limits", pa.array(limits, kind)).append_column("onsets", pa.array(onsets, kind))

    def finish(spans: pa.Table, points: pa.Table) -> pa.Table:
        """The widest span of all metrics; the first of ``columns`` on a tie."""
        held, starts, ends = series(points), [], []
        for who, start, end, limits, onsets in zip(*(spans.column(c).to_pylist() for c in (*names[1:], "limits", "onsets")), strict=True):
            best = (start, end)
            for (t, x), limit, first in zip(held, limits, onsets, strict=True):
                if who is None or limit is None:
                    continue
                last = _recovery(*part(t, x, max(end, start - before), end + after, limit), calm_after)
                lo, hi = start if first is None else first, end if last is None else last
                if hi - lo > best[1] - best[0]:
                    best = (lo, hi)
            starts.append(best[0])
            ends.append(best[1])
        return spans.select(["source", "id"]).append_column("start", pa.array(starts, pa.float64())).append_column("end", pa.array(ends, pa.float64()))

    begun = dealt(spans, "ts_start", F.col("ts_start") - back, F.col("ts_start")).applyInArrow(begin, told)
    # Read twice below, for the incidents and for what their chunks need.
    begun = written(begun, "bounds-begun")
    return dealt(begun, "ts_end", F.col("ts_end"), F.col("ts_end") + after).applyInArrow(finish, f"source {kinds['source']}, id {kinds['id']}, start double, `end` double")


def peak_and_prior(incidents: DataFrame, metrics: DataFrame, columns: list[str], peak_by: str = "cpu_total", look_back: float = 1800.0) -> DataFrame:
    """Per incident the whole row with the largest ``peak_by`` inside it, and median and sigma of each column over the time before it."""
    own = incidents.select("source", "id", F.col("ts_start").alias("start"), F.coalesce("ts_end", "ts_start").alias("end"))
    inside = in_spans(metrics, own.withColumnsRenamed({"start": "lo", "end": "hi"}))
    peak = inside.groupBy("source", "id").agg(F.max_by(F.struct("ts", *columns), peak_by).alias("_p")).select("source", "id", F.col("_p.ts").alias("peak_ts"), *(F.col(f"_p.{c}").alias(c) for c in columns))
    prior = in_spans(metrics, own.select("source", "id", (F.col("start") - look_back).alias("lo"), F.col("start").alias("hi"))).where("ts < hi")
    medians = prior.groupBy("source", "id").agg(*(F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median") for c in columns))
    spread = prior.join(medians, ["source", "id"]).groupBy("source", "id", *(f"{c}_median" for c in columns)).agg(*(F.expr(f"percentile(abs({c} - {c}_median), 0.5)").alias(f"{c}_mad") for c in columns))
    out = peak.join(spread, ["source", "id"], "left")
    for c in columns:
        sigma = F.greatest(F.col(f"{c}_mad") * 1.4826, F.abs(f"{c}_median") * 0.05)
        out = out.withColumn(f"{c}_z", F.when(sigma > 0, (F.col(c) - F.col(f"{c}_median")) / sigma)).drop(f"{c}_mad")
    return out


def with_gpu(peaks: DataFrame, incidents: DataFrame, gpu: DataFrame) -> DataFrame:
    """``peaks`` with gpu_util_percent, gpu_temp_c and throttle_reasons of device 0's busiest sample inside each incident, the earliest on a tie.

    Incidents without a peak row are kept if the device has a sample in them.
    """
    spans = incidents.select("source", "id", F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    met = in_spans(gpu.where("gpu_index = 0 and util_percent is not null").select("source", "ts", "util_percent", "temp_c", F.col("throttle_reasons").cast("string").alias("throttle_reasons")), spans)
    busiest = F.max_by(F.struct(F.col("util_percent").alias("gpu_util_percent"), F.col("temp_c").alias("gpu_temp_c"), "throttle_reasons"), F.struct("util_percent", -F.col("ts"))).alias("_g")
    return peaks.join(met.groupBy("source", "id").agg(busiest), ["source", "id"], "full_outer").select(*peaks.columns, "_g.*")


def _points(*terms: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for condition, points in terms:
        out = out + F.when(condition, points).otherwise(0.0)
    return out


def classify(peaks: DataFrame) -> DataFrame:
    """Adds ``scores`` (kind and points, best first, ties in the order of ``KINDS``) and ``bottleneck`` (NONE without any evidence)."""
    c = lambda name: F.col(name) if name in peaks.columns else F.lit(None).cast("double")
    cpu, cpu_z, resp, queue, mem = c("cpu_total"), c("cpu_total_z"), c("disk_resp_ms"), c("disk_queue"), c("mem_percent")
    hot = F.coalesce(F.upper(c("throttle_reasons").cast("string")).contains("THERMAL"), F.lit(False))
    points = {
        "CPU": F.when(cpu >= 70, F.lit(0.5) + F.when(cpu_z >= 3, 0.3).otherwise(0.0)).when((cpu_z >= 3) & (cpu >= 40), 0.4).otherwise(0.0),
        "IO": F.when((c("disk_resp_ms_z") >= 3) & (resp >= 5), F.lit(0.5) + F.when(queue >= 2, 0.3).otherwise(0.0)).when(queue >= 4, 0.4).otherwise(0.0),
        "MEMORY": _points((mem >= 85, 0.5), ((c("swap_used_mb") > 0) & (mem >= 60), 0.3), ((c("mem_percent_z") >= 3) & (mem >= 60), 0.3)),
        "GPU": _points((c("gpu_util_percent") >= 90, 0.6)),
        "THERMAL": _points((hot, 0.7), (c("cpu_perf_percent") < 80, 0.3), ((c("gpu_temp_c") >= 80) & (c("cpu_perf_percent") < 80), 0.2)),
        "CONTENTION": _points(((c("ctx_switches_ps_z") >= 3) & (cpu < 60), 0.5)),
    }
    all_ = F.array(*(F.struct(points[k].alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)))
    ranked = peaks.withColumn("scores", F.sort_array(F.filter(all_, lambda s: s["score"] > 0), asc=False))
    return ranked.withColumn("bottleneck", F.coalesce(F.get("scores", F.lit(0))["kind"], F.lit("NONE")))


def choose_kind(classified: DataFrame, trigger: str = "trigger_metric", ratio: float = 1.5, margin: float = 0.3) -> DataFrame:
    """Keeps the trigger metric's kind unless the best has ``ratio`` times its points and ``margin`` more; says in ``overridden_from`` what gave way."""
    kinds = F.create_map(*(F.lit(x) for pair in METRIC_KIND.items() for x in pair))
    own = F.element_at(kinds, F.col(trigger))
    points = F.coalesce(F.get(F.filter("scores", lambda s: s["kind"] == own), F.lit(0))["score"], F.lit(0.0))
    top = F.get("scores", F.lit(0))
    beaten = own.isNull() | ((top["score"] >= ratio * points) & (top["score"] >= points + margin) & (top["kind"] != own))
    return classified.withColumn("bottleneck", F.when(beaten, F.col("bottleneck")).otherwise(own)).withColumn("overridden_from", F.when(beaten & own.isNotNull() & top.isNotNull(), own))


#: Kinds that a detector's claim wins over: the machine as a whole shows nothing, or nothing that names a resource.
CLAIM_WINS_OVER = ("NONE", "CONTENTION")
#: What a claim's metric and a bottleneck's kind are traced by.
CLAIM_RESOURCE: Mapping[str, str] = {"handles": "handles", "rss_mb": "memory"}
KIND_RESOURCE: Mapping[str, str] = {"IO": "io", "MEMORY": "memory"}
# What a bottleneck is called.
KIND_LABELS: Mapping[str, str] = {"CPU": "CPU saturated", "IO": "disk waits", "MEMORY": "memory short", "GPU": "GPU saturated", "THERMAL": "thermal throttling", "CONTENTION": "contention", "NONE": "no bottleneck"}


def detector_claim(incident_signals: DataFrame, signals: DataFrame) -> DataFrame:
    """(source, incident_id, claim, triggers): metric, process, explanation, duration and time of the incident's best signal about a process's
    resource (the earliest of equals; null without one), and the rules that fired, in order of their first signal."""
    said = signals.select("source", "ts", "detector", F.col("score").alias("s"), "metric", "process", "explanation", "duration_s", F.coalesce("rules", F.array().cast("array<string>")).alias("rules") if "rules" in signals.columns else F.array().cast("array<string>").alias("rules"))
    met = incident_signals.select("source", "incident_id", "ts", "detector").join(said, ["source", "ts", "detector"])
    best = F.max_by(F.struct("metric", "process", "explanation", "duration_s", F.col("ts").alias("at")), F.when(F.col("metric").isin(*CLAIM_RESOURCE), F.struct(F.coalesce("s", F.lit(0.0)), -F.col("ts")))).alias("claim")
    names = met.select("source", "incident_id", "ts", F.posexplode("rules").alias("place", "rule")).groupBy("source", "incident_id", "rule").agg(F.min(F.struct("ts", "place")).alias("first"))
    triggers = names.groupBy("source", "incident_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rule"))), lambda r: r["rule"]).alias("triggers"))
    return met.groupBy("source", "incident_id").agg(best).join(triggers, ["source", "incident_id"], "left").withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))


def resource_of(kind: Column, claim_wins: Column, metric: Column) -> Column:
    """The resource that an incident's contributors are found by: the claim's if it wins, else the bottleneck's, else the CPU."""
    lookup = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.when(claim_wins, F.element_at(lookup(CLAIM_RESOURCE), metric)).otherwise(F.coalesce(F.element_at(lookup(KIND_RESOURCE), kind), F.lit("cpu")))


def evidence_lines(peaks: DataFrame, columns: Sequence[str]) -> Column:
    """A line for each metric that stands three sigmas or more from what was usual, farthest first: ``metric usual -> value (z sigma)``."""
    lines = [F.when(F.abs(F.col(f"{c}_z")) >= 3, F.struct(-F.abs(F.col(f"{c}_z")), F.format_string("%s %.1f -> %.1f (%.1f sigma)", F.lit(c), F.col(f"{c}_median"), F.col(c).cast("double"), F.col(f"{c}_z")).alias("line"))) for c in columns]
    return F.transform(F.array_sort(F.array_compact(F.array(*lines))), lambda x: x["line"]) if lines else F.array().cast("array<string>")


def _shares(deltas: DataFrame, top: int) -> DataFrame:
    positive = deltas.where("delta > 0")
    total = F.sum("delta").over(Window.partitionBy("source", "id"))
    order = Window.partitionBy("source", "id").orderBy(F.desc("delta"), "name")
    return positive.withColumn("share", F.col("delta") / total).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Seconds of incident starts that a task takes at once, as a share of the time that an incident looks back.
CHUNK_SHARE = 0.5
FLOW_COLUMNS = "name string, delta double, after double, pids array<{pid}>, is_new boolean, share double, rank int"


class _FlowChunk:
    """The rows of the incidents of a chunk, laid out so that each incident costs a few passes over them."""

    def __init__(self, rows: pa.Table):
        codes, values = {}, {}
        for c in ("key", "pid"):
            encoded = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
            order = pc.array_sort_indices(encoded.dictionary, null_placement="at_start").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            codes[c], values[c] = place[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(order)).to_pylist()
        self.names, self.pids = values["key"], values["pid"]
        t, x = (rows.column(c).to_numpy() for c in ("ts", "value"))
        order = np.lexsort((x, codes["pid"], codes["key"]))
        key, pid, self.t, self.x = codes["key"][order], codes["pid"][order], t[order], x[order]
        new = np.append(True, (key[1:] != key[:-1]) | (pid[1:] != pid[:-1]))
        #: Each row's process and each process's name, rising; rows of a process rise by value.
        self.process, self.key, self.pid = np.cumsum(new) - 1, key[new], pid[new]
        self.by_time = np.argsort(self.t, kind="stable")
        self.times = self.t[self.by_time]

    def top(self, start: float, end: float, before: tuple[float, float], top: int) -> list[tuple]:
        n = len(self.key)
        own = self.by_time[np.searchsorted(self.times, start) : np.searchsorted(self.times, end, "right")]
        counts = np.bincount(self.process[own], minlength=n)
        after = np.bincount(self.process[own], self.x[own], n) / np.maximum(counts, 1)
        prior = np.flatnonzero((self.t >= start - before[0]) & (self.t < start - before[1]))
        sizes = np.bincount(self.process[prior], minlength=n)
        known = np.flatnonzero(sizes)
        first, values, usual = (np.cumsum(sizes) - sizes)[known], self.x[prior], np.zeros(n)
        usual[known] = (values[first + (sizes[known] - 1) // 2] + values[first + sizes[known] // 2]) / 2
        sums = np.bincount(self.key, after, len(self.names))
        delta = sums - np.bincount(self.key, usual, len(self.names))
        grown = np.flatnonzero(delta > 0)
        total = float(delta[grown].sum())
        if len(grown) > top:
            grown = grown[delta[grown] >= np.partition(delta[grown], len(grown) - top)[len(grown) - top]]
        out = []
        for rank, k in enumerate(grown[np.lexsort((grown, -delta[grown]))][:top].tolist(), 1):
            a, b = np.searchsorted(self.key, k), np.searchsorted(self.key, k, "right")
            seen = counts[a:b] > 0
            out.append((self.names[k], float(delta[k]), float(sums[k]) if seen.any() else None, [p for p in (self.pids[i] for i in np.unique(self.pid[a:b][seen])) if p is not None], not sizes[a:b].any(), float(delta[k]) / total, rank))
        return out


def flow_contributors(incidents: DataFrame, processes: DataFrame, value: str, before: tuple[float, float] = (210.0, 30.0), top: int = 8, longest: float = 86_400.0) -> DataFrame:
    """(source, id, name, delta, after, pids, is_new, share, rank): growth of a flow (CPU, IO) by program: mean in the incident less the median before, summed over pids.

    Incidents are dealt by source and chunk of their start, and rows to the chunks that need them, a few times each; no row is
    copied to every incident that holds it. Incidents of more than ``longest`` seconds go row by row through the shuffle.
    """
    chunk = before[0] * CHUNK_SHARE
    rows = processes.select("source", "ts", "pid", "name", F.col(value).cast("double").alias("value")).where("ts is not null and value is not null")
    own = incidents.select("source", "id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    short = F.coalesce(F.col("end") - F.col("start") <= longest, F.lit(False))
    dealt = own.where(short).withColumn("_chunk", F.floor(F.col("start") / chunk))
    needs = dealt.groupBy("source", F.col("_chunk").alias("_part")).agg((F.min("start") - before[0]).alias("lo"), F.max(F.greatest("end", F.col("start") - before[1])).alias("hi"))
    # A pid and what it goes by tell a process as well as pid and name do.
    named = rows.select("source", "ts", "pid", group_key(F.col("name"), F.col("pid")).alias("key"), "value")
    met = in_spans(named, needs).select("source", "_part", "ts", "pid", "key", "value")
    pid, kinds = met.schema["pid"].dataType.simpleString(), {f.name: f.dataType.simpleString() for f in own.schema.fields}
    schema = f"source {kinds['source']}, id {kinds['id']}, " + FLOW_COLUMNS.format(pid=pid)

    def run(spans: pa.Table, points: pa.Table) -> pa.Table:
        spans = spans.sort_by([("start", "ascending"), ("end", "ascending")])
        held, at, found, out = _FlowChunk(points) if len(points) and len(spans) else None, None, [], []
        for source, who, start, end in zip(*(spans.column(c).to_pylist() for c in ("source", "id", "start", "end")), strict=True):
            if held is not None and (start, end) != at:
                at, found = (start, end), held.top(start, end, before, top)
            out += [(source, who, *f) for f in found]
        kinds = pa.schema([spans.schema.field("source"), spans.schema.field("id"), ("name", pa.string()), ("delta", pa.float64()), ("after", pa.float64()), ("pids", pa.list_(points.schema.field("pid").type)), ("is_new", pa.bool_()), ("share", pa.float64()), ("rank", pa.int32())])
        return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    made = dealt.groupBy("source", "_chunk").cogroup(met.groupBy("source", "_part")).applyInArrow(run, schema)
    rest = own.where(~short)
    if rest.isEmpty():
        return made
    return made.unionByName(_flow_by_rows(rest, rows, before, top).select(*made.columns))


def _flow_by_rows(own: DataFrame, rows: DataFrame, before: tuple[float, float], top: int) -> DataFrame:
    """``flow_contributors`` with a copy of each row for each incident that holds it."""
    prior = in_spans(rows, own.select("source", "id", (F.col("start") - before[0]).alias("lo"), (F.col("start") - before[1]).alias("hi"))).where("ts < hi")
    now = in_spans(rows, own.select("source", "id", F.col("start").alias("lo"), F.col("end").alias("hi")))
    old = median_by(prior, ("source", "id", "pid", "name"), name="b").withColumn("a", F.lit(None).cast("double"))
    new = now.groupBy("source", "id", "pid", "name").agg(F.avg("value").alias("a")).withColumn("b", F.lit(None).cast("double"))
    both = old.unionByName(new).groupBy("source", "id", "pid", "name").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    keyed = both.withColumn("name", group_key(F.col("name"), F.col("pid"))).groupBy("source", "id", "name")
    sums = keyed.agg((F.sum(F.coalesce("a", F.lit(0.0))) - F.sum(F.coalesce("b", F.lit(0.0)))).alias("delta"), F.sum("a").alias("after"), F.array_sort(F.collect_set(F.when(F.col("a").isNotNull(), F.col("pid")))).alias("pids"), (F.max("b").isNull()).alias("is_new"))
    return _shares(sums, top)


def stock_contributors(incidents: DataFrame, processes: DataFrame, value: str, look_back: float = 210.0, top: int = 8) -> DataFrame:
    """``flow_contributors`` for stocks (memory, handles): last-quarter median less first-quarter median per pid, from the last fall below half of the peak on."""
    own = incidents.select("source", "id", (F.col("start") - look_back).alias("lo"), F.col("end").alias("hi"))
    rows = in_spans(processes.select("source", "ts", "pid", "name", F.col(value).cast("double").alias("value")), own)
    order = Window.partitionBy("source", "id", "pid", "name").orderBy("ts")
    peak = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    track = rows.withColumn("_t", F.sum(F.when(F.col("value") < 0.5 * peak, 1).otherwise(0)).over(order))
    last = track.withColumn("_last", F.max("_t").over(Window.partitionBy("source", "id", "pid", "name"))).where("_t = _last")
    n, i = F.count("*").over(Window.partitionBy("source", "id", "pid", "name")), F.row_number().over(order)
    q = F.greatest(F.floor(n / 4), F.lit(1))
    marked = last.withColumn("_first", i <= q).withColumn("_end", i > n - q)
    growth = marked.groupBy("source", "id", "pid", "name").agg(F.expr("percentile(CASE WHEN _end THEN value END, 0.5)").alias("after"), F.expr("percentile(CASE WHEN _first THEN value END, 0.5)").alias("b"))
    keyed = growth.withColumn("name", group_key(F.col("name"), F.col("pid"))).groupBy("source", "id", "name")
    # To the billionth: the order in which pids are added must not rank programs that grew alike.
    sums = keyed.agg(F.round(F.sum(F.greatest(F.col("after") - F.col("b"), F.lit(0.0))), 9).alias("delta"), F.sum("after").alias("after"), F.array_sort(F.collect_set("pid")).alias("pids"), F.lit(False).alias("is_new"))
    return _shares(sums, top)


def lead_time(contributors: DataFrame, incidents: DataFrame, processes: DataFrame, value: str, around: float = 300.0, share: float = 0.1) -> DataFrame:
    """(source, id, name, lead_s): seconds from when the contributor's sum first reached its level before plus a tenth of its growth to the onset; null if it stood there at the first sample."""
    spans = incidents.select("source", "id", "start", (F.col("start") - around).alias("lo"), (F.col("start") + around).alias("hi"))
    rows = in_spans(processes.select("source", "ts", "pid", F.col(value).cast("double").alias("value")), spans)
    own = contributors.select("source", "id", F.col("name").alias("contributor"), F.explode("pids").alias("pid"), (F.col("after") - F.col("delta") + share * F.col("delta")).alias("level"))
    sums = rows.join(own, ["source", "id", "pid"]).groupBy("source", "id", "contributor", "start", "level", "ts").agg(F.sum("value").alias("v"))
    out = sums.groupBy("source", "id", "contributor", "start", "level").agg(F.min("ts").alias("first"), F.min(F.when(F.col("v") >= F.col("level"), F.col("ts"))).alias("reached"))
    return out.select("source", "id", F.col("contributor").alias("name"), F.when(F.col("reached") > F.col("first"), F.col("start") - F.col("reached")).alias("lead_s"))


def traced(spans: DataFrame, processes: DataFrame, before: tuple[float, float] = (210.0, 30.0), top: int = 8) -> DataFrame:
    """(source, id, rank, name, share, delta, after, pids, is_new, lead_s) for spans (source, id, start, end, resource): CPU and bytes
    read and written as flows, memory and handles as stocks. A resource that ``processes`` has no column for names nobody."""
    traffic = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("io_read_bps", "io_write_bps") if c in processes.columns]
    rows = processes.withColumn("io_bps", sum(traffic[1:], traffic[0])) if traffic else processes
    parts = []
    for resource, column, stock in (("cpu", "cpu_percent", False), ("io", "io_bps", False), ("memory", "rss_mb", True), ("handles", "handles", True)):
        if column not in rows.columns:
            continue
        own = spans.where(F.col("resource") == resource).drop("resource")
        found = stock_contributors(own, rows, column, before[0], top) if stock else flow_contributors(own, rows, column, before, top)
        parts.append(found.join(lead_time(found, own, rows, column), ["source", "id", "name"], "left").select("source", "id", "rank", "name", "share", "delta", "after", "pids", "is_new", "lead_s"))
    return reduce(DataFrame.unionByName, parts)


def analyze(incidents: DataFrame, metrics: DataFrame, processes: DataFrame, gpu: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """Incidents (with ``trigger_metric``) analysed: start, end, bottleneck, overridden_from, scores, claim_wins, resource, attributable,
    contributors, evidence, triggers, title and report.

    The bottleneck comes from the machine's metrics at the peak against the time before. Where these name no resource and a detector
    (``claims``: ``detector_claim``'s rows) has named a process and its resource, the claim wins: contributors are found by its resource,
    the start goes back by the time for which the detector counted, and its sentence is the title. A claim yields to every other
    bottleneck, hardware states too. An incident without metrics has no bottleneck, title and report.
    """
    bounds = refined_bounds(incidents, metrics)
    columns = [c for c in ("cpu_total", "disk_resp_ms", "disk_queue", "mem_percent", "swap_used_mb", "ctx_switches_ps", "cpu_perf_percent") if c in metrics.columns]
    peaks = peak_and_prior(incidents, metrics, columns)
    peaks = peaks if gpu is None else with_gpu(peaks, incidents, gpu)
    kinds = choose_kind(classify(peaks.join(incidents.select("source", "id", "trigger_metric"), ["source", "id"]))).withColumn("evidence", evidence_lines(peaks, columns))
    own = bounds.join(kinds.select("source", "id", "bottleneck", "overridden_from", "scores", "evidence"), ["source", "id"], "left")
    if claims is None:
        own = own.withColumn("claim", F.lit(None).cast("struct<metric:string,process:string,explanation:string,duration_s:double,at:double>")).withColumn("triggers", F.array().cast("array<string>"))
    else:
        own = own.join(claims.withColumnRenamed("incident_id", "id"), ["source", "id"], "left")
    wins = F.coalesce(F.col("bottleneck").isin(*CLAIM_WINS_OVER) & F.col("claim").isNotNull(), F.lit(False))
    own = own.withColumn("claim_wins", wins).withColumn("resource", resource_of(F.col("bottleneck"), F.col("claim_wins"), F.col("claim.metric")))
    back = F.when(F.col("claim_wins") & (F.col("claim.duration_s") > 0), F.col("claim.at") - F.col("claim.duration_s"))
    own = cut(own.withColumn("start", F.least("start", back)).withColumn("attributable", F.col("claim_wins") | attributable(F.col("bottleneck"))))
    entry = F.struct("rank", "name", "share", "delta", "after", "pids", "lead_s", "is_new")
    named = traced(own.select("source", "id", "start", "end", "resource"), processes).groupBy("source", "id").agg(F.array_sort(F.collect_list(entry)).alias("contributors"))
    out = own.join(named, ["source", "id"], "left")
    label = F.element_at(F.create_map(*(F.lit(x) for pair in KIND_LABELS.items() for x in pair)), F.col("bottleneck"))
    sentence = F.col("claim_wins") & (F.coalesce(F.col("claim.explanation"), F.lit("")) != "")
    out = out.withColumn("title", F.when(F.col("bottleneck").isNotNull(), incident_title(sentence, F.col("claim.explanation"), label, F.col("attributable"), F.col("contributors"), F.col("evidence"))))
    return incident_report(out).drop("claim")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old against new analyses (source, id, title, top): what differs."""
    a, b = (df.select("source", "id", F.col("title").alias(f"{n}_title"), F.col("top").alias(f"{n}_top")) for n, df in (("old", old), ("new", new)))
    return a.join(b, ["source", "id"], "full_outer").withColumn("changed", ~(F.col("old_title").eqNullSafe(F.col("new_title")) & F.col("old_top").eqNullSafe(F.col("new_top"))))
