"""Scoring of detectors and attributions against labelled intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import severity_name
from . import intervals
from .baseline import observed_seconds
from .explain import traced
from .joins import descendants, in_spans


def episodes(faults: DataFrame, lo: float, hi: float, scenarios: Sequence[str] | None = None) -> DataFrame:
    """Completed faults (source, id, lo, hi) that meet the window."""
    own = faults.where(F.col("completed") & (F.col("ts_start") < hi) & (F.col("ts_end") > lo))
    own = own.where(F.col("scenario").isin(*scenarios)) if scenarios else own
    return own.select("source", "id", "scenario", F.col("ts_start").alias("lo"), F.col("ts_end").alias("hi"))


def window_around(faults: DataFrame, data: DataFrame, padding: float) -> DataFrame:
    """(source, lo, hi): all faults of a source with a margin, clipped to its data (source, first, last)."""
    own = faults.groupBy("source").agg(F.min("ts_start").alias("lo"), F.max(F.coalesce("ts_end", "ts_start")).alias("hi"))
    return own.join(data, "source").select("source", F.greatest(F.col("lo") - padding, F.col("first")).alias("lo"), F.least(F.col("hi") + padding, F.col("last")).alias("hi"))


def covered(episodes_: DataFrame, ticks: DataFrame, least_ticks: int = 3, least_share: float = 0.5) -> DataFrame:
    """Episodes with ``reason`` null if enough clean ticks cover them, else few_ticks or short_span."""
    own = ticks.where(~F.coalesce("suspect", F.lit(False))) if "suspect" in ticks.columns else ticks
    met = in_spans(own.select("source", "ts"), episodes_).groupBy("source", "id").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("seen"))
    out = episodes_.join(met, ["source", "id"], "left")
    reason = F.when(F.coalesce("n", F.lit(0)) < least_ticks, "few_ticks").when(F.col("seen") < least_share * (F.col("hi") - F.col("lo")), "short_span")
    return out.withColumn("reason", reason).drop("n", "seen")


def alarms(detections: DataFrame, merge: float = 60.0, keys: Sequence[str] = ("source", "detector")) -> DataFrame:
    """Detections at most ``merge`` seconds apart as one alarm (first, last, peak, count)."""
    own = intervals.islands(detections, merge, keys, tie=("score",))
    return own.groupBy(*keys, F.col("island").alias("alarm")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("score").alias("peak"), F.count("*").alias("n"))


def scores(alarms_: DataFrame, episodes_: DataFrame, normal: DataFrame | None = None, grace: float = 90.0, unit: float = 60.0, detectors: Sequence[str] | None = None) -> DataFrame:
    """Per source and detector: tp, fn, fp, precision, recall, f1 (0 where nothing counts), latency (median) and, with normal seconds (source, seconds), fp_per_hour.

    Every source with an alarm or an episode has a row for each of ``detectors`` (all that any source has alarms of, if not
    given), so that misses without an alarm and false alarms without an episode count. An episode is found if an alarm overlaps
    it or the grace after it; what an alarm leaves outside counts max(1, floor(seconds / unit)) false ones.
    """
    keys = ["source", "detector"]
    # A short list of names: the detectors themselves.
    names = detectors if detectors is not None else sorted(r[0] for r in alarms_.select("detector").distinct().collect())
    every = F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("detector")
    grid = alarms_.select("source").union(episodes_.select("source")).distinct().select("source", every)
    due = episodes_.select("source", F.col("id").alias("episode"), F.col("lo").alias("start"), (F.col("hi") + grace).alias("end"), every)
    met = intervals.overlap_join(due.withColumnsRenamed({"start": "lo", "end": "hi"}), alarms_.select(*keys, F.col("first").alias("lo"), F.col("last").alias("hi")), keys, ends=True)
    per = due.join(met.groupBy(*keys, "episode").agg(F.min("lo2").alias("first")), [*keys, "episode"], "left")
    found = per.groupBy(*keys).agg(F.count("first").alias("tp"), (F.count("*") - F.count("first")).alias("fn"), F.expr("percentile(CASE WHEN first IS NOT NULL THEN greatest(first, start) - start END, 0.5)").alias("latency"))
    blocks = episodes_.select("source", "lo", (F.col("hi") + grace).alias("hi"), every)
    segments = alarms_.select(*keys, F.col("alarm").alias("id"), F.col("first").alias("lo"), (F.col("last") + 1e-3).alias("hi"))
    left = intervals.subtract(segments, blocks, keys)
    falses = left.groupBy(*keys, "id").agg(F.sum(F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / unit))).alias("n")).groupBy(*keys).agg(F.sum("n").alias("fp"))
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tp", "fn", "fp")}
    out = grid.join(found, keys, "left").join(falses, keys, "left").withColumns(counts)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if normal is None:
        return out
    return out.join(normal.select("source", (F.col("seconds") / 3600).alias("hours")), "source", "left").withColumn("fp_per_hour", F.when(F.col("hours") >= 0.5, F.col("fp") / F.col("hours")))


def normal_seconds(ticks: DataFrame, episodes_: DataFrame, grace: float = 90.0) -> DataFrame:
    """(source, seconds) observed outside episodes, by clean ticks."""
    blocks = episodes_.select("source", "lo", (F.col("hi") + grace).alias("hi"))
    own = ticks.where(~F.coalesce("suspect", F.lit(False))) if "suspect" in ticks.columns else ticks
    return observed_seconds(in_spans(own, blocks, how="left_anti"))


# Which resource the load of a fault scenario shows in, and the scenarios that make no load of their own.
SCENARIO_RESOURCE = {"cpu_spin": "cpu", "memory_leak": "memory", "memory_leak_spread": "memory", "disk_thrash": "io", "handle_leak": "handles"}
NOT_ATTRIBUTABLE = ("manual",)


def fault_answers(faults: DataFrame, starts: DataFrame, processes: DataFrame, look_back: float = 3600.0) -> DataFrame:
    """(source, id, lo, hi, resource, answer_pids, skipped) of labelled faults: the fault's process and all below it are right answers.

    Process starts (source, ts, pid, ppid) from ``look_back`` seconds before the fault to its end make its tree, so that a pid
    that is used again elsewhere brings no others in. ``skipped`` says why a fault cannot be scored, null if it can.
    """
    own = faults.select("source", "id", "scenario", "pid", F.col("ts_start").alias("lo"), F.col("ts_end").alias("hi"), "completed")
    spans = own.where("pid is not null and hi is not null").select("source", "id", (F.col("lo") - look_back).alias("lo"), "hi", F.col("pid").alias("root"))
    # Each fault's tree has a key of its own: a start can be in several faults' time.
    edges = in_spans(starts.where("pid is not null and ppid is not null").select("source", "ts", "pid", "ppid"), spans).select(F.struct("source", "id").alias("source"), "pid", "ppid")
    below = descendants(edges, spans.select(F.struct("source", "id").alias("source"), F.col("root").alias("pid")))
    answers = below.groupBy(F.col("source.source").alias("source"), F.col("source.id").alias("id")).agg(F.array_sort(F.collect_set("pid")).alias("answer_pids"))
    seen = in_spans(processes.select("source", "ts"), own.where("hi is not null").select("source", "id", "lo", "hi")).select("source", "id").distinct().withColumn("_seen", F.lit(True))
    resource = F.element_at(F.create_map(*(F.lit(x) for pair in SCENARIO_RESOURCE.items() for x in pair)), F.col("scenario"))
    skipped = F.when(F.col("scenario").isin(*NOT_ATTRIBUTABLE), "no_load").when(F.col("resource").isNull(), "unknown_scenario").when(F.col("hi").isNull(), "unfinished").when(~F.coalesce("completed", F.lit(False)), "no_symptom").when(F.col("pid").isNull(), "no_pid").when(F.col("_seen").isNull(), "no_process_metrics")
    out = own.withColumn("resource", resource).join(answers, ["source", "id"], "left").join(seen, ["source", "id"], "left").withColumn("skipped", skipped)
    return out.select("source", "id", "lo", "hi", "resource", "answer_pids", "skipped")


def score_faults(answers: DataFrame, processes: DataFrame, before: tuple[float, float] = (150.0, 30.0), top: int = 8) -> DataFrame:
    """(source, id, skipped, hit_rank): each fault traced by its scenario's resource over its own time; the rank of the first contributor whose pids meet the answer."""
    spans = answers.where("skipped is null").select("source", "id", F.col("lo").alias("start"), F.col("hi").alias("end"), "resource")
    hits = attribution_hits(traced(spans, processes, before, top), answers.where("skipped is null"))
    return answers.select("source", "id", "skipped").join(hits, ["source", "id"], "left")


def score_product(answers: DataFrame, analysed: DataFrame, incidents: DataFrame, metrics: DataFrame) -> DataFrame:
    """(source, id, skipped, incident, hit_rank): each fault by the analysis (source, id, contributors) of the incident that overlaps it longest.

    A fault that made no incident, or whose metrics are gone so that nothing could be analysed anew, is skipped and says so.
    """
    due = answers.where("skipped is null")
    faults = due.select("source", "id", "lo", "hi")
    spans = incidents.select("source", F.col("id").alias("id2"), F.col("ts_start").alias("lo"), F.coalesce("ts_end", "ts_start").alias("hi"))
    met = intervals.overlap_join(faults, spans, ends=True).withColumn("_s", F.least("hi", "hi2") - F.greatest("lo", "lo2"))
    longest = met.groupBy("source", "id").agg(F.max_by("id2", F.struct("_s", -F.col("lo2"), -F.col("id2"))).alias("incident"))
    there = in_spans(metrics.select("source", "ts"), faults).select("source", "id").distinct().withColumn("_there", F.lit(True))
    known = due.join(longest, ["source", "id"], "left").join(there, ["source", "id"], "left")
    reason = F.when(F.col("incident").isNull(), "no_incident").when(F.col("_there").isNull(), "metrics_gone")
    scored = known.withColumn("_why", reason)
    ranked = analysed.select("source", F.col("id").alias("incident"), F.explode("contributors").alias("c")).select("source", "incident", "c.rank", "c.pids")
    own = scored.where("_why is null").join(ranked, ["source", "incident"]).select("source", "id", "rank", "pids")
    hits = attribution_hits(own, scored.where("_why is null"))
    out = answers.select("source", "id", "skipped").join(scored.select("source", "id", "_why", "incident"), ["source", "id"], "left").join(hits, ["source", "id"], "left")
    return out.select("source", "id", F.coalesce("skipped", "_why").alias("skipped"), "incident", "hit_rank")


def attribution_hits(contributors: DataFrame, answers: DataFrame) -> DataFrame:
    """(source, id, hit_rank): rank of the first contributor whose pids meet the answer's (source, id, answer_pids); null for none."""
    met = answers.select("source", "id", "answer_pids").join(contributors.select("source", "id", "rank", "pids"), ["source", "id"], "left")
    return met.groupBy("source", "id").agg(F.min(F.when(F.arrays_overlap("pids", "answer_pids"), F.col("rank"))).alias("hit_rank"))


def scoreboard(scored: DataFrame, window: tuple[float, float], at: float, notes: str = "") -> DataFrame:
    """One row a detector over all sources, best first: counts added up, rates of the sums, ready to be appended to a history of runs."""
    sums = scored.groupBy("detector").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.expr("percentile(latency, 0.5)").alias("latency"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select(F.lit(float(at)).alias("ts"), "detector", F.lit(float(window[0])).alias("window_start"), F.lit(float(window[1])).alias("window_end"), "tp", "fp", "fn", "precision", "recall", "f1", "latency", F.lit(notes).alias("notes")).orderBy(F.desc("f1"), "detector")


def attribution_rates(hits: DataFrame, least: int = 7, passing: float = 0.85) -> DataFrame:
    """n, top1, top3 and verdict (null below ``least`` samples)."""
    out = hits.agg(F.count("*").alias("n"), F.avg((F.coalesce("hit_rank", F.lit(99)) == 1).cast("int")).alias("top1"), F.avg((F.coalesce("hit_rank", F.lit(99)) <= 3).cast("int")).alias("top3"))
    return out.withColumn("passed", F.when(F.col("n") >= least, F.col("top1") >= passing))


def threshold_sweep(rows: DataFrame, value: str, warning: Sequence[float], critical_factor: float = 2.0, before: str = "severity_rank") -> DataFrame:
    """(threshold, before, after, n): how severities move when rows are graded anew; one pass, a row for each threshold given."""
    grid = F.explode(F.array(*(F.lit(float(w)) for w in warning))).alias("threshold")
    own = rows.select(F.col(value).alias("v"), F.col(before).alias("_b"), grid)
    after = F.when(F.col("v") >= critical_factor * F.col("threshold"), 2).when(F.col("v") >= F.col("threshold"), 1).otherwise(0)
    return own.groupBy("threshold", severity_name(F.col("_b")).alias("before"), severity_name(after).alias("after")).agg(F.count("*").alias("n"))


def batch_progress(faults: DataFrame, gap: float = 600.0) -> DataFrame:
    """(source, batch, lo, hi, n, done): faults in batches at most ``gap`` seconds apart; the last batch is the current one."""
    own = intervals.islands(faults.withColumn("ts", F.col("ts_start")), gap)
    return own.groupBy("source", F.col("island").alias("batch")).agg(F.min("ts_start").alias("lo"), F.max(F.coalesce("ts_end", "ts_start")).alias("hi"), F.count("*").alias("n"), F.count_if("completed").alias("done"))


def label_effect(episodes_: DataFrame, samples: DataFrame, value: str, required: float, before: float = 60.0) -> DataFrame:
    """Adds ``effect`` (peak inside less the mean before) and ``completed``: the effect reaches ``required``; 0 or less always passes."""
    inside = in_spans(samples, episodes_).groupBy("source", "id").agg(F.max(value).alias("_peak"))
    prior = in_spans(samples, episodes_.select("source", "id", (F.col("lo") - before).alias("lo"), F.col("lo").alias("hi"))).where("ts < hi").groupBy("source", "id").agg(F.avg(value).alias("_mean"))
    out = episodes_.join(inside, ["source", "id"], "left").join(prior, ["source", "id"], "left").withColumn("effect", F.col("_peak") - F.col("_mean")).drop("_peak", "_mean")
    return out.withColumn("completed", F.lit(True) if required <= 0 else F.coalesce(F.col("effect") >= required, F.lit(False)))
