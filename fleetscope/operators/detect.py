"""The assembled rule detector: ticks of raw metrics in, signals with scores and evidence out.

Ticks are dealt once, by source and chunk of time, with the window before a chunk looked back to. A task streams its chunks
in order: it makes every metric's baseline, the rules' truths follow as SQL columns, and a second pass over the same rows
sums each chunk up: for each rule whether the condition held all along, since when it holds at the end, and, for every tick
that can be the first to fire, which one fires last. A chunk is thus a function from (held since, last fired) before it to
the same after it. These functions are applied in order for each source, which needs no tick; then each chunk's few ticks
on which a condition holds are replayed from the state that it starts with. So one host's year is many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import severity_rank
from ..session import written
from .baseline import Baseline, carried_stats, sigma_of
from .order_stats import sorted_groups, window_stats
from .rules import Rule, evidence, explained, gap_segments, rule_truth, score

#: Names in a condition's expression.
F_NAMES = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
STATS = ("median", "mad", "samples", "least", "most")


@dataclass(frozen=True)
class LoadGate:
    """The metric is learnt under load only: while ``gate`` is at least ``least``."""

    gate: str
    least: float


@dataclass(frozen=True)
class Setup:
    """Windows of the three axes, their spacings, and the chunk of time that a task takes at once.

    Without ``program`` no baseline depends on the program in the foreground; with it, metrics that a rule compares with
    their own baseline take that of ``foreground_program``, and stay undecided until it has samples enough.
    """

    usual: Baseline = Baseline(1800.0, 60)
    program: Baseline | None = None
    program_spacing: float = 5.0
    load: Baseline = Baseline(6 * 3600.0, 60)
    load_spacing: float = 5.0
    gates: Mapping[str, LoadGate] = field(default_factory=dict)
    chunk: float = 6 * 3600.0


def numeric_metrics(rules: Sequence[Rule]) -> list[str]:
    """Metrics of all conditions that compare numbers, in order."""
    return list(dict.fromkeys(c.metric for r in rules for c in r.conditions if c.op not in ("contains", "not_contains")))


def relative_metrics(rules: Sequence[Rule]) -> list[str]:
    """Metrics that some condition compares with an expression, not with a number."""

    def number(text: str) -> bool:
        try:
            float(text)
        except ValueError:
            return False
        return True

    return list(dict.fromkeys(c.metric for r in rules for c in r.conditions if c.op not in ("contains", "not_contains") and not number(c.value)))


def with_baselines(ticks: DataFrame, metrics: Sequence[str], setup: Setup) -> DataFrame:
    """``ticks`` with ``_chunk`` and, for each metric, its median, mad, sigma, samples, least, most and z over the usual window, null until ready.

    Rows come out in the order (source, chunk, ts) of their tasks; ticks before any metric is ready are left out, as nothing is judged there.
    """
    config, chunk = setup.usual, setup.chunk
    dealt = ticks.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("ts") / chunk), F.floor((F.col("ts") + config.window) / chunk))))
    dealt = dealt.repartition("source", "_chunk").sortWithinPartitions("source", "_chunk", "ts")
    names = [f"{m}_{s}" for m in metrics for s in STATS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields] + [f"`{n}` {'long' if n.endswith('_samples') else 'double'}" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("source", "_chunk")):
            t = group.column("ts").to_numpy()
            rows = np.flatnonzero(np.floor(t / chunk) == group.column("_chunk")[0].as_py())
            made, ready = [], np.zeros(len(rows), bool)
            for m in metrics:
                x = group.column(m).cast(pa.float64()).to_numpy(zero_copy_only=False)
                found = window_stats(t, x, config.window, rows)
                enough = found[:, 2] >= config.least_samples
                ready |= enough
                made += [pa.array(found[:, k].astype(np.int64)) if s == "samples" else pa.array(found[:, k], mask=~enough) for k, s in enumerate(STATS)]
            kept = np.flatnonzero(ready)
            own = group.take(pa.array(rows[kept]))
            for n, column in zip(names, made, strict=True):
                own = own.append_column(n, column.take(pa.array(kept)))
            yield from own.to_batches()

    out = dealt.mapInArrow(run, schema)
    for m in metrics:
        out = out.withColumn(f"{m}_sigma", sigma_of(F.col(f"{m}_median"), F.col(f"{m}_mad"), config))
        out = out.withColumn(f"{m}_z", (F.col(m) - F.col(f"{m}_median")) / F.col(f"{m}_sigma"))
    return out


def _truths(ticks: DataFrame, rules: Sequence[Rule], relative: Sequence[str], setup: Setup) -> DataFrame:
    """Adds ``_true``, an array with each rule's truth; a rule that can't be decided counts as false, which breaks a hold too."""
    truth = F.array(*(F.coalesce(rule_truth(r), F.lit(False)) for r in rules))
    if setup.program is None:
        return ticks.withColumn("_true", truth)
    parts = ("median", "mad", "sigma", "least", "most")
    known = F.col("foreground_program").isNotNull()
    usual = {f"{m}_{p}": f"_usual_{m}_{p}" for m in relative for p in parts}
    own = ticks.withColumnsRenamed(usual)
    own = own.withColumns({n: F.when(known, F.col(f"_program_{n}")).otherwise(F.col(old)) for n, old in usual.items()})
    return own.withColumn("_true", truth).drop(*usual).withColumnsRenamed({old: n for n, old in usual.items()})


def _next(ts: np.ndarray, cooldown: float) -> np.ndarray:
    """For each time the first place whose time lies ``cooldown`` or more after it, ``len(ts)`` for none; always a later one."""
    at = np.maximum(np.searchsorted(ts, ts + cooldown), np.arange(len(ts)) + 1)
    # The sum may be a rounding off; the difference decides.
    back = np.maximum(at - 1, 0)
    at = np.where((at - 1 > np.arange(len(ts))) & (ts[back] - ts >= cooldown), at - 1, at)
    ahead = np.minimum(at, len(ts) - 1)
    return np.where((at < len(ts)) & (ts[ahead] - ts < cooldown), at + 1, at)


def _last_of_chain(ts: np.ndarray, cooldown: float) -> np.ndarray:
    """The last to fire if a tick is the first: its chain of next ones, followed by doubling."""
    n = len(ts)
    after = np.append(_next(ts, cooldown), n)
    last = np.arange(n + 1)
    while (after[:n] < n).any():
        last = np.where(after < n, last[np.minimum(after, n)], last)
        after = after[after]
    return ts[last[:n]]


def summaries(ticks: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The ticks on which some rule's condition holds, with ``_since`` (for each rule when the hold began, -inf if before the chunk, NaN if it doesn't hold), and one row for each chunk with what it does to the rules' clocks."""
    holds, cooldowns = [r.hold for r in rules], [r.cooldown for r in rules]
    extra = "`_since` array<double>, `_first` double, `_whole` array<boolean>, `_tail` array<double>, `_starts` array<struct<rule:int,lead:boolean,ts:double,last:double>>"
    own = [f for f in ticks.schema.fields if f.name != "_true"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + [extra])
    doubles, flags = pa.list_(pa.float64()), pa.list_(pa.bool_())
    starts_type = pa.list_(pa.struct([("rule", pa.int32()), ("lead", pa.bool_()), ("ts", pa.float64()), ("last", pa.float64())]))

    def clocks(t: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, list, list, list]:
        n = len(t)
        since, whole, tail, starts = np.full(true.shape, np.nan), [], [], []
        for r, (hold, cooldown) in enumerate(zip(holds, cooldowns, strict=True)):
            held = true[:, r]
            breaks = np.flatnonzero(~held)
            before = np.maximum.accumulate(np.where(held, -1, np.arange(n)))
            begun = np.where(before < 0, -np.inf, t[np.minimum(before + 1, n - 1)])
            since[:, r] = np.where(held, begun, np.nan)
            whole.append(not len(breaks))
            tail.append(float(since[-1, r]) if len(breaks) and held[-1] else np.nan)
            can = np.flatnonzero(held & ((begun == -np.inf) | (t - begun >= hold)))
            if len(can):
                lead, last = begun[can] == -np.inf, _last_of_chain(t[can], cooldown)
                # A first one comes at most so long after the chunk's start, or is the first tick after that.
                reach = np.where(lead, max(hold, cooldown), cooldown)
                late = t[can] - t[0] > reach
                wanted = ~late
                for part in (lead, ~lead):
                    wanted[np.flatnonzero(late & part)[:1]] = True
                starts += [{"rule": r, "lead": bool(a), "ts": float(b), "last": float(c)} for a, b, c in zip(lead[wanted], t[can][wanted], last[wanted], strict=True)]
        return since, whole, tail, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("source", "_chunk")):
            t = group.column("ts").to_numpy()
            true = np.array(group.column("_true").combine_chunks().flatten().to_numpy(zero_copy_only=False), bool).reshape(len(t), len(rules))
            since, whole, tail, starts = clocks(t, true)
            kept = np.flatnonzero(true.any(axis=1))
            rows = group.drop_columns("_true").take(pa.array(kept))
            nothing = lambda kind, n=len(kept): pa.nulls(n, kind)
            for name, column in (("_since", pa.array(since[kept].tolist(), doubles)), ("_first", nothing(pa.float64())), ("_whole", nothing(flags)), ("_tail", nothing(doubles)), ("_starts", nothing(starts_type))):
                rows = rows.append_column(name, column)
            told = {"source": group.column("source")[0].as_py(), "_chunk": group.column("_chunk")[0].as_py(), "_first": float(t[0]), "_whole": whole, "_tail": tail, "_starts": starts}
            yield from rows.to_batches()
            yield pa.RecordBatch.from_pylist([told], schema=rows.schema)

    return ticks.mapInArrow(run, schema)


def chunk_states(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(source, _chunk, since, last): the clocks each chunk starts with, NaN for none; the chunks' functions applied in order for each source."""
    holds, cooldowns = np.array([r.hold for r in rules]), [r.cooldown for r in rules]
    told = found.where("_first is not null").select("source", "_chunk", "_first", "_whole", "_tail", "_starts").repartition("source").sortWithinPartitions("source", "_chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, since, last = None, [], []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["source"] != source:
                    source, since, last = row["source"], [np.nan] * len(rules), [np.nan] * len(rules)
                out.append({"source": source, "_chunk": row["_chunk"], "since": list(since), "last": list(last)})
                fired = [False] * len(rules)
                for s in row["_starts"]:
                    r = s["rule"]
                    begun = row["_first"] if np.isnan(since[r]) else since[r]
                    if not fired[r] and not s["ts"] - last[r] < cooldowns[r] and not (s["lead"] and s["ts"] - begun < holds[r]):
                        fired[r], last[r] = True, s["last"]
                since = [row["_first"] if w and np.isnan(b) else b if w else t for w, b, t in zip(row["_whole"], since, row["_tail"], strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("source", batch.schema.field("source").type), ("_chunk", pa.int64()), ("since", pa.list_(pa.float64())), ("last", pa.list_(pa.float64()))]))

    return told.mapInArrow(run, f"source {found.schema['source'].dataType.simpleString()}, _chunk long, since array<double>, last array<double>")


def replayed(found: DataFrame, states: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The ticks on which a rule fires, with ``_fired`` (the rules' places, rising) and ``_held`` (for how long each had held)."""
    met = found.where("_since is not null").drop("_first", "_whole", "_tail", "_starts").join(states, ["source", "_chunk"])
    met = met.repartition("source", "_chunk").sortWithinPartitions("source", "_chunk", "ts")
    own = [f for f in met.schema.fields if f.name not in ("_since", "since", "last", "_chunk")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own] + ["`_fired` array<int>", "`_held` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("source", "_chunk")):
            t = group.column("ts").to_numpy()
            begun = np.array(group.column("_since").to_pylist(), float)
            since, last = group.column("since")[0].as_py(), group.column("last")[0].as_py()
            fired: dict[int, list[tuple[int, float]]] = {}
            for r, rule in enumerate(rules):
                held = np.flatnonzero(~np.isnan(begun[:, r]))
                if not len(held):
                    continue
                # A hold from before the chunk began when the state says, or with the chunk's first tick.
                first = t[held[0]] if np.isnan(since[r]) else since[r]
                kept = t[held] - np.where(begun[held, r] == -np.inf, first, begun[held, r])
                ready = held[kept >= rule.hold]
                lengths, at, before = kept[kept >= rule.hold], 0, last[r]
                while at < len(ready):
                    if t[ready[at]] - before < rule.cooldown:
                        at = max(at + 1, int(np.searchsorted(t[ready], np.nextafter(before + rule.cooldown, -np.inf))) - 1)
                        continue
                    fired.setdefault(int(ready[at]), []).append((r, float(lengths[at])))
                    before = t[ready[at]]
                    at += 1
            places = sorted(fired)
            rows = group.select([f.name for f in own]).take(pa.array(places, pa.int64()))
            rows = rows.append_column("_fired", pa.array([[r for r, _ in fired[k]] for k in places], pa.list_(pa.int32())))
            yield from rows.append_column("_held", pa.array([[h for _, h in fired[k]] for k in places], pa.list_(pa.float64()))).to_batches()

    return met.mapInArrow(run, schema)


def with_axes(ticks: DataFrame, relative: Sequence[str], setup: Setup) -> DataFrame:
    """Adds the load axis (``m_load_median``, ``m_load_mad``, ``m_load_sigma`` for each gated metric) and, if it is set up, the program axis of the relative metrics."""
    out = ticks
    for m, gate in setup.gates.items():
        made = carried_stats(out, out.where(F.col(gate.gate) >= gate.least), m, ("source",), setup.load, setup.load_spacing)
        out = made.select(*out.columns, *(F.col(p).alias(f"{m}_load_{p}") for p in ("median", "mad", "sigma")))
    if setup.program is not None:
        for m in relative:
            known = out.where("foreground_program is not null")
            made = carried_stats(known, known, m, ("source", "foreground_program"), setup.program, setup.program_spacing)
            parts = ("median", "mad", "sigma", "least", "most")
            made = made.select(*out.columns, *(F.col(p).alias(f"_program_{m}_{p}") for p in parts))
            out = made.unionByName(out.where("foreground_program is null"), allowMissingColumns=True)
    return out


def rule_detector(ticks: DataFrame, rules: Sequence[Rule], setup: Setup = Setup(), detector: str = "rules", gaps: DataFrame | None = None) -> DataFrame:
    """(source, ts, detector, score, severity, rule, fired, sustained_s, explanation, evidence): one signal for each tick on which rules fire.

    ``ticks`` has (source, ts) and raw metrics, for the program axis ``foreground_program``, and any machine variables that
    rules name; what a rule names and no column has counts as unknown. Conditions may name ``m_median``, ``m_mad``,
    ``m_sigma``, ``m_least``, ``m_most`` and, for gated metrics, ``m_load_*``. The most severe rule that fires speaks for the
    tick, the first of equals; its score and evidence compare each of its metrics with the usual window, whatever the
    program. At ``gaps`` (source, ts), jumps in time, all that was learnt, held and fired is dropped: what lies between two of
    them is a source of its own. Suspect ticks and ticks without a time are passed over. A tick's own values are learnt before it is judged.
    """
    if gaps is not None:
        parts = gap_segments(ticks.where("ts is not null"), gaps).withColumn("source", F.struct("source", "segment")).drop("segment")
        return rule_detector(parts, rules, setup, detector).withColumn("source", F.col("source.source"))
    numeric, relative = numeric_metrics(rules), relative_metrics(rules)
    own = ticks.where(F.col("ts").isNotNull())
    own = own.where(~F.coalesce("suspect", F.lit(False))).drop("suspect") if "suspect" in ticks.columns else own
    texts = [c.metric for r in rules for c in r.conditions if c.op in ("contains", "not_contains")]
    names = {w for r in rules for c in r.conditions if c.metric not in texts for w in F_NAMES.findall(c.value)}
    made_later = {f"{m}_{p}" for m in (*numeric, *setup.gates) for p in ("median", "mad", "sigma", "least", "most", "load_median", "load_mad", "load_sigma")}
    for name, kind in ((n, "string" if n in texts else "double") for n in (*numeric, *texts, *(setup.gates and [g.gate for g in setup.gates.values()]), *sorted(names - made_later))):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    own = own.withColumns({m: F.col(m).cast("double") for m in numeric})
    judged = _truths(with_baselines(with_axes(own, relative, setup), numeric, setup), rules, relative, setup)
    found = written(summaries(judged, rules), "rule-chunks")
    fired = replayed(found, chunk_states(found, rules), rules)
    ranks = F.transform("_fired", lambda r: F.struct(-F.element_at(F.array(*(severity_rank(F.lit(x.severity)) for x in rules)), r + 1), r.alias("at")))
    top = F.array_min(ranks)["at"]
    out = fired.withColumn("_top", top)
    pick = lambda made: F.coalesce(*(F.when(F.col("_top") == k, made(r)) for k, r in enumerate(rules)))
    metrics_of = lambda r: [c.metric for c in r.conditions if c.metric in numeric]
    names = F.transform("_fired", lambda r: F.element_at(F.array(*(F.lit(x.name) for x in rules)), r + 1))
    held = F.element_at(F.transform(F.filter(F.arrays_zip("_fired", "_held"), lambda x: x["_fired"] == F.col("_top")), lambda x: x["_held"]), 1)
    return out.select(
        "source", "ts", F.lit(detector).alias("detector"), pick(lambda r: score(dict.fromkeys(metrics_of(r)))).alias("score"), pick(lambda r: F.lit(r.severity)).alias("severity"),
        pick(lambda r: F.lit(r.name)).alias("rule"), names.alias("fired"), F.round(held, 1).alias("sustained_s"), pick(lambda r: explained(r)).alias("explanation"),
        pick(lambda r: evidence(list(dict.fromkeys(metrics_of(r)))) if metrics_of(r) else F.lit(None)).alias("evidence"),
    )
