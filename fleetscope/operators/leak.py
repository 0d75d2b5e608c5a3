"""Leaks of processes and program groups, and slow drift."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import group_key, severity_name
from ..session import written
from .order_stats import group_blocks


@dataclass(frozen=True)
class LeakRule:
    """Gates: growth, ratio of last to first quarter, share of steps that don't fall, seconds and samples; judged once each ``grid`` seconds over ``window``."""

    metric: str
    delta: float
    ratio: float = 1.5
    monotone: float = 0.9
    duration: float = 300.0
    samples: int = 60
    window: float = 900.0
    grid: float = 30.0
    cooldown: float = 600.0
    reset_share: float = 0.5


def may_grow(samples: DataFrame, rule: LeakRule, keys: tuple[str, ...] = ("source", "pid", "name")) -> DataFrame:
    """Rows of tracks whose largest over smallest value reaches the ratio; no other track can pass it."""
    bound = samples.groupBy(*keys).agg(F.max(rule.metric).alias("_hi"), F.min(rule.metric).alias("_lo"), F.count(rule.metric).alias("_n")).where((F.col("_n") >= rule.samples) & ((F.col("_hi") >= rule.ratio * F.col("_lo")) | (F.col("_lo") <= 0)))
    return samples.join(bound.select(*keys), list(keys), "left_semi")


def window_medians(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Medians of the runs of ``size`` places from ``first`` on; runs of one size are taken together, some four million values at a time."""
    out = np.empty(len(first))
    for q in np.unique(size).tolist():
        own = np.flatnonzero(size == q)
        step = max(1, 4_000_000 // q)
        for k in range(0, len(own), step):
            part = own[k : k + step]
            out[part] = np.median(x[first[part][:, None] + np.arange(q)], axis=1)
    return out


def judge(t: np.ndarray, x: np.ndarray, *of) -> tuple[float, float, float, float, str] | dict[str, np.ndarray]:
    """``judge(t, x, rule)``: (delta, ratio, monotone share, seconds, reason) of one track's window; ``judge(t, x, first, last, rule)``: ``judge_windows``."""
    if len(of) > 1:
        return judge_windows(t, x, *of)
    one = judge_windows(t, x, np.zeros(1, int), np.array([len(x) - 1]), *of)
    return (*(float(one[n][0]) for n in ("delta", "ratio", "monotone", "seconds")), one["reason"][0])


def judge_windows(t: np.ndarray, x: np.ndarray, first: np.ndarray, last: np.ndarray, rule: LeakRule) -> dict[str, np.ndarray]:
    """Delta, ratio, monotone share, seconds and reason (the first gate that fails or an empty string) of the windows from place ``first`` to ``last``."""
    n = last - first + 1
    q = np.maximum(1, n // 4)
    low, high = window_medians(x, first, q), window_medians(x, last - q + 1, q)
    delta = high - low
    ratio = np.divide(high, low, out=np.where(high > 0, np.inf, 1.0), where=low > 0)
    rises = np.append(0, np.cumsum(x[1:] >= x[:-1]))
    monotone, seconds = np.where(n > 1, (rises[last] - rises[first]) / np.maximum(n - 1, 1), 0.0), t[last] - t[first]
    gates = {"samples": n >= rule.samples, "duration": seconds >= rule.duration, "delta": delta >= rule.delta, "ratio": ratio >= rule.ratio, "monotone": monotone >= rule.monotone}
    reason = np.select([~ok for ok in gates.values()], list(gates), "").astype(object)
    return {"delta": delta, "ratio": ratio, "monotone": monotone, "seconds": seconds, "last": x[last], "reason": reason}


class RangeMax:
    """Largest value of any run of places, by tables of runs of 2^k; no run is longer than ``longest``."""

    def __init__(self, x: np.ndarray, longest: int):
        self.levels = [x]
        while 2 ** len(self.levels) <= longest:
            half = 2 ** (len(self.levels) - 1)
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-half], below[half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over [first, last]; -inf where that is empty."""
        first, last = np.asarray(first), np.asarray(last)
        size = last - first + 1
        out = np.full(size.shape, -np.inf)
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]).tolist():
            own = (level == k) & (size > 0)
            out[own] = np.maximum(self.levels[k][first[own]], self.levels[k][last[own] - 2**k + 1])
        return out


class Tracks:
    """Samples (rising times) of many tracks' chunks, one after the other from the places ``begin`` on, each with two windows before its chunk.

    A sample starts its track anew if more than a window passed since the one before, or if it lies below ``reset_share`` of
    the largest held then: of those since the last start and within a window of the sample before. So it does if the latest
    sample that is held and large enough for that, its witness, is not before the last start.
    """

    def __init__(self, t: np.ndarray, x: np.ndarray, begin: np.ndarray, rule: LeakRule):
        self.t, self.x, self.rule, self.begin, self.end = t, x, rule, begin, np.append(begin[1:], len(t))
        sizes = self.end - begin
        self.place, self.of = np.arange(len(t)), np.repeat(np.arange(len(begin)), sizes)
        self.top = RangeMax(x, int(sizes.max()))
        low = begin[self.of]
        one = self.place == low
        before = np.where(one, t, np.roll(t, 1))
        self.held = self.search(before - rule.window, low, self.place)
        self.gap = (t - before > rule.window) | one
        # With nothing cut off the largest is largest, so no other sample can start the track anew.
        top = self.top(self.held, self.place - 1)
        may = self.gap | (top > 0) & (x < rule.reset_share * top)
        self.able = np.flatnonzero(may)
        self.seen, gap = self.able - 1, self.gap[self.able]
        self.seen[~gap] = self.witness(self.able[~gap])

    def search(self, times: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place from ``low`` on that is not before its time; ``high`` if there is none below that."""
        low, high = low.copy(), high.copy()
        while len(own := np.flatnonzero(low < high)):
            middle = (low[own] + high[own]) // 2
            early = self.t[middle] < times[own]
            low[own[early]] = middle[early] + 1
            high[own[~early]] = middle[~early]
        return low

    def witness(self, places: np.ndarray) -> np.ndarray:
        """The latest held place before each of ``places`` that lets it start the track anew."""
        at, low, x = places.copy(), self.held[places], self.x[places]
        for k in reversed(range(len(self.top.levels))):
            top = self.top.levels[k][np.maximum(at - 2**k, 0)]
            at -= np.where((at - 2**k >= low) & ~((top > 0) & (x < self.rule.reset_share * top)), 2**k, 0)
        return at - 1

    def listen(self, since: np.ndarray, until: np.ndarray | None = None) -> None:
        """Finds what follows each start, if only places from ``since`` on and before ``until`` (one a chunk) can start a track anew."""
        chunk = self.of[self.able]
        own = (self.able >= since[chunk]) & (self.able < (self.end if until is None else until)[chunk])
        self.cand = self.able[own]
        # A witness lies before its place; so the first place whose witness is not before a start is the first whose running largest is not.
        self.reach = np.maximum.accumulate(self.seen[own])
        follow = np.append(self.after(self.cand, self.end[self.of[self.cand]]), len(self.cand))
        self.hops = [follow]
        while (self.hops[-1] < len(self.cand)).any():
            self.hops.append(self.hops[-1][self.hops[-1]])

    def after(self, starts: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which candidate starts the track anew first, if it last did so at ``starts``; their number if none does before ``end``."""
        k = np.searchsorted(self.reach, starts)
        return np.where(np.append(self.cand, len(self.t))[k] < end, k, len(self.cand))

    def starts(self, first: np.ndarray) -> np.ndarray:
        """All places at which the tracks start anew, if each chunk's track last did so at ``first``."""
        on = np.zeros(len(self.cand) + 1, bool)
        on[self.after(first, self.end)] = True
        for hop in reversed(self.hops):
            on[hop[np.flatnonzero(on)]] = True
        return self.cand[on[:-1]]

    def guess(self, first: np.ndarray) -> np.ndarray:
        """The last place before ``first`` (one a chunk) at which a track starts anew, if nothing before the chunk's two windows
        matters; the place before ``begin`` if there is none. Where the track truly starts at none, neither is one found."""
        self.listen(self.begin + 1, first)
        begun = self.starts(self.begin)
        out = self.begin - 1
        np.maximum.at(out, self.of[begun], begun)
        return out

    def table(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, bound, last start) for each kind of past of the chunks that begin at ``first``: if the track last started at
        ``bound`` or before (and after the bound before it), it last starts in the chunk at the given time; NaN for not at all.
        Chunks in which no track can start anew have none."""
        some = np.zeros(len(first), bool)
        some[self.of[self.cand]] = True
        # Places before the chunk that lie above all later ones: what is held from a past start on has the next of them as its largest.
        old = np.flatnonzero(some[self.of] & (self.place < first[self.of]))
        old = old[self.x[old] > self.top(old + 1, first[self.of[old]] - 1)]
        bare = some.copy()
        bare[self.of[old]] = False
        places = np.sort(np.append(old, self.begin[bare]))
        chunk = self.of[places]
        past = np.where(first[chunk] > self.begin[chunk], self.search(self.t[places], self.begin[chunk], places), places - 1)
        at = self.after(past, self.end[chunk])
        found = at < len(self.cand)
        for hop in reversed(self.hops):
            at = np.where(hop[at] < len(self.cand), hop[at], at)
        final = np.append(chunk[1:] != chunk[:-1], True)[: len(chunk)]
        last = np.full(len(places), np.nan)
        last[found] = self.t[self.cand[at[found]]]
        same = np.append((last[1:] == last[:-1]) | np.isnan(last[1:]) & np.isnan(last[:-1]), False)[: len(last)]
        kept = final | ~same
        return chunk[kept], np.where(final, np.inf, self.t[places])[kept], last[kept]


VERDICT_COLUMNS = "delta double, ratio double, monotone double, seconds double, last double, reason string"


def tracks(samples: DataFrame, rule: LeakRule, keys: tuple[str, ...] = ("source", "pid", "name"), chunk: float = 4 * 3600.0, every: bool = True, verdicts: bool = True) -> DataFrame:
    """(keys, ts, value, growth, delta, ratio, monotone, seconds, last, reason) for every sample: how much the track has grown
    since the first sample that it holds and, at its first sample of each ``grid`` seconds, its verdict (an empty reason: leaking).

    A track's life is cut into chunks of time, each with two windows before it. Nearly always nothing before those matters, and when
    the track last started anew in them can be told from them; where that guess is wrong, its chunk is done again from the true start.
    To know that, chunks in which it may start anew tell when it last does so as a function of when it did before, and these are
    applied in order. Null values and times are left out. Without ``every`` only the samples with a verdict are given, without ``verdicts`` no verdicts. A task works on
    many tracks' chunks at once.
    """
    if chunk < 2 * rule.window or chunk % rule.grid:
        raise ValueError("a chunk must hold two windows and whole steps of the grid")
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    own = samples.select(*keys, F.col("ts").cast("double").alias("ts"), F.col(rule.metric).cast("double").alias("value")).where("ts is not null and value is not null")
    spread = own.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("ts") / chunk), F.floor((F.col("ts") + 2 * rule.window) / chunk))))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_chunk long", "ts double", "value double", "growth double", *([VERDICT_COLUMNS] if verdicts else []), "_guess double", "_table array<struct<bound:double,last:double>>"])

    def judged(groups: DataFrame, again: bool = False) -> DataFrame:
        """``again``: chunks that begin with the sample that started their track anew."""
        order = [*keys, "_chunk"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, begin in group_blocks(batches, order):
                t, x = block.column("ts").to_numpy(), block.column("value").to_numpy()
                held = Tracks(t, x, begin, rule)
                first = held.search(block.column("_chunk").to_numpy()[begin] * chunk, begin, held.end)
                since = begin if again else held.guess(first)
                held.listen(begin + 1 if again else first)
                start = np.zeros(len(t), int)
                known = np.maximum(begin, since)
                for begun in (begin, known, held.starts(since)):
                    start[begun] = begun
                start = np.maximum(np.maximum.accumulate(start), held.search(t - rule.window, begin[held.of], held.place))
                of, bounds, lasts = (np.empty(0, int), np.empty(0), np.empty(0)) if again else held.table(first)
                rows_of = np.bincount(of, minlength=len(begin))
                cells = np.floor(t / rule.grid)
                due = np.append(True, cells[1:] != cells[:-1])
                due[begin] = True
                head = held.place == first[held.of]
                places = np.flatnonzero((held.place >= first[held.of]) & (due | every | head))
                out = block.select([*order, "ts", "value"]).take(pa.array(places))
                out = out.append_column("growth", pa.array((x - x[start])[places], pa.float64()))
                if verdicts:
                    told = due[places]
                    for n, v in judge_windows(t, x, start[places[told]], places[told], rule).items():
                        whole = np.zeros(len(places), v.dtype)
                        whole[told] = v
                        out = out.append_column(n, pa.array(whole, pa.string() if n == "reason" else pa.float64(), mask=~told))
                out = out.append_column("_guess", pa.array(t[known][held.of[places]], pa.float64(), mask=~head[places] | again))
                count = np.where(head[places], rows_of[held.of[places]], 0)
                pasts = pa.StructArray.from_arrays([pa.array(bounds, pa.float64()), pa.array(lasts, pa.float64())], ["bound", "last"])
                table = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pasts, mask=pa.array(count == 0))
                yield from out.append_column("_table", table).to_batches()

        return groups.repartition(*order).sortWithinPartitions(*order, "ts").mapInArrow(run, schema)

    done = written(judged(spread), "leak-tracks")
    told = done.where("_guess is not null").select(*keys, "_chunk", "_guess", "_table").repartition(*keys).sortWithinPartitions(*keys, "_chunk")

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks that begin less than two windows after their track started anew, with when it did, if that was not guessed."""
        key, since = None, -np.inf
        for batch in batches:
            pasts = batch.column("_table").flatten()
            bounds, lasts = pasts.field("bound").to_pylist(), pasts.field("last").to_pylist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_table")), 0).to_numpy()).tolist()
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            wrong, true, low = [], [], 0
            for k, (name, at, guess, end) in enumerate(zip(names, batch.column("_chunk").to_pylist(), batch.column("_guess").to_pylist(), ends, strict=True)):
                if name != key:
                    key, since = name, -np.inf
                if since > at * chunk - 2 * rule.window and since != guess:
                    wrong.append(k)
                    true.append(since)
                if low < end:
                    last = lasts[bisect_left(bounds, since, low, end)]
                    since, low = since if np.isnan(last) else last, end
            out = batch.select([*keys, "_chunk"]).take(pa.array(wrong, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(true, pa.float64())], [*out.schema.names, "_since"])

    # Written and not only cut, so that its size is known: few chunks are sent to the samples, and these are not dealt again.
    again = written(told.mapInArrow(late, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_chunk long, _since double"])), "leak-again")
    anew = judged(spread.join(again, [*keys, "_chunk"]).where("ts >= _since"), again=True)
    kept = done.join(again.select(*keys, "_chunk"), [*keys, "_chunk"], "left_anti")
    return kept.unionByName(anew).drop("_chunk", "_guess", "_table")


def leak_verdicts(samples: DataFrame, rule: LeakRule, keys: tuple[str, ...] = ("source", "pid", "name"), chunk: float = 4 * 3600.0) -> DataFrame:
    """Per track and ``grid`` seconds: delta, ratio, monotone, seconds, last value, reason (empty: leaking), as ``tracks`` has them."""
    return tracks(samples, rule, keys, chunk, every=False).where("reason is not null").select(*keys, "ts", "delta", "ratio", "monotone", "seconds", "last", "reason")


def leak_signals(verdicts: DataFrame, rule: LeakRule, fingerprints: DataFrame | None = None, groups: DataFrame | None = None, share: float = 0.8) -> DataFrame:
    """One signal a host and grid step: the best leaking track, spaced by each winner's cooldown.

    A process scores by its ratio, at twice the rule's 1, and says nothing while within its program's usual p99; a group
    (``groups``: verdicts of ``group_leaks``) scores by its growth, and wins against a process only with a higher score.
    Severity comes from the value against the program's p99. A track whose cooldown runs leaves the place to the next best.
    """
    usual = None if fingerprints is None else fingerprints.where(F.col("stat") == rule.metric).select("source", "name", "p99")
    with_p99 = lambda df: df.withColumn("p99", F.lit(None).cast("double")) if usual is None else df.join(usual, ["source", "name"], "left")
    names = ("source", "pid", "name", "ts", "delta", "ratio", "monotone", "seconds", "last", "score", "members", "p99")
    own = with_p99(verdicts.where("reason = ''")).where(F.col("p99").isNull() | (F.col("last") > F.col("p99")))
    leaking = own.withColumn("score", F.least(F.lit(1.0), F.col("ratio") / (2 * rule.ratio))).withColumn("members", F.lit(1).cast("long")).select(*names)
    if groups is not None:
        many = with_p99(groups.where("reason = ''")).withColumn("score", F.least(F.lit(1.0), F.col("delta") / (2 * share * rule.delta))).withColumn("members", F.col("members").cast("long"))
        leaking = leaking.unionByName(many.select(*names))
    dealt = leaking.withColumn("_step", F.floor(F.col("ts") / rule.grid)).repartition("source").sortWithinPartitions("source", "_step", F.desc("score"), "members", "name", "pid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams each source's leaking tracks step by step; holds when each track last spoke."""
        source, step, fired = None, None, {}
        for batch in batches:
            kept = []
            for k, (s, at, ts, name, pid, members) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "_step", "ts", "name", "pid", "members")), strict=True)):
                if s != source:
                    source, step, fired = s, None, {}
                who = (name, None if members > 1 else pid)
                if at != step and not ts - fired.get(who, -np.inf) < rule.cooldown:
                    step, fired[who] = at, ts
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    rank, label = leak_risk(F.col("last"), F.col("p99"), F.col("monotone"))
    out = dealt.mapInArrow(run, dealt.schema).withColumn("severity", severity_name(rank)).withColumn("severity_reason", label)
    return out.withColumn("detector", F.lit("process_leak")).drop("_step", "p99")


def group_growth(grown: DataFrame, window: float = 900.0, chunk: float = 4 * 3600.0, least_members: int = 2) -> DataFrame:
    """(source, name, ts, growth, members, pid) per program group at each of its samples: the positive growth of all members summed, each
    as its last sample within ``window`` left it; pid is the largest grower's of those sampled then. ``grown`` is ``tracks``' rows.

    A member's growth counts from its sample to its next one, or for a window; so sums are running ones over steps up and down,
    for each chunk of time with a window before it. A next sample beyond the chunk ends nothing in it, so all is told from the
    chunk's own rows, which are dealt once.
    """
    keys = ("source", "name", "_chunk")
    cells = F.explode(F.sequence(F.floor(F.col("ts") / chunk), F.floor((F.col("ts") + window) / chunk))).alias("_chunk")
    own = grown.select("source", group_key(F.col("name"), F.col("pid")).alias("name"), cells, "pid", F.col("name").alias("_name"), "ts", F.greatest("growth", F.lit(0.0)).alias("g")).repartition(*keys)
    after = F.lead("ts").over(Window.partitionBy(*keys, "pid", "_name").orderBy("ts"))
    gone = F.coalesce(after > F.col("ts") + window, F.lit(True))
    lives = own.withColumn("_gone", gone).withColumn("_end", F.when(gone, F.col("ts") + window).otherwise(after))
    up = F.struct(F.col("ts").alias("at"), F.lit(0).alias("late"), F.col("g").alias("step"), F.lit(1).alias("n"), "pid")
    # What the next sample takes over ends with it; what ends with its window still counts at that time.
    down = F.struct(F.col("_end").alias("at"), F.col("_gone").cast("int").alias("late"), (-F.col("g")).alias("step"), F.lit(-1).alias("n"), F.lit(None).cast(grown.schema["pid"].dataType).alias("pid"))
    # Nothing that ends after the chunk counts in it.
    within = F.filter(F.array(up, down), lambda s: s["at"] < (F.col("_chunk") + 1) * chunk)
    grower = F.max_by("pid", F.when(F.col("pid").isNotNull(), F.struct("step", -F.col("pid")))).alias("pid")
    steps = lives.select(*keys, F.inline(within)).groupBy(*keys, "at", "late").agg(F.sum("step").alias("step"), F.sum("n").alias("n"), grower)
    order = Window.partitionBy(*keys).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    total = steps.withColumn("growth", F.round(F.sum("step").over(order), 6)).withColumn("members", F.sum("n").over(order))
    mine = total.where(F.col("pid").isNotNull() & (F.floor(F.col("at") / chunk) == F.col("_chunk")))
    return mine.where(F.col("members") >= least_members).select("source", "name", F.col("at").alias("ts"), "growth", "members", "pid")


def group_leaks(samples: DataFrame, rule: LeakRule, share: float = 0.8, chunk: float = 4 * 3600.0) -> DataFrame:
    """Verdicts of program groups: their members' summed growth as a track of its own, judged by ``share`` of the single process's growth and by steadiness, not by ratio.

    Only times with two members or more and some growth count. Columns as ``leak_verdicts``, with pid and members.
    """
    sums = written(group_growth(tracks(samples, rule, chunk=chunk, verdicts=False), rule.window, chunk).where("growth > 0"), "leak-groups")
    own = replace(rule, metric="growth", delta=share * rule.delta, ratio=1.0)
    return leak_verdicts(sums, own, ("source", "name"), chunk).join(sums.select("source", "name", "ts", "pid", "members"), ["source", "name", "ts"])


def ram_gate(delta: float, ram_mb: Column, share: float = 0.02, least: float = 128.0) -> Column:
    """Growth gate by the host's memory; the absolute one where it is unknown."""
    return F.when(ram_mb.isNotNull(), F.greatest(F.lit(least), ram_mb * share)).otherwise(F.lit(delta))


def leak_risk(last: Column, p99: Column, monotone: Column) -> tuple[Column, Column]:
    """(severity rank, label): by position against the program's own p99, one step down if it isn't steady; a program without a p99 above 0 is unknown, a warning."""
    unknown = p99.isNull() | (p99 <= 0)
    rank = F.when(last >= 2 * p99, 2).when(last >= p99, 1).otherwise(0)
    rank = F.when(unknown, 1).when(monotone < 0.95, F.greatest(rank - 1, F.lit(0))).otherwise(rank)
    return rank, F.when(unknown, "unknown_leak").otherwise("leak")


def clock_loss(now: Column, usual: Column) -> Column:
    """Rank by the share of clock speed lost: a tenth is a warning, a quarter critical."""
    lost = 1 - F.try_divide(now, usual)
    return F.when(lost >= 0.25, 2).when(lost >= 0.1, 1).when(lost.isNotNull(), 0)


def combined(risk: Column, impact: Column) -> tuple[Column, Column]:
    """(rank, axis): the worse of the two; impact wins ties; a null axis loses."""
    r, i = F.coalesce(risk, F.lit(-1)), F.coalesce(impact, F.lit(-1))
    return F.greatest(risk, impact), F.when(i >= r, "impact").otherwise("risk")


def daily_load_median(minutes: DataFrame, value: str, load: str, least_load: float = 80.0, least_minutes: int = 20, day: str = "day") -> DataFrame:
    own = minutes.where((F.col(load) >= least_load) & F.col(value).isNotNull())
    return own.groupBy("source", day).agg(F.expr(f"percentile({value}, 0.5)").alias("level"), F.count("*").alias("minutes")).where(F.col("minutes") >= least_minutes)


def drift(levels: DataFrame, rise: float = 3.0, recent: int = 3, before: int = 14, least_days: int = 7, day: str = "day") -> DataFrame:
    """(source, recent_level, usual_level, rise, score) where the median of the last ``recent`` days exceeds that of up to ``before`` days before them."""
    ranked = levels.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(day))))
    med = lambda lo, hi: F.expr(f"percentile(CASE WHEN _n > {lo} AND _n <= {hi} THEN level END, 0.5)")
    out = ranked.groupBy("source").agg(F.count("*").alias("_days"), med(0, recent).alias("recent_level"), med(recent, recent + before).alias("usual_level")).where(F.col("_days") >= least_days)
    return out.withColumn("rise", F.col("recent_level") - F.col("usual_level")).where(F.col("rise") >= rise).withColumn("score", F.least(F.lit(1.0), F.col("rise") / (3 * rise))).drop("_days")
