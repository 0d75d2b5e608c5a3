"""Rules and incidents on live streams: rows wait until the watermark has passed them, are taken in order, and change kept state.

So a stream gives what the batch operators give on the same rows, however they were split into micro-batches or came out of
order within the watermark, and over a restart from the checkpoint. Rows behind the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import SEVERITIES
from ..operators.baseline import Baseline
from ..operators.detect import numeric_metrics
from ..operators.order_stats import window_stats
from ..operators.rules import Rule

#: Seconds of ticks in one entry of the window's map state; a micro-batch rewrites the entries that it adds to alone.
SLOT = 60.0


class InOrder(StatefulProcessor):
    """Keeps rows (JSON) with their times until the watermark passes them and hands them to ``take`` in order of ``sort``.

    ``take(key, rows, upto)`` gives the result rows and the next time at which it wants to be called, or None.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ts double, row string")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Sets up further state."""

    def take(self, key: tuple, rows: list[dict], upto: float) -> tuple[list[tuple], float | None]:
        raise NotImplementedError

    def sort(self, row: dict) -> tuple:
        return (row["ts"],)

    def _advance(self, key: tuple, fresh: list[tuple[float, str]], upto: float) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        held += fresh
        ripe = sorted((json.loads(row) for ts, row in held if ts <= upto), key=self.sort)
        left = [(ts, row) for ts, row in held if ts > upto]
        out, due = self.take(key, ripe, upto)
        if left:
            self.pending.put(left)
        elif held:
            self.pending.clear()
        times = [min(ts for ts, _ in left)] if left else []
        for at in [*times, *([due] if due is not None else [])]:
            self.handle.registerTimer(int(np.ceil(at * 1000)))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(float(t), r) for part in rows for t, r in zip(part["ts"], part["row"], strict=True)]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


INCIDENT_SCHEMA = "source string, session long, event string, ts_start double, ts_end double, severity string, signal_count long, peak_score double, detectors array<string>"


class Incidents(InOrder):
    """The open incident of a source: opened by a signal, changed by those that follow within ``gap``, closed by the first that does not or by a timer."""

    columns = ["source", "session", "event", "ts_start", "ts_end", "severity", "signal_count", "peak_score", "detectors"]

    def __init__(self, gap: float):
        self.gap = gap

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("incident", "session long, running boolean, start double, last double, rank int, n long, peak double, detectors array<string>")

    def sort(self, row: dict) -> tuple:
        return row["ts"], row["detector"], row["score"]

    def take(self, key: tuple, rows: list[dict], upto: float) -> tuple[list[tuple], float | None]:
        session, running, start, last, rank, n, peak, names = tuple(self.current.get()) if self.current.exists() else (-1, False, 0.0, 0.0, 0, 0, 0.0, [])
        names, out, changed = list(names), [], ""
        told = lambda event, end: (key[0], session, event, start, end, SEVERITIES[rank], n, peak, sorted(names))
        for r in rows:
            level = SEVERITIES.index(r["severity"]) if r["severity"] in SEVERITIES else 0
            if running and r["ts"] - last > self.gap:
                out.append(told("close", last))
                running, changed = False, ""
            if running:
                names = sorted({*names, r["detector"]})
                # Agreement of two detectors raises the incident a step with every signal.
                rank = min(max(rank, level) + (len(names) >= 2), len(SEVERITIES) - 1)
                n, peak, changed = n + 1, max(peak, r["score"]), changed or "update"
            else:
                session, running, start, rank, n, peak, names, changed = session + 1, True, r["ts"], level, 1, r["score"], [r["detector"]], "open"
                out.append((key[0], session, "open", start, None, SEVERITIES[rank], 1, peak, names))
                changed = ""
            last = r["ts"]
        if running and upto - last > self.gap:
            out.append(told("close", last))
            running = False
        elif changed:
            out.append(told("update", None))
        if rows or not running:
            self.current.update((session, running, start, last, rank, n, peak, names))
        # Closing needs the watermark to be past the gap, by a millisecond at least.
        return out, last + self.gap + 0.001 if running else None


def incident_stream(signals: DataFrame, gap: float = 120.0, late: str = "15 seconds") -> DataFrame:
    """(source, session, event, ts_start, ts_end, severity, signal_count, peak_score, detectors) of live incidents.

    ``signals`` has source, ts (epoch seconds), detector, score, severity. An incident is given out when it opens, once for
    each micro-batch that changes it, and when it closes; ``session`` is its number among its source's, which it keeps. Closed
    ones equal ``decide.fold`` of ``decide.fuse``. Signals without a source or time are left out.
    """
    own = signals.where("source is not null and ts is not null").select("source", "ts", F.to_json(F.struct("ts", "detector", "score", "severity")).alias("row"), F.timestamp_seconds("ts").alias("event_time"))
    return own.withWatermark("event_time", late).groupBy("source").transformWithStateInPandas(Incidents(gap), INCIDENT_SCHEMA, "Append", "EventTime")


def linear(value: str) -> dict[str, float]:
    """A threshold as coefficients by name (an empty name for the constant): a sum of numbers, names, and products of one name with numbers."""
    out: dict[str, float] = {}
    for term in value.split("+"):
        name, factor = "", 1.0
        for part in map(str.strip, term.split("*")):
            try:
                factor *= float(part)
            except ValueError:
                if name or not part.replace("_", "a").isalnum():
                    raise ValueError(f"no sum of products of a name and numbers: {value}") from None
                name = part
        out[name] = out.get(name, 0.0) + factor
    return out


RULE_SCHEMA = "source string, ts double, rule string, severity string, score double, fired array<string>, sustained_s double"
_COMPARE = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal, "==": np.equal, "!=": np.not_equal}


class RuleClocks(InOrder):
    """Windows of the rules' metrics in slots of a map state, and each rule's hold and cooldown in another."""

    columns = ["source", "ts", "rule", "severity", "score", "fired", "sustained_s"]

    def __init__(self, rules: Sequence[Rule], config: Baseline, ttl: int | None):
        self.rules, self.config, self.ttl = list(rules), config, ttl
        self.metrics = numeric_metrics(rules)
        self.limits = [[linear(c.value) if c.op in _COMPARE else {} for c in r.conditions] for r in rules]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("window", "slot long", "t array<double>, x array<double>", self.ttl)
        self.clocks = handle.getMapState("clocks", "rule int", "since double, last double")

    def _truths(self, rows: list[dict], value: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = []
        for rule, limits in zip(self.rules, self.limits, strict=True):
            parts = []
            for c, limit in zip(rule.conditions, limits, strict=True):
                if c.op in _COMPARE:
                    bound = sum((k * (value[n] if n in value else np.array([np.nan if r.get(n) is None else float(r[n]) for r in rows])) if n else np.full(len(rows), k) for n, k in limit.items()), np.zeros(len(rows)))
                    known = ~np.isnan(value[c.metric]) & ~np.isnan(bound)
                    with np.errstate(invalid="ignore"):
                        parts.append(known & _COMPARE[c.op](value[c.metric], bound))
                else:
                    texts = [r.get(c.metric) for r in rows]
                    parts.append(np.array([t is not None and (c.value.lower() in str(t).lower()) == (c.op == "contains") for t in texts], bool))
            out.append(np.logical_and.reduce(parts) if rule.mode == "all" else np.logical_or.reduce(parts))
        return out

    def take(self, key: tuple, rows: list[dict], upto: float) -> tuple[list[tuple], float | None]:
        if not rows:
            return [], None
        names, width = self.metrics, len(self.metrics)
        kept = {int(k[0]): (list(v[0]), list(v[1])) for k, v in self.slots.iterator()} if self.slots.exists() else {}
        touched = set()
        for r in rows:
            slot = int(r["ts"] // SLOT)
            t, x = kept.setdefault(slot, ([], []))
            t.append(r["ts"])
            x.extend(np.nan if r.get(m) is None else float(r[m]) for m in names)
            touched.add(slot)
        order = sorted(kept)
        times = np.array([s for k in order for s in kept[k][0]])
        values = np.array([s for k in order for s in kept[k][1]]).reshape(len(times), width)
        place = np.arange(len(times) - len(rows), len(times))
        value, ready, zs = {}, np.zeros(len(rows), bool), {}
        for k, m in enumerate(names):
            found = window_stats(times, values[:, k], self.config.window, place)
            enough = found[:, 2] >= self.config.least_samples
            ready |= enough
            median, mad = (np.where(enough, found[:, c], np.nan) for c in (0, 1))
            sigma = np.maximum(np.maximum(mad * 1.4826, self.config.floor), np.abs(median) * self.config.relative_floor)
            sigma = np.where(sigma > 0, sigma, np.nan)
            value |= {m: values[place, k], f"{m}_median": median, f"{m}_mad": mad, f"{m}_sigma": sigma}
            zs[m] = np.abs((values[place, k] - median) / sigma)
        truths = self._truths(rows, value)
        out, clocks = [], {}
        for r in range(len(self.rules)):
            clocks[r] = list(self.clocks.getValue((r,))) if self.clocks.containsKey((r,)) else [np.nan, np.nan]
        for i in np.flatnonzero(ready).tolist():
            ts, fired = rows[i]["ts"], []
            for r, rule in enumerate(self.rules):
                clock = clocks[r]
                if not truths[r][i]:
                    clock[0] = np.nan
                    continue
                clock[0] = ts if np.isnan(clock[0]) else clock[0]
                if ts - clock[0] >= rule.hold and not ts - clock[1] < rule.cooldown:
                    clock[1] = ts
                    fired.append(r)
            if fired:
                top = max(fired, key=lambda r: SEVERITIES.index(self.rules[r].severity))
                best = np.nanmax([0.0, *(zs[c.metric][i] for c in self.rules[top].conditions if c.metric in zs)])
                out.append((key[0], ts, self.rules[top].name, self.rules[top].severity, float(min(best / 8, 1.0)) if best > 0 else 0.5, [self.rules[r].name for r in fired], round(ts - clocks[top][0], 1)))
        oldest = int((times[-1] - self.config.window) // SLOT)
        for slot in order:
            if slot < oldest:
                if slot not in touched or self.slots.containsKey((slot,)):
                    self.slots.removeKey((slot,))
            elif slot in touched:
                self.slots.updateValue((slot,), kept[slot])
        for r, clock in clocks.items():
            self.clocks.updateValue((r,), tuple(map(float, clock)))
        return out, None


def rule_stream(ticks: DataFrame, rules: Sequence[Rule], config: Baseline = Baseline(), late: str = "15 seconds", ttl: int | None = None) -> DataFrame:
    """(source, ts, rule, severity, score, fired, sustained_s): ``detect.rule_detector`` on a live stream of ticks, with the usual window's baselines.

    Conditions compare with a number, or with a sum of names and products of a name with numbers. Suspect ticks, and
    ticks without a source or time, are passed over. ``ttl`` (milliseconds) lets a silent source's window go.
    """
    own = ticks.where("source is not null and ts is not null")
    own = own.where(~F.coalesce("suspect", F.lit(False))) if "suspect" in ticks.columns else own
    row = F.to_json(F.struct(*(c for c in own.columns if c not in ("source", "event_time"))))
    own = own.select("source", F.col("ts").cast("double").alias("ts"), row.alias("row"), F.timestamp_seconds("ts").alias("event_time"))
    return own.withWatermark("event_time", late).groupBy("source").transformWithStateInPandas(RuleClocks(rules, config, ttl), RULE_SCHEMA, "Append", "EventTime")
