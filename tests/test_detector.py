"""The assembled rule detector and the order statistics window against plain step-by-step versions."""

import statistics

import numpy as np
import pytest

from fleetscope.operators import baseline, detect
from fleetscope.operators.baseline import Baseline
from fleetscope.operators.order_stats import SortedWindow, window_stats
from fleetscope.operators.rules import Condition, Rule

RULES = (
    Rule("a", (Condition("x", ">", "x_median + 2 * x_sigma"), Condition("y", ">", "3")), 20, 60, "warning", "all", "x {x} usually {x.median}"),
    Rule("b", (Condition("y", ">", "5"),), 0, 100, "info", "any", "y {y}"),
    Rule("c", (Condition("x", ">", "x_median"),), 45, 300, "critical"),
    Rule("d", (Condition("name", "contains", "HOT"), Condition("y", ">", "1")), 10, 37.5, "warning"),
    Rule("e", (Condition("y", ">", "y_load_median + 1"),), 5, 50, "info"),
    Rule("f", (Condition("missing", ">", "1"), Condition("y", ">", "no_such_thing * 2")), 0, 1, "critical"),
)
SCHEMA = "source string, ts double, x double, y double, name string, suspect boolean, g double, foreground_program string"


def random_ticks(seed=1, n=1200):
    rng, rows = np.random.default_rng(seed), []
    for host in ("p", "q"):
        t, x, y = 1000.0 + float(rng.integers(0, 5)), 0.0, 0.0
        for _ in range(n):
            t += float(rng.choice([1, 1, 1, 2, 40, 400], p=[0.6, 0.2, 0.1, 0.08, 0.015, 0.005])) + float(rng.integers(0, 3)) / 3
            x, y = 0.97 * x + float(rng.normal()), 0.98 * y + float(rng.normal())
            name = [None, "hot x", "cold"][int(rng.choice(3, p=[0.02, 0.95, 0.03]))]
            rows.append((host, t, x if rng.random() > 0.03 else None, y + 4 if rng.random() > 0.02 else None, name, bool(rng.random() < 0.02), float(rng.random()), [None, "one", "two"][int(rng.choice(3))]))
    return rows


class Axis:
    """A learnt window: samples closer than ``spacing`` to the last one are passed over."""

    def __init__(self, window, least, spacing=0.0):
        self.window, self.least, self.spacing, self.held = window, least, spacing, []

    def add(self, t, v):
        if v is not None and not (self.held and t - self.held[-1][0] < self.spacing):
            self.held = [h for h in [*self.held, (t, v)] if h[0] >= t - self.window]

    def stats(self, t=None):
        own = [v for s, v in self.held if t is None or s >= t - self.window]
        if len(own) < self.least:
            return None
        m = statistics.median(own)
        return m, max(statistics.median([abs(v - m) for v in own]) * 1.4826, abs(m) * 0.05)


def step_by_step(rows, programs):
    out = []
    for host in ("p", "q"):
        usual, load, own = {m: Axis(300, 20) for m in "xy"}, Axis(900, 10, 7.0), {}
        since, last = {}, {}
        for _, t, x, y, name, suspect, g, program in (r for r in rows if r[0] == host):
            if suspect:
                continue
            usual["x"].add(t, x), usual["y"].add(t, y)
            if g >= 0.7:
                load.add(t, y)
            if program:
                own.setdefault(program, Axis(600, 8, 5.0)).add(t, x)
            xs, ys, loaded = usual["x"].stats(t), usual["y"].stats(t), load.stats()
            if not (xs or ys):
                continue
            decides = own[program].stats() if programs and program else xs
            above = lambda k: x is not None and decides is not None and x > decides[0] + k * decides[1]  # noqa: B023, E731
            true = [above(2) and y is not None and y > 3, y is not None and y > 5, above(0), bool(name) and "hot" in name and y is not None and y > 1, y is not None and loaded is not None and y > loaded[0] + 1, False]
            fired = []
            for k, ok in enumerate(true):
                if not ok:
                    since.pop(k, None)
                    continue
                if t - since.setdefault(k, t) >= RULES[k].hold and not (k in last and t - last[k] < RULES[k].cooldown):
                    last[k] = t
                    fired.append(k)
            if fired:
                top = max(fired, key=lambda k: ["info", "warning", "critical"].index(RULES[k].severity))
                zs = [abs((v - s[0]) / s[1]) for m, v, s in (("x", x, xs), ("y", y, ys)) if v is not None and s and s[1] > 0 and any(c.metric == m for c in RULES[top].conditions)]
                out.append((host, t, RULES[top].name, [RULES[k].name for k in fired], round(min(1, max(zs) / 8), 6) if zs and max(zs) else 0.5, round(t - since[top], 1)))
    return sorted(out)


def setup(chunk, programs):
    return detect.Setup(usual=Baseline(300.0, 20), program=Baseline(600.0, 8) if programs else None, program_spacing=5.0, load=Baseline(900.0, 10), load_spacing=7.0, gates={"y": detect.LoadGate("g", 0.7)}, chunk=chunk)


@pytest.mark.parametrize(("chunk", "programs"), [(250.0, False), (1e6, False), (700.0, True)])
def test_signals_equal_a_step_by_step_engine(spark, chunk, programs):
    rows = random_ticks()
    signals = detect.rule_detector(spark.createDataFrame(rows, SCHEMA), RULES, setup(chunk, programs)).collect()
    got = sorted((r["source"], r["ts"], r["rule"], r["fired"], round(r["score"], 6), r["sustained_s"]) for r in signals)
    assert got == step_by_step(rows, programs)
    assert {r["rule"] for r in signals} == set("abcde")
    shown = next(r for r in signals if r["rule"] == "a")
    assert shown["explanation"] == f"x {shown['evidence']['x']['value']:.1f} usually {shown['evidence']['x']['median']:.1f}"


def test_a_hold_over_whole_chunks_and_its_cooldown(spark):
    """True all along: fires after the hold, then each cooldown, as if there were no chunks."""
    rows = [("h", float(t), 1.0, 9.0, None, False, 0.0, None) for t in range(0, 2000)]
    rule = (Rule("long", (Condition("y", ">", "5"),), 500, 130, "info"),)
    got = [r["ts"] for r in detect.rule_detector(spark.createDataFrame(rows, SCHEMA), rule, setup(300.0, False)).orderBy("ts").collect()]
    first = 19 + 500  # twenty samples make the baseline ready
    assert got == [float(t) for t in range(first, 2000, 130)]


@pytest.mark.parametrize("chunk", [300.0, 1e6])
def test_nothing_runs_on_over_a_gap_in_time(spark, chunk):
    rows = [("h", float(t), 1.0, 9.0, None, False, 0.0, None) for t in range(0, 2000)]
    gaps = spark.createDataFrame([("h", 400.5), ("h", 900.0), ("h", 905.0), ("other", 700.0)], "source string, ts double")
    rule = (Rule("long", (Condition("y", ">", "5"),), 350, 10_000, "info"), Rule("short", (Condition("y", ">", "5"),), 100, 200, "info"))
    got = {r["ts"]: (r["fired"], r["sustained_s"]) for r in detect.rule_detector(spark.createDataFrame(rows, SCHEMA), rule, setup(chunk, False), gaps=gaps).collect()}
    want = {}
    for lo, hi in ((0, 401), (401, 900), (900, 905), (905, 2000)):
        last = [None, None]
        # Twenty ticks of a part are learnt before anything holds.
        for t in range(lo + 19, hi):
            held = t - (lo + 19)
            fired = [k for k in (0, 1) if held >= rule[k].hold and (last[k] is None or t - last[k] >= rule[k].cooldown)]
            for k in fired:
                last[k] = t
            if fired:
                want[float(t)] = ([rule[k].name for k in fired], held)
    assert got == want and any("long" in f for f, _ in want.values())


def test_no_ticks_and_ticks_without_a_time(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert detect.rule_detector(empty, RULES, setup(300.0, True)).count() == 0
    assert detect.rule_detector(spark.createDataFrame([("h", None, 1.0, 1.0, None, None, None, None)], SCHEMA), RULES, setup(300.0, False)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_window_equals_numpy(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    t, x = np.sort(rng.integers(0, 500, n)).astype(float), rng.integers(0, 20, n) / rng.integers(1, 7)
    x[rng.random(n) < 0.1] = np.nan
    window, rows = float(rng.integers(0, 200)), np.flatnonzero(rng.random(n) < rng.choice([0.1, 1]))
    for found, i in zip(window_stats(t, x, window, rows), rows, strict=True):
        own = x[(t >= t[i] - window) & (t <= t[i])]
        own = own[~np.isnan(own)]
        want = [np.median(own), np.median(np.abs(own - np.median(own))), len(own), own.min(), own.max()] if len(own) else [np.nan, np.nan, 0, np.nan, np.nan]
        assert np.allclose(found, want, rtol=1e-14, equal_nan=True)


def test_blocks_split_and_vanish():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 5000, 9000).astype(float).tolist()
    held = SortedWindow()
    for v in values:
        held.add(v)
    for v in values[:8500]:
        held.remove(v)
    assert [held.at(k) for k in range(held.n)] == sorted(values[8500:])


def test_gated_baseline_is_null_until_ready_and_keeps_its_spacing(spark):
    rows = [("h", float(t), 60.0 + t, 90.0 if t % 2 else 10.0) for t in range(40)]
    out = baseline.load_gated(spark.createDataFrame(rows, "source string, ts double, v double, load double"), "v", "load", 80.0, config=Baseline(1000.0, 5), spacing=4.0)
    got = {r["ts"]: (r["samples"], r["median"]) for r in out.collect()}
    assert got[0.0] == (None, None) and got[1.0] == (1, None) and got[4.0] == (1, None) and got[17.0] == (5, 69.0) and got[18.0] == (5, 69.0)
