"""Small tables on which queries once differed from their SQL, lost rows or grew too fast."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import baseline, explain
from fleetscope.plans.catalog import ORACLE_SQL, QUERIES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY_ONE = datetime(2024, 1, 2)


@pytest.fixture
def shown(spark, tmp_path):
    """Rows of a query and of its SQL over events (user, type, seconds, value), as sorted dictionaries."""

    def run(name, events):
        rows = [(k, DAY_ONE + timedelta(seconds=s), user, kind, value, None) for k, (user, kind, s, value) in enumerate(events)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = con.sql(ORACLE_SQL[name])
        got = [r.asDict() for r in QUERIES[name](spark, str(tmp_path)).collect()]
        order = lambda rows: sorted(rows, key=lambda r: str(sorted(r.items())))
        return order(got), order([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])

    return run


def test_observers_of_any_number(shown):
    got, want = shown("auto_labels", [(0, "view", 0, 1.0)] * 6 + [(2003, "error", 0, 130.0), (2004, "error", 0, 130.0)] * 3)
    assert got == want and "observer_unseen" in {r["auto_label_reason"] for r in got}


def test_ratio_of_nothing_to_nothing(shown):
    got, want = shown("leak_verdicts", [(1, "view", 0, 0.0), (2, "view", 0, 0.0), (2, "view", 90_000, 7.0), (3, "view", 0, 3.0)])
    assert got == want and [r["ratio"] for r in got if r["pid"] == 1] == [1.0] and float("inf") in {r["ratio"] for r in got}


def test_seconds_near_a_half_at_the_seventh_place(shown):
    # The times' differences as doubles: 325857.84010005 and 272185.48072505, whose products lie below a half.
    got, want = shown("leak_verdicts", [(1, "view", 34229.610445, 1.0), (1, "view", 360087.450545, 2.0), (2, "view", 51563.590349, 3.0), (2, "view", 323749.071074, 2.0)])
    assert got == want and {r["seconds"] for r in got} == {0.0, 325857.8401, 272185.480725}


def test_means_at_a_half_thousandth(shown):
    # 16 samples whose mean is 64.1925: doubles next to it lie on both sides.
    got, want = shown("minute_board", [(k, "click", 60 * k, 64.19 if k % 2 else 64.195) for k in range(16)] + [(30 + k, "view", k, v) for k, v in enumerate((45.543, 45.544))])
    assert got == want and {r["cpu_total_mean"] for r in got} == {64.193, 45.544}


@pytest.mark.parametrize("name", ["rule_detector", "rule_detector_programs"])
def test_sigma_at_a_half(shown, name):
    # The median distance is 12.125, its sigma 17.976525.
    got, want = shown(name, [(0, "click", 600 * k, 40.0 + 24.25 * (k % 3 - 1)) for k in range(30)] + [(0, "click", 600 * 31, 150.0)])
    assert got == want and got


def test_equal_growth_is_ranked_by_name(shown):
    rise = 0.01
    grown = [(k, kind, s, v) for k, kind, low in ((0, "click", 10.0), (2, "purchase", 30.0)) for s, v in ((0, low), (3600, low + rise))]
    assert (10.0 + rise) - 10.0 < (30.0 + rise) - 30.0
    got, want = shown("stock_growth", [*grown, (9, "error", 7200, 120.0)])
    assert got == want and {r["name"]: r["rank"] for r in got} == {"click": 1, "purchase": 2}


def test_gated_baseline_learns_every_loaded_sample(shown):
    got, want = shown("gated_baseline", [(0, "click", 60 * k, 30.0 + k) for k in range(9)] + [(0, "view", 600, 1.0)])
    assert got == want and [r["samples"] for r in got if r["id"] == 9] == [9]


def test_flows_by_chunks_equal_flows_by_rows(spark):
    rng = np.random.default_rng(3)
    names, pids = ("a", "b", "svchost.exe", None), (1, 2, 3, None)
    rows = [("h%d" % rng.integers(2), float(rng.integers(4000)), pids[rng.integers(4)], names[rng.integers(4)], float(rng.integers(-3, 20)) if rng.random() > 0.1 else None) for _ in range(900)]
    processes = spark.createDataFrame(rows, "source string, ts double, pid int, name string, value double")
    spans = [("h%d" % (k % 3), k, s, s + w) for k, (s, w) in enumerate((float(s), float(w)) for s in range(0, 4000, 150) for w in (0, 90, 400, 2000))]
    incidents = spark.createDataFrame(spans, "source string, id int, start double, end double")
    found = lambda longest: {(r["source"], r["id"], r["rank"]): r.asDict() for r in explain.flow_contributors(incidents, processes, "value", (600.0, 30.0), 3, longest).collect()}
    whole, mixed, old = found(1e9), found(300.0), found(-1.0)
    assert len(old) > 100 and whole.keys() == old.keys() == mixed.keys()
    for k, r in old.items():
        for made in (whole[k], mixed[k]):
            assert {c: made[c] if isinstance(made[c], (str, list, bool, int, type(None))) else pytest.approx(r[c]) for c in r} == r


def test_rows_are_not_copied_to_every_incident(spark):
    """300 incidents in one hour hold 2000 rows each: what is shuffled does not grow with their product."""
    rows = spark.range(2000).selectExpr("'h' AS source", "id * 1.0D AS ts", "id % 50 AS pid", "concat('p', id % 50) AS name", "id % 7 * 1.0D AS value")
    incidents = spark.range(300).selectExpr("'h' AS source", "id", "2000 + id * 0.1D AS start", "2100 + id * 0.1D AS end")
    joined = explain.flow_contributors(incidents, rows, "value", (3000.0, 30.0))
    assert "FlatMapCoGroupsInArrow" in joined._jdf.queryExecution().toString()


def test_only_judged_rows_come_out_and_all_are_learnt(spark):
    s = spark.range(400).selectExpr("'h' AS source", "id * 300.0D AS ts", "id % 13 * 1.0D AS value", "id % 5 AS kind")
    config = baseline.Baseline(7200.0, 5)
    some = baseline.rolling_dense(s, config=config, judged=F.col("kind") == 2)
    assert some.columns == baseline.rolling_dense(s, config=config).columns
    for chunk in (3600.0, 6 * 3600.0):
        assert sorted(some.collect()) == sorted(baseline.rolling_dense(s, config=config, chunk=chunk).where("kind = 2").collect())


def test_runs_of_one_incident_equal_those_of_columns(spark):
    """Onsets and recoveries, samples of one time among them."""
    rng = np.random.default_rng(8)
    rows = [("h", k, float(t), float(rng.choice([1.0, 9.0, np.nan], p=[0.6, 0.38, 0.02])), 5.0, 1.0, 100.0) for k in range(60) for t in np.sort(rng.integers(60, 140, rng.integers(1, 60))).tolist()]
    df = spark.createDataFrame(rows, "source string, id int, ts double, value double, median double, sigma double, signal_ts double")
    onsets = {r["id"]: r["onset"] for r in explain.onset(df, calm_run=3, least_hot=2).collect()}
    ends = {r["id"]: r["recovery"] for r in explain.recovery(df, calm_run=3).collect()}
    assert len(onsets) > 20 and len(ends) > 20
    for k in range(60):
        t, x = (np.array([r[c] for r in rows if r[1] == k]) for c in (2, 3))
        hot = (x >= 7.0) | np.isnan(x)
        assert explain._onset(t[t <= 100], hot[t <= 100], 3, 2) == onsets.get(k)
        assert explain._recovery(t[t >= 100], hot[t >= 100], 3) == ends.get(k)


def refined_by_steps(incident, rows, before, after, look_back, least):
    """Bounds of one incident by plain lists; rows are (source, ts, values of the metrics)."""
    source, who, start, end = incident
    end = start if end is None else end
    best = (start, end)
    for m in range(2):
        own = sorted((r[1], r[2 + m]) for r in rows if r[0] == source and r[2 + m] is not None)
        prior = [v for t, v in own if start - look_back <= t < start]
        if len(prior) < least:
            continue
        median = float(np.median(prior))
        sigma = max(float(np.median(np.abs(np.array(prior) - median))) * 1.4826, abs(median) * 0.05)
        if sigma <= 0:
            continue
        hot, calm, first, count = median + 2 * sigma, 0, start, 0
        for t, v in reversed([s for s in own if start - before <= s[0] <= min(start, end + after)]):
            calm = 0 if v >= hot else calm + 1
            if calm >= 3:
                break
            if v >= hot:
                first, count = t, count + 1
        first, calm, last = first if count >= 2 else start, 0, end
        for t, v in (s for s in own if max(end, start - before) <= s[0] <= end + after):
            calm = 0 if v >= hot else calm + 1
            if calm == 2:
                last = t
                break
        if last - first > best[1] - best[0]:
            best = (first, last)
    return best


def test_bounds_by_chunks_equal_bounds_by_steps(spark):
    rng = np.random.default_rng(9)
    value = lambda: None if rng.random() < 0.1 else float(rng.choice([10.0, 11.0, 12.0, 40.0]))
    rows = [(f"h{rng.integers(3)}", float(t), value(), value() if t < 4000 else 0.0) for t in rng.choice(12_000, 1500, replace=False)]
    metrics = spark.createDataFrame(rows, "source string, ts double, cpu_total double, mem_percent double")
    spans = [(f"h{rng.integers(4)}", k, s, None if k % 7 == 0 else s + float(w)) for k, (s, w) in enumerate((float(s), w) for s in range(0, 12_000, 130) for w in (0, 50, 700, 5000))]
    incidents = spark.createDataFrame(spans, "source string, id int, ts_start double, ts_end double")
    for before, after, look_back in ((200.0, 300.0, 600.0), (900.0, 20.0, 400.0)):
        found = explain.refined_bounds(incidents, metrics, ("cpu_total", "mem_percent"), before, after, look_back, 10, 3, 2, 2)
        got = {r["id"]: (r["start"], r["end"]) for r in found.collect()}
        want = {i[1]: refined_by_steps(i, rows, before, after, look_back, 10) for i in spans}
        assert got == want and sum(got[i[1]] != (i[2], i[2] if i[3] is None else i[3]) for i in spans) > 50


def test_bounds_copy_no_sample_to_every_incident(spark):
    metrics = spark.range(3000).selectExpr("'h' AS source", "id * 1.0D AS ts", "IF(id BETWEEN 2000 AND 2050, 80, 20 + id % 3) * 1.0D AS cpu_total")
    incidents = spark.range(300).selectExpr("IF(id = 7, NULL, 'h') AS source", "IF(id = 8, NULL, id) AS id", "IF(id = 9, NULL, 2000 + id * 0.1D) AS ts_start", "CAST(NULL AS DOUBLE) AS ts_end")
    found = explain.refined_bounds(incidents, metrics)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert len(rows) == 300 and sum(r["end"] == 2055.0 for r in rows) == 297
    # Without a machine, a number or a start an incident keeps its own bounds.
    assert sorted((r["start"], r["end"]) for r in rows if r["start"] is not None and r["end"] != 2055.0) == [(2000.7, 2000.7), (2000.8, 2000.8)]
