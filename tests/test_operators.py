"""Hand-computed cases and negatives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.functions import columns
from fleetscope.operators import baseline, decide, derive, evaluate, explain, intervals, joins, leak, rollup, rules


def spans(spark, *pairs):
    return spark.createDataFrame([("h", float(a), float(b)) for a, b in pairs], "source string, lo double, hi double")


def pairs(df):
    return sorted((r["lo"], r["hi"]) for r in df.collect())


@pytest.mark.parametrize(("given", "want"), [([(0, 10), (5, 20)], [(0, 20)]), ([(0, 10), (10, 20)], [(0, 20)]), ([(0, 5), (7, 9)], [(0, 5), (7, 9)]), ([(5, 5)], [])])
def test_union(spark, given, want):
    assert pairs(intervals.union(spans(spark, *given))) == want


def test_complement_and_subtract(spark):
    whole, blocks = spans(spark, (0, 100)), spans(spark, (10, 20), (15, 30), (90, 120))
    assert pairs(intervals.complement(intervals.union(blocks), whole)) == [(0, 10), (30, 90)]
    assert pairs(intervals.subtract(whole.withColumn("id", F.lit(1)), blocks)) == [(0, 10), (30, 90)]


def test_exclusion_drops_a_bucket_that_starts_before_the_fault(spark):
    buckets = spark.createDataFrame([("h", float(b)) for b in (0, 300, 600)], "source string, bucket double")
    assert [r["bucket"] for r in intervals.outside(buckets, spans(spark, (310, 320)), 300).orderBy("bucket").collect()] == [0, 600]


def test_minute_bucket(spark):
    rows = [("h", 60.0 + i, float(i), 50.0) for i in range(60)]
    r = rollup.minute_rollup(spark.createDataFrame(rows, "source string, ts double, cpu_total double, cpu_max_core double")).first()
    assert (r["sample_count"], r["cpu_total_mean"], r["cpu_total_max"], r["cpu_total_p95"], r["cpu_imbalance_mean"]) == (60, 29.5, 59, 56, 20.5)


def test_counter_rate_resets(spark):
    rows = [("h", 0.0, 10.0), ("h", 1.0, 15.0), ("h", 2.0, 3.0), ("h", 4.0, 7.0)]
    got = derive.counter_rate(spark.createDataFrame(rows, "source string, ts double, v double"), "v", "rate").orderBy("ts")
    assert [r["rate"] for r in got.collect()] == [None, 5.0, None, 2.0]


def test_sustained_rule_fires_after_thirty_seconds(spark):
    rows = [("h", float(i), 20.0 + i % 3 if i < 200 else 90.0) for i in range(260)]
    fired = rules.sustained(spark.createDataFrame(rows, "source string, ts double, v double"), F.col("v") > 80, 30)
    assert fired.agg(F.min("ts")).first()[0] == 230
    assert [r["ts"] for r in rules.cooled(fired, 15).orderBy("ts").collect()] == [230, 245]


def test_strict_and_is_null_where_sql_is_false(spark):
    r = spark.range(1).select(columns.strict_and(F.lit(None).cast("boolean"), F.lit(False)).alias("x")).first()
    assert r["x"] is None


def test_dense_baseline_equals_window(spark):
    rng = np.random.default_rng(0)
    rows = [("h", float(i), float(x)) for i, x in enumerate(rng.normal(50, 5, 400))]
    df = spark.createDataFrame(rows, "source string, ts double, value double")
    config = baseline.Baseline(60.0, 10)
    a, b = (sorted((r["ts"], round(r["median"], 6), round(r["mad"], 6), r["samples"]) for r in f.collect()) for f in (baseline.rolling(df, config=config), baseline.rolling_dense(df, config=config, chunk=100.0)))
    assert a == b


def test_nearest_takes_the_later_on_a_tie(spark):
    a = spark.createDataFrame([("h", 10.0)], "source string, ts double")
    b = spark.createDataFrame([("h", 9.0, "early"), ("h", 11.0, "late")], "source string, ts double, x string")
    assert joins.nearest(a, b, 1.5).first()["x"] == "late"


@pytest.mark.parametrize(("change", "reason"), [({}, ""), ({"ratio": 1e9}, "ratio"), ({"delta": 1e9}, "delta"), ({"samples": 9999}, "samples"), ({"duration": 1e9}, "duration")])
def test_leak_gates(change, reason):
    t = np.arange(600.0)
    rule = leak.LeakRule("handles", **({"delta": 100.0, "window": 1e9} | change))
    assert leak.judge(t, 400 + 10 * t, rule)[4] == reason


def test_suppression_chain(spark):
    rows = [("h", 1, 0.0, 10.0, "critical"), ("h", 2, 5.0, 20.0, "warning"), ("h", 3, 15.0, 30.0, "info")]
    got = decide.suppress(spark.createDataFrame(rows, "source string, id long, ts_start double, ts_end double, severity string"))
    assert {r["id"]: r["suppressed_by"] for r in got.collect()} == {1: None, 2: 1, 3: None}


def test_fold_raises_severity_once_two_detectors_agree(spark):
    rows = [("h", 0.0, "a", 0.5, "info"), ("h", 10.0, "b", 0.5, "info"), ("h", 500.0, "a", 0.9, "info")]
    got = decide.fold(decide.fuse(spark.createDataFrame(rows, "source string, ts double, detector string, score double, severity string"))).orderBy("ts_start").collect()
    assert [(r["signal_count"], r["severity"]) for r in got] == [(2, "warning"), (1, "info")]


def test_perfect_detector_scores_one(spark):
    episodes = spark.createDataFrame([("h", 1, 100.0, 200.0), ("h", 2, 500.0, 600.0)], "source string, id long, lo double, hi double")
    hits = spark.createDataFrame([("h", "d", 130.0, 1.0), ("h", "d", 530.0, 1.0)], "source string, detector string, ts double, score double")
    r = evaluate.scores(evaluate.alarms(hits), episodes).first()
    assert (r["f1"], r["fp"], r["latency"]) == (1.0, 0, 30.0)


CALM = {"cpu_total": 10.0, "cpu_max_core": 20.0, "mem_percent": 40.0, "mem_avail_mb": 9000.0, "disk_resp_ms": 0.5, "disk_queue": 0.0, "ctx_switches_ps": 20_000.0, "gpu_temp_c": 60.0, "swap_used_mb": 0.0}
#: For each rule of the default pack what makes it fire, and the same just short of it.
HOT = {
    "cpu_overload": ({"cpu_total": 61.0}, {"cpu_total": 60.0}), "single_core": ({"cpu_max_core": 91.0}, {"cpu_max_core": 91.0, "cpu_total": 50.0}), "memory_pressure": ({"mem_percent": 81.0}, {"mem_percent": 44.0}),
    "memory_growth": ({"mem_percent": 46.0}, {"mem_percent": 45.0}), "disk_response": ({"disk_resp_ms": 5.5}, {"disk_resp_ms": 5.0}), "disk_queue": ({"disk_queue": 4.5}, {"disk_queue": 4.0}),
    "context_switches": ({"ctx_switches_ps": 64_001.0}, {"ctx_switches_ps": 64_000.0}), "gpu_heat": ({"gpu_temp_c": 91.0, "gpu_throttle_reasons": "SwThermal"}, {"gpu_temp_c": 91.0}),
    "gpu_critical_heat": ({"gpu_temp_c": 96.0, "gpu_throttle_reasons": "hw_thermal"}, {"gpu_temp_c": 96.0, "gpu_throttle_reasons": "SwPowerCap"}), "swap_use": ({"mem_percent": 76.0, "swap_used_mb": 801.0}, {"mem_percent": 76.0, "swap_used_mb": 800.0}),
}


def test_default_rules_fire_where_their_limits_are_passed(spark):
    rows = []
    for name, cases in HOT.items():
        for kind, change in zip(("hot", "calm"), cases, strict=True):
            for t in range(340):
                row = CALM | (change if t >= 20 else {})
                rows.append((f"{name}/{kind}", float(t), *(row[m] for m in CALM), row.get("gpu_throttle_reasons")))
    ticks = spark.createDataFrame(rows, "source string, ts double, " + ", ".join(f"{m} double" for m in CALM) + ", gpu_throttle_reasons string")
    for m in ("cpu_total", "mem_percent", "disk_resp_ms", "ctx_switches_ps"):
        ticks = ticks.withColumn(f"{m}_median", F.lit(CALM[m])).withColumn(f"{m}_sigma", F.lit(CALM[m] * 0.02)).withColumn(f"{m}_z", (F.col(m) - CALM[m]) / (CALM[m] * 0.02))
    ticks = ticks.withColumns({"cores": F.lit(8), "ram_mb": F.lit(16_000.0), "gpu_temp_c_load_median": F.lit(70.0)})
    found = {}
    for r in rules.rule_signals(ticks, rules.DEFAULT_RULES).collect():
        for name in r["fired"]:
            found.setdefault(r["source"], {}).setdefault(name, r["ts"])
    holds = {r.name: r.hold for r in rules.DEFAULT_RULES}
    for name in HOT:
        assert found[f"{name}/hot"][name] == 20 + holds[name]
        assert name not in found.get(f"{name}/calm", {})


@pytest.mark.parametrize(("last", "p99", "monotone", "want"), [(10.0, None, 1.0, (1, "unknown_leak")), (10.0, 0.0, 1.0, (1, "unknown_leak")), (9.0, 10.0, 1.0, (0, "leak")), (10.0, 10.0, 1.0, (1, "leak")), (20.0, 10.0, 1.0, (2, "leak")), (20.0, 10.0, 0.5, (1, "leak"))])
def test_leak_risk(spark, last, p99, monotone, want):
    made = spark.createDataFrame([(last, p99, monotone)], "last double, p99 double, monotone double")
    assert tuple(made.select(*leak.leak_risk(F.col("last"), F.col("p99"), F.col("monotone"))).first()) == want


def test_analysis_names_io_memory_and_gpu(spark):
    base = {"cpu_total": 20.0, "disk_resp_ms": 0.5, "mem_percent": 40.0}
    hot = {"io": {"disk_resp_ms": 30.0}, "memory": {"mem_percent": 95.0}, "gpu": {}}
    metrics, processes = [], []
    for source, change in hot.items():
        for t in range(0, 2400):
            row = base | (change if t >= 2000 else {})
            metrics.append((source, float(t), row["cpu_total"] + (t == 2010), row["disk_resp_ms"] + 0.01 * (t % 3), row["mem_percent"] + 0.1 * (t % 3)))
            for pid, name in ((1, "writer"), (2, "holder")):
                processes.append((source, float(t), pid, name, 5.0, 1e6 if pid == 1 and t >= 2000 else 10.0, 100.0 + (t - 1900) * (pid == 2 and t >= 1900)))
    m = spark.createDataFrame(metrics, "source string, ts double, cpu_total double, disk_resp_ms double, mem_percent double")
    p = spark.createDataFrame(processes, "source string, ts double, pid long, name string, cpu_percent double, io_write_bps double, rss_mb double")
    g = spark.createDataFrame([("gpu", 2011.0, 0, 99.0, 91.0, "SwThermal")], "source string, ts double, gpu_index int, util_percent double, temp_c double, throttle_reasons string")
    i = spark.createDataFrame([(s, 1, 2000.0, 2300.0, None) for s in hot], "source string, id long, ts_start double, ts_end double, trigger_metric string")
    got = {r["source"]: r for r in explain.analyze(i, m, p, g).collect()}
    assert {s: r["bottleneck"] for s, r in got.items()} == {"io": "IO", "memory": "MEMORY", "gpu": "THERMAL"}
    assert (got["io"]["contributors"][0]["name"], got["memory"]["contributors"][0]["name"]) == ("writer", "holder")
    assert (got["io"]["attributable"], got["gpu"]["attributable"]) == (True, False)


def test_suppression_names_the_earliest_and_leaves_open_ones(spark):
    rows = [("a", 1, 0.0, 5.0, "warning"), ("a", 2, 8.0, 20.0, "critical"), ("a", 3, 4.0, 9.0, "info"), ("b", 1, 0.0, 100.0, "critical"), ("b", 2, 50.0, None, "info"), ("b", 3, 900.0, 901.0, "info"),
            ("c", 1, 0.0, 10.0, "info"), ("c", 2, 0.0, 10.0, "info"), ("c", 3, 9.0, 30.0, "info"), ("c", 4, 25.0, 26.0, "info")]
    got = decide.suppress(spark.createDataFrame(rows, "source string, id long, ts_start double, ts_end double, severity string"))
    # An open incident is never hidden and hides what follows; equals that begin together hide neither; a hidden one hides nothing.
    assert {(r["source"], r["id"]): r["suppressed_by"] for r in got.collect()} == {("a", 1): None, ("a", 2): None, ("a", 3): 1, ("b", 1): None, ("b", 2): None, ("b", 3): 2, ("c", 1): None, ("c", 2): None, ("c", 3): 1, ("c", 4): None}


def test_scores_count_misses_without_alarms_and_alarms_without_episodes(spark):
    episodes = spark.createDataFrame([("hit", 1, 100.0, 200.0), ("missed", 1, 100.0, 200.0)], "source string, id long, lo double, hi double")
    hits = spark.createDataFrame([("hit", "d", 130.0, 1.0), ("noisy", "d", 130.0, 1.0)], "source string, detector string, ts double, score double")
    got = {r["source"]: (r["tp"], r["fn"], r["fp"], r["recall"], r["latency"]) for r in evaluate.scores(evaluate.alarms(hits), episodes).collect()}
    assert got == {"hit": (1, 0, 0, 1.0, 30.0), "missed": (0, 1, 0, 0.0, None), "noisy": (0, 0, 1, 0.0, None)}
    named = evaluate.scores(evaluate.alarms(hits.where("false")), episodes, detectors=["d", "e"]).collect()
    assert sorted((r["source"], r["detector"], r["fn"]) for r in named) == [(s, d, 1) for s in ("hit", "missed") for d in "de"]


def test_bounds_use_a_recovery_without_an_onset(spark):
    rows = [("h", float(t), 20.0 + 0.1 * (t % 3) + (60.0 if 1000 <= t <= 1050 else 0.0)) for t in range(3000)]
    i = spark.createDataFrame([("h", 1, 1000.0, 1000.0)], "source string, id long, ts_start double, ts_end double")
    r = explain.refined_bounds(i, spark.createDataFrame(rows, "source string, ts double, cpu_total double")).first()
    assert (r["start"], r["end"]) == (1000.0, 1055.0)


def test_gpu_is_device_zero_at_its_busiest(spark):
    i = spark.createDataFrame([("h", 1, 0.0, 100.0), ("g", 1, 0.0, 10.0)], "source string, id long, ts_start double, ts_end double")
    gpu = spark.createDataFrame([("h", 5.0, 1, 99.0, 95.0, "x"), ("h", 90.0, 0, 80.0, 60.0, "a"), ("h", 50.0, 0, 70.0, 70.0, "b"), ("g", 3.0, 0, 10.0, 50.0, None), ("g", 99.0, 0, 98.0, 50.0, None)], "source string, ts double, gpu_index int, util_percent double, temp_c double, throttle_reasons string")
    peaks = spark.createDataFrame([("h", 1, 3.0)], "source string, id long, peak_ts double")
    got = {r["source"]: (r["peak_ts"], r["gpu_util_percent"], r["gpu_temp_c"], r["throttle_reasons"]) for r in explain.with_gpu(peaks, i, gpu).collect()}
    assert got == {"h": (3.0, 80.0, 60.0, "a"), "g": (None, 10.0, 50.0, None)}


def test_descendants_of_chains_cycles_and_reused_pids(spark):
    chain = [("h", k, k + 1) for k in range(1, 40)] + [("h", 40, 41), ("h", 41, 40), ("h", 7, 7)]
    got = joins.descendants(spark.createDataFrame(chain, "source string, ppid long, pid long"), spark.createDataFrame([("h", 1), ("h", 30)], "source string, pid long"))
    assert sorted((r["root"], r["pid"], r["depth"]) for r in got.collect()) == sorted([(1, p, p - 1) for p in range(1, 42)] + [(30, p, p - 30) for p in range(30, 42)])
    starts = spark.createDataFrame([("h", 5, 1, 10.0), ("h", 9, 5, 20.0), ("h", 5, 1, 30.0), ("h", 9, 5, 40.0), ("h", 8, 5, 5000.0)], "source string, pid long, ppid long, ts double")
    parents = {(r["pid"], r["ts"]): r["parent_ts"] for r in joins.process_parents(starts, 3600.0).collect()}
    assert parents == {(5, 10.0): None, (9, 20.0): 10.0, (5, 30.0): None, (9, 40.0): 30.0, (8, 5000.0): None}


def test_a_detector_that_fails_while_running_stops_no_other(spark):
    ticks = spark.createDataFrame([("h", float(t), 50.0) for t in range(5)], "source string, ts double, v double")

    def breaks(df):
        return df.select("source", "ts", F.raise_error(F.lit("broken inside")).cast("double").alias("score"), F.lit("info").alias("severity"))

    found, failed = rules.run_detectors(ticks, {"all": rules.always, "bad": breaks, "unplanned": lambda df: df.select("nothing"), "limit": lambda df: rules.fixed_threshold(df, "v", 40.0, 2.0)})
    assert {r["detector"]: r["count"] for r in found.groupBy("detector").count().collect()} == {"all": 5, "limit": 3} and set(failed) == {"bad", "unplanned"}


def test_rules_are_checked_before_any_job(spark):
    ticks = spark.createDataFrame([], "source string, ts double, cpu double, note string, cores double")
    good = {"name": "hot", "when": {"all": [{"metric": "cpu", "op": ">", "value": "cpu_median + 4 * cpu_sigma"}, {"metric": "cpu", "op": ">", "value": 60}, {"metric": "note", "op": "contains", "value": "X"}]}, "for": "90s", "cooldown": "1.5h", "severity": "critical"}
    rule = rules.rules_from([good, {"when": {"any": [{"metric": "cpu", "op": "<", "value": "cores * 2"}]}}], ticks)
    assert [(r.name, r.hold, r.cooldown, r.severity, r.mode) for r in rule] == [("hot", 90.0, 5400.0, "critical", "all"), ("rule 2", 30.0, 600.0, "warning", "any")]
    one = lambda **c: {"name": "bad", "when": {"all": [{"metric": "cpu", "op": ">", "value": "1"} | c]}}
    for entry, word in ((one(op="=~"), "operator"), (one(value="nothing + 1"), "expression"), (one(value="1 +"), "expression"), (one(metric="gpu"), "metric"), (one() | {"severity": "loud"}, "severity"), (one() | {"for": "soon"}, "duration"), ({"name": "bad"}, "conditions"), ({"name": "bad", "when": {"all": [{"op": ">"}]}}, "metric")):
        with pytest.raises(ValueError, match=f"bad.*{word}"):
            rules.rules_from([entry], ticks)
