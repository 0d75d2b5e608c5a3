"""Incidents analysed end to end with detector claims, and attributions scored against labelled faults."""

import pytest
from pyspark.sql import functions as F

from fleetscope.operators import evaluate, explain

METRICS = "source string, ts double, cpu_total double, mem_percent double, ctx_switches_ps double"
PROCESSES = "source string, ts double, pid long, name string, cpu_percent double, io_read_bps double, io_write_bps double, rss_mb double, handles long"


@pytest.fixture(scope="module")
def machines(spark):
    """From 2000 s on ``busy`` has a CPU bottleneck by worker, ``leak`` shows nothing but pid 7's handles, ``read`` reads a lot."""
    metrics, processes = [], []
    for t in range(0, 2600, 2):
        on = t >= 2000
        for source in ("busy", "leak", "read"):
            metrics.append((source, float(t), 20.0 + 0.1 * (t % 3) + 70.0 * (on and source == "busy"), 40.0 + 0.1 * (t % 3), 1000.0 + t % 7))
            processes.append((source, float(t), 5, "worker.exe", 5.0 + 80.0 * (on and source == "busy"), 10.0 + 1e6 * (on and source == "read"), 10.0, 100.0, 300))
            processes.append((source, float(t), 7, "leaky.exe", 1.0, 5.0, 5.0, 100.0, 400 + (t - 1300 if t > 1300 else 0) * (source == "leak")))
            processes.append((source, float(t), 9, "noise.exe", 8.0 + 4.0 * on, 5.0, 20.0, 100.0, 500))
    return spark.createDataFrame(metrics, METRICS), spark.createDataFrame(processes, PROCESSES)


def test_a_claim_wins_over_nothing_and_yields_to_a_bottleneck(spark, machines):
    incidents = spark.createDataFrame([(s, 1, 2000.0, 2300.0, None) for s in ("busy", "leak")], "source string, id long, ts_start double, ts_end double, trigger_metric string")
    sentence = "leaky.exe (PID 7) handles 400 -> 1,100"
    signals = spark.createDataFrame([(s, t, "procleak", x, "handles", "leaky.exe", sentence, 600.0, ["handle leak"]) for s in ("busy", "leak") for t, x in ((2010.0, 0.8), (2100.0, 0.8), (2200.0, 0.3))] + [("leak", 2005.0, "rules", 1.0, None, None, None, None, ["high", "late"])], "source string, ts double, detector string, score double, metric string, process string, explanation string, duration_s double, rules array<string>")
    linked = signals.select("source", F.lit(1).cast("long").alias("incident_id"), "ts", "detector")
    claims = explain.detector_claim(linked, signals)
    assert {r["source"]: (r["claim"]["at"], r["triggers"]) for r in claims.collect()} == {"busy": (2010.0, ["handle leak"]), "leak": (2010.0, ["high", "late", "handle leak"])}
    got = {r["source"]: r for r in explain.analyze(incidents, *machines, claims=claims).collect()}
    leak, busy = got["leak"], got["busy"]
    assert (leak["bottleneck"], leak["claim_wins"], leak["resource"], leak["start"], leak["title"]) == ("NONE", True, "handles", 1410.0, sentence)
    assert leak["contributors"][0]["name"] == "leaky.exe" and leak["attributable"]
    assert (busy["bottleneck"], busy["claim_wins"], busy["resource"]) == ("CPU", False, "cpu") and busy["start"] >= 1700
    assert busy["title"] == f"CPU saturated — worker.exe {round(100 * busy['contributors'][0]['share'])}%"
    assert busy["report"].splitlines()[0] == busy["title"] and "cpu_total 20.1 -> 90" in busy["report"] and "rules: handle leak" in busy["report"] and "- worker.exe" in busy["report"]
    bare = {r["source"]: r for r in explain.analyze(incidents, *machines).collect()}["leak"]
    assert (bare["resource"], bare["attributable"], bare["title"]) == ("cpu", False, "no bottleneck")


def test_an_incident_without_metrics_has_no_title(spark, machines):
    incidents = spark.createDataFrame([("gone", 1, 50_000.0, None, None)], "source string, id long, ts_start double, ts_end double, trigger_metric string")
    row = explain.analyze(incidents, *machines).first()
    assert (row["bottleneck"], row["title"], row["report"], row["contributors"]) == (None, None, None, None) and (row["start"], row["end"]) == (50_000.0, 50_000.0)


FAULTS = "source string, id long, scenario string, ts_start double, ts_end double, pid long, completed boolean"


def test_faults_are_scored_by_their_process_trees(spark, machines):
    metrics, processes = machines
    rows = [("busy", 1, "cpu_spin", 2000.0, 2300.0, 3, True), ("read", 1, "disk_thrash", 2000.0, 2300.0, 5, True), ("leak", 1, "handle_leak", 2000.0, 2300.0, 9, True), ("leak", 2, "manual", 1.0, 2.0, 9, True), ("leak", 3, "odd", 1.0, 2.0, 9, True),
            ("leak", 4, "cpu_spin", 1.0, None, 9, True), ("leak", 5, "cpu_spin", 1.0, 2.0, 9, False), ("leak", 6, "cpu_spin", 1.0, 2.0, None, True), ("leak", 7, "cpu_spin", 9e5, 9e5 + 1, 9, True)]
    faults = spark.createDataFrame(rows, FAULTS)
    # Worker 5 is a grandchild of 3; a start long before the fault, and one of another machine, bring nobody in.
    starts = spark.createDataFrame([("busy", 1900.0, 4, 3), ("busy", 1950.0, 5, 4), ("busy", -9000.0, 9, 3), ("leak", 1900.0, 7, 3)], "source string, ts double, pid long, ppid long")
    answers = evaluate.fault_answers(faults, starts, processes)
    told = {(r["source"], r["id"]): (r["answer_pids"], r["skipped"]) for r in answers.collect()}
    assert told["busy", 1] == ([3, 4, 5], None) and told["read", 1] == ([5], None)
    assert [told["leak", k][1] for k in range(2, 8)] == ["no_load", "unknown_scenario", "unfinished", "no_symptom", "no_pid", "no_process_metrics"]
    hits = evaluate.score_faults(answers, processes)
    assert {(r["source"], r["hit_rank"]) for r in hits.where("skipped is null").collect()} == {("busy", 1), ("read", 1), ("leak", None)}
    rates = evaluate.attribution_rates(hits.where("skipped is null")).first()
    assert (rates["n"], round(rates["top1"], 3), rates["passed"]) == (3, 0.667, None)


def test_the_product_path_tells_missing_incidents_and_metrics_apart(spark, machines):
    metrics, processes = machines
    faults = spark.createDataFrame([("busy", 1, "cpu_spin", 2000.0, 2300.0, 5, True), ("leak", 1, "cpu_spin", 2000.0, 2300.0, 5, True), ("read", 1, "cpu_spin", 2000.0, 2300.0, 5, True)], FAULTS)
    incidents = spark.createDataFrame([("busy", 1, 1990.0, 2010.0, None), ("busy", 2, 2020.0, 2300.0, None), ("read", 3, 2000.0, 2100.0, None)], "source string, id long, ts_start double, ts_end double, trigger_metric string")
    answers = evaluate.fault_answers(faults, spark.createDataFrame([], "source string, ts double, pid long, ppid long"), processes)
    out = evaluate.score_product(answers, explain.analyze(incidents, metrics, processes), incidents, metrics.where("source <> 'read'"))
    assert {r["source"]: (r["skipped"], r["incident"], r["hit_rank"]) for r in out.collect()} == {"busy": (None, 2, 1), "leak": ("no_incident", None, None), "read": ("metrics_gone", 3, None)}


def test_scoreboard_sums_sources_and_appends(spark, tmp_path):
    scored = spark.createDataFrame([("a", "x", 1, 0, 1, 10.0), ("b", "x", 1, 2, 0, 30.0), ("a", "y", 0, 0, 0, None), ("b", "z", 3, 0, 0, 5.0)], "source string, detector string, tp long, fp long, fn long, latency double")
    board = evaluate.scoreboard(scored, (0.0, 100.0), 7.0)
    assert [(r["detector"], r["tp"], r["fp"], r["fn"], round(r["f1"], 4), r["latency"]) for r in board.collect()] == [("z", 3, 0, 0, 1.0, 5.0), ("x", 2, 2, 1, 0.5714, 20.0), ("y", 0, 0, 0, 0.0, None)]
    for _ in range(2):
        board.write.mode("append").parquet(f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 6
