"""Incidents and rules with kept state: the stream equals the batch, over late rows and a restart."""

import numpy as np
import pytest

from fleetscope.operators import decide, detect
from fleetscope.operators.baseline import Baseline
from fleetscope.operators.rules import Condition, Rule
from fleetscope.streaming import stateful

START = 1_704_067_200.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def in_parts(spark, tmp_path, parts, schema, job):
    """One file a micro-batch; the query is stopped and started again from its checkpoint between the halves."""
    half = (len(parts) + 1) // 2
    for side in (parts[:half], parts[half:]):
        for rows in side:
            n = len(list((tmp_path / "in").glob("part=*"))) if (tmp_path / "in").exists() else 0
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
        stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def shuffled(rows, rng, reach):
    """Rows out of order, by less than ``reach`` seconds."""
    return sorted(rows, key=lambda r: r[1] + rng.random() * reach)


def cut_up(rows, n):
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


def test_incidents_open_change_and_close_as_in_batch(rocks, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for host in ("a", "b"):
        for t in START + np.cumsum(rng.choice([5, 40, 100, 300], 60, p=[0.4, 0.3, 0.2, 0.1])):
            rows.append((host, float(t), str(rng.choice(["rules", "leak"], p=[0.8, 0.2])), float(rng.integers(1, 9)) / 9, str(rng.choice(["info", "warning"], p=[0.8, 0.2]))))
    schema = "source string, ts double, detector string, score double, severity string"
    far = [(h, START + 90_000.0, "rules", 0.1, "info") for h in ("a", "b")]
    behind = [("a", START - 5000.0, "rules", 9.0, "critical"), (None, START, "rules", 1.0, "info"), ("a", None, "rules", 1.0, "info")]
    parts = [*cut_up(shuffled(rows, rng, 14.0), 5), far, behind, [("c", START + 200_000.0, "rules", 0.1, "info")]]
    got = in_parts(rocks, tmp_path, parts, schema, lambda s: stateful.incident_stream(s, 120.0)).collect()
    batch = decide.fold(decide.fuse(rocks.createDataFrame(rows + far, schema), 120.0)).collect()
    want = {(r["source"], r["session"]): (r["ts_start"], r["ts_end"], r["severity"], r["signal_count"], r["peak_score"], list(r["detectors"])) for r in batch}
    closed = {(r["source"], r["session"]): (r["ts_start"], r["ts_end"], r["severity"], r["signal_count"], r["peak_score"], list(r["detectors"])) for r in got if r["event"] == "close"}
    assert closed == want and len({v[2] for v in want.values()}) == 3
    opened = [(r["source"], r["session"]) for r in got if r["event"] == "open"]
    assert sorted(opened) == sorted([*want, ("c", 0)]) or sorted(opened) == sorted(want)
    assert all(r["ts_end"] is None and r["ts_start"] == want[r["source"], r["session"]][0] for r in got if r["event"] == "update")
    assert sum(r["event"] == "update" for r in got) >= 2


RULES = (
    Rule("high", (Condition("x", ">", "x_median + 3 * x_sigma"), Condition("x", ">", "5")), 10, 60, "warning"),
    Rule("pair", (Condition("y", ">", "limit * 2"), Condition("kind", "contains", "HOT")), 0, 30, "critical", "any"),
    Rule("long", (Condition("y", ">=", "y_median"),), 40, 100, "info"),
)
TICKS = "source string, ts double, x double, y double, kind string, limit double, suspect boolean"


def test_rules_fire_as_in_batch(rocks, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for host in ("a", "b"):
        t, y = START, 0.0
        for k in range(500):
            t += float(rng.choice([1, 2, 30], p=[0.8, 0.18, 0.02]))
            y = 0.97 * y + float(rng.normal())
            rows.append((host, t, float(rng.normal()) + (12.0 if k % 170 > 130 else 0.0) if rng.random() > 0.03 else None, y, str(rng.choice(["hot", "cold"], p=[0.02, 0.98])), 2.0, bool(rng.random() < 0.02)))
    far = [(h, START + 90_000.0, None, None, "cold", None, False) for h in ("a", "b")]
    behind = [("a", START + 10.5, 1e9, 1e9, "hot", 0.0, False)]
    config = Baseline(300.0, 20)
    parts = [*cut_up(shuffled(rows, rng, 14.0), 5), far, behind, [("c", START + 200_000.0, 0.0, 0.0, "", 0.0, False)]]
    got = in_parts(rocks, tmp_path, parts, TICKS, lambda s: stateful.rule_stream(s, RULES, config))
    want = detect.rule_detector(rocks.createDataFrame(rows, TICKS), RULES, detect.Setup(usual=config, chunk=600.0))
    key = lambda df: sorted((r["source"], r["ts"], r["rule"], r["severity"], round(r["score"], 9), list(r["fired"]), r["sustained_s"]) for r in df.collect())
    assert key(got) == key(want) and {r["rule"] for r in want.select("rule").distinct().collect()} == {"high", "pair", "long"}


def test_thresholds_are_sums():
    assert stateful.linear("x_median + 5 * x_sigma + 3") == {"x_median": 1.0, "x_sigma": 5.0, "": 3.0}
    assert stateful.linear("cores * 8000") == {"cores": 8000.0}
    for bad in ("a * b", "greatest(a)", "a - 1"):
        with pytest.raises(ValueError):
            stateful.linear(bad)
