"""Rule detector: conditions as Spark SQL expressions, sustained and cooled down, one signal a tick."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import SEVERITIES, contains_ci, severity_rank, valid_expression
from ..session import cut
from .baseline import spaced


@dataclass(frozen=True)
class Condition:
    """``metric op value``; the value is a SQL expression over the tick's columns, or text for contains."""

    metric: str
    op: str
    value: str


@dataclass(frozen=True)
class Rule:
    name: str
    conditions: Sequence[Condition]
    hold: float = 0.0
    cooldown: float = 300.0
    severity: str = "warning"
    mode: str = "all"
    explain: str = ""
    metrics: Sequence[str] = field(default=())


OPS = (">", ">=", "<", "<=", "==", "!=", "contains", "not_contains")
_UNITS = {"": 1.0, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86_400.0}


def seconds_of(text: str | float) -> float:
    """Seconds of a number, or of a text such as 30s, 10m, 1.5h; ValueError for any other."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*", str(text))
    if not found:
        raise ValueError(f"no duration: {text!r}")
    return float(found[1]) * _UNITS[found[2]]


def rules_from(entries: Sequence[Mapping], ticks: DataFrame) -> tuple[Rule, ...]:
    """Rules from plain entries (name, when: {all or any: [{metric, op, value}]}, for, cooldown, severity, explain), all of them checked.

    A value that is no number is a SQL expression over the columns of ``ticks`` and the baselines ``m_median``, ``m_mad``,
    ``m_sigma``, ``m_least``, ``m_most`` and ``m_load_*`` of the compared metrics; it is resolved against them before any job
    starts. ValueError names the rule and what is wrong with it.
    """
    out = []
    for k, entry in enumerate(entries):
        name = entry.get("name") or f"rule {k + 1}"
        try:
            when = entry.get("when") or {}
            mode = next((m for m in ("all", "any") if m in when), None)
            if mode is None or not when[mode]:
                raise ValueError("no conditions under all or any")
            conditions = tuple(Condition(str(c["metric"]), str(c["op"]), str(c["value"])) for c in when[mode])
            if unknown := [c.op for c in conditions if c.op not in OPS]:
                raise ValueError(f"unknown operator {unknown[0]!r}")
            severity = entry.get("severity", "warning")
            if severity not in SEVERITIES:
                raise ValueError(f"unknown severity {severity!r}")
            rule = Rule(name, conditions, seconds_of(entry.get("for", "30s")), seconds_of(entry.get("cooldown", "10m")), severity, mode, entry.get("explain", ""))
            axes = [F.lit(None).cast("double").alias(f"{m}_{p}") for m in dict.fromkeys(c.metric for c in conditions) for p in ("median", "mad", "sigma", "least", "most", "load_median", "load_mad", "load_sigma")]
            known = ticks.limit(0).select("*", *axes)
            for c in conditions:
                if c.metric not in ticks.columns:
                    raise ValueError(f"unknown metric {c.metric!r}")
                if c.op not in ("contains", "not_contains") and not valid_expression(known, c.value):
                    raise ValueError(f"no expression over the ticks: {c.value!r}")
        except (KeyError, TypeError) as error:
            raise ValueError(f"{name}: {error!r}") from error
        except ValueError as error:
            raise ValueError(f"{name}: {error}") from error
        out.append(rule)
    return tuple(out)


def truth(condition: Condition) -> Column:
    left = F.col(condition.metric)
    if condition.op in ("contains", "not_contains"):
        found = contains_ci(left, F.lit(condition.value))
        return found if condition.op == "contains" else ~found
    right = F.expr(condition.value)
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "==": left == right, "!=": left != right}[condition.op]


def rule_truth(rule: Rule) -> Column:
    """Three-valued: for ``all`` a false beats a null, for ``any`` a true does, which are SQL's AND and OR."""
    parts = [truth(c) for c in rule.conditions]
    return reduce(lambda a, b: a & b, parts) if rule.mode == "all" else reduce(lambda a, b: a | b, parts)


def sustained(ticks: DataFrame, condition: Column, hold: float, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """Ticks at which the condition has been true without a break for ``hold`` seconds; false and null break it, suspect ticks are passed over."""
    own = (ticks.where(~F.coalesce("suspect", F.lit(False))) if "suspect" in ticks.columns else ticks).withColumn("_true", F.coalesce(condition, F.lit(False)))
    order = Window.partitionBy(*keys).orderBy(ts)
    runs = own.withColumn("_run", F.sum(F.when(F.col("_true"), 0).otherwise(1)).over(order)).where("_true")
    since = F.min(ts).over(Window.partitionBy(*keys, "_run"))
    return runs.withColumn("since", since).where(F.col(ts) - F.col("since") >= hold).drop("_true", "_run")


def cooled(eligible: DataFrame, cooldown: float, keys: Sequence[str] = ("source",), ts: str = "ts") -> DataFrame:
    """Eligible rows spaced greedily by ``cooldown`` per key."""
    kept = spaced(eligible.select(*keys, ts).distinct(), cooldown, keys, ts)
    return eligible.join(kept, [*keys, ts], "left_semi")


def score(metrics: Sequence[str]) -> Column:
    """Largest absolute z over the rule's metrics, by 8, at most 1; 0.5 without one or where it is 0."""
    zs = [F.abs(F.col(f"{m}_z")) for m in metrics]
    top = F.greatest(*zs) if len(zs) > 1 else zs[0] if zs else F.lit(None).cast("double")
    return F.when(top > 0, F.least(top / 8, F.lit(1.0))).otherwise(0.5)


def explained(rule: Rule) -> Column:
    """The rule's template with {metric} and {metric.median} filled in, numbers to one place; a null shows as ``?``."""
    names = re.findall(r"\{([a-z_]+(?:\.[a-z]+)?)\}", rule.explain)
    text = re.sub(r"\{[a-z_]+(?:\.[a-z]+)?\}", "%s", rule.explain.replace("%", "%%"))
    columns = [F.col(n.replace(".", "_")).cast("string") for n in names]
    shown = [F.coalesce(F.round(c.try_cast("double"), 1).cast("string"), c, F.lit("?")) for c in columns]
    return F.format_string(text, *shown) if shown else F.lit(rule.explain)


def evidence(metrics: Sequence[str]) -> Column:
    parts = [x for m in metrics for x in (F.lit(m), F.struct(F.col(m).cast("double").alias("value"), F.col(f"{m}_median").alias("median"), F.col(f"{m}_sigma").alias("sigma"), F.col(f"{m}_z").alias("z")))]
    return F.create_map(*parts)


def rule_signals(ticks: DataFrame, rules: Sequence[Rule], detector: str = "rules") -> DataFrame:
    """(source, ts, detector, score, severity, rule, fired, explanation): per tick the most severe fired rule, the first in order on ties, and all fired names.

    ``ticks`` carries each metric ``m`` and, for those in a rule's ``metrics``, ``m_median``, ``m_sigma`` and ``m_z``.
    """
    out = None
    for order, rule in enumerate(rules):
        eligible = sustained(ticks, rule_truth(rule), rule.hold)
        fired = cooled(eligible, rule.cooldown)
        row = fired.select("source", "ts", score(rule.metrics).alias("score"), F.lit(rule.severity).alias("severity"), F.lit(rule.name).alias("rule"), F.lit(order).alias("_order"), explained(rule).alias("explanation"))
        out = row if out is None else out.unionByName(row)
    first = Window.partitionBy("source", "ts").orderBy(severity_rank(F.col("severity")).desc(), "_order")
    names = F.transform(F.array_sort(F.collect_list(F.struct("_order", "rule")).over(Window.partitionBy("source", "ts"))), lambda r: r["rule"])
    return out.withColumn("fired", names).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("source", "ts", F.lit(detector).alias("detector"), "score", "severity", "rule", "fired", "explanation")


def _above(metric: str, sigmas: float) -> Condition:
    return Condition(metric, ">", f"{metric}_median + {sigmas} * {metric}_sigma")


# The default rule pack. Ticks carry ``cores`` and ``ram_mb`` of their host and, for the GPU, the median of
# its temperature under load (``gpu_temp_c_load_median``) and the names of its throttle reasons as one text.
DEFAULT_RULES = (
    Rule("cpu_overload", (_above("cpu_total", 5), Condition("cpu_total", ">", "60")), 30, 600, "warning", "all", "CPU {cpu_total} %, usually {cpu_total.median} %", ("cpu_total",)),
    Rule("single_core", (Condition("cpu_max_core", ">", "90"), Condition("cpu_total", "<", "50")), 60, 900, "info", "all", "one core at {cpu_max_core} %, all at {cpu_total} %"),
    Rule("memory_pressure", (_above("mem_percent", 4), Condition("mem_percent", ">", "80")), 60, 900, "warning", "all", "memory {mem_percent} %, usually {mem_percent.median} %, {mem_avail_mb} MB free", ("mem_percent",)),
    Rule("memory_growth", (_above("mem_percent", 5), Condition("mem_percent", ">", "mem_percent_median + 5")), 90, 1200, "info", "all", "memory {mem_percent} %, usually {mem_percent.median} %", ("mem_percent",)),
    Rule("disk_response", (_above("disk_resp_ms", 6), Condition("disk_resp_ms", ">", "5")), 30, 600, "warning", "all", "disk answers in {disk_resp_ms} ms, usually {disk_resp_ms.median} ms", ("disk_resp_ms",)),
    Rule("disk_queue", (Condition("disk_queue", ">", "4"),), 30, 600, "warning", "all", "disk queue {disk_queue}"),
    Rule("context_switches", (_above("ctx_switches_ps", 8), Condition("ctx_switches_ps", ">", "cores * 8000")), 60, 1200, "info", "all", "{ctx_switches_ps} context switches a second, usually {ctx_switches_ps.median}", ("ctx_switches_ps",)),
    Rule("gpu_heat", (Condition("gpu_temp_c", ">", "gpu_temp_c_load_median + 5"), Condition("gpu_temp_c", ">", "90"), Condition("gpu_throttle_reasons", "contains", "THERMAL")), 300, 3600, "warning", "all", "GPU at {gpu_temp_c} degrees"),
    Rule("gpu_critical_heat", (Condition("gpu_temp_c", ">", "95"), Condition("gpu_throttle_reasons", "contains", "THERMAL")), 60, 3600, "critical", "all", "GPU at {gpu_temp_c} degrees"),
    Rule("swap_use", (Condition("swap_used_mb", ">", "ram_mb * 0.05"), Condition("mem_percent", ">", "75")), 120, 1800, "warning", "all", "swap {swap_used_mb} MB, memory {mem_percent} %"),
)


def always(ticks: DataFrame) -> DataFrame:
    """Comparison detector: a signal at every tick."""
    return ticks.select("source", "ts", F.lit("always").alias("detector"), F.lit(1.0).alias("score"), F.lit("warning").alias("severity"))


def fixed_threshold(ticks: DataFrame, column: str, limit: float, hold: float = 30.0) -> DataFrame:
    """Comparison detector: ``column`` at or above a limit for ``hold`` seconds."""
    fired = sustained(ticks, F.col(column) >= limit, hold)
    return fired.select("source", "ts", F.lit(f"fixed_{column}").alias("detector"), F.greatest(F.lit(0.05), F.least(F.lit(1.0), (F.col(column) - limit) / (0.5 * limit))).alias("score"), F.lit("warning").alias("severity"))


Detector = Callable[[DataFrame], DataFrame]


def run_detectors(ticks: DataFrame, detectors: Mapping[str, Detector]) -> tuple[DataFrame | None, dict[str, str]]:
    """All detectors' signals over one shared input, and what went wrong with any of them, while planning or while running; the others still run.

    Each detector is a job of its own whose signals are written before the next begins, so that one that fails takes no other with it.
    """
    out, failed = None, {}
    for name, detector in detectors.items():
        try:
            signals = cut(detector(ticks).withColumn("detector", F.lit(name)).select("source", "ts", "detector", "score", "severity"))
        except Exception as error:  # a broken detector must not stop the others
            failed[name] = str(error).splitlines()[0]
            continue
        out = signals if out is None else out.unionByName(signals)
    return out, failed


def gap_segments(ticks: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds ``segment``: how many gap events came before; as a key it resets sustain clocks and tracks."""
    both = ticks.withColumn("_gap", F.lit(0)).unionByName(gaps.select("source", "ts", F.lit(1).alias("_gap")), allowMissingColumns=True)
    order = Window.partitionBy("source").orderBy("ts", F.desc("_gap"))
    return both.withColumn("segment", F.sum("_gap").over(order)).where("_gap = 0").drop("_gap")
