"""Column expressions: names, buckets, days, bands, bit masks, arrays, text and strict three-valued arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Programs that many unrelated services share, by normalised name.
SHARED_HOSTS = ("svchost", "dllhost", "rundll32", "taskhostw", "wmiprvse", "runtimebroker", "backgroundtaskhost", "conhost", "sihost")
SEVERITIES = ("info", "warning", "critical")
# Reasons in a GPU's clock throttle mask.
THROTTLE_BITS = {0x1: "gpu_idle", 0x2: "applications_clocks", 0x4: "sw_power_cap", 0x8: "hw_slowdown", 0x10: "sync_boost", 0x20: "sw_thermal", 0x40: "hw_thermal", 0x80: "hw_power_brake", 0x100: "display_clocks"}
#: Kinds of bottleneck for which a program can be named.
ATTRIBUTABLE = ("CPU", "IO", "MEMORY")


def epoch(ts: Column | str) -> Column:
    """Epoch seconds of a timestamp with or without a zone (the session zone must be UTC for the latter)."""
    return F.col(ts).cast("timestamp").cast("double") if isinstance(ts, str) else ts.cast("timestamp").cast("double")


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?i)\.exe$", ""))


def group_key(name: Column, pid: Column, shared: Sequence[str] = SHARED_HOSTS) -> Column:
    """Shared host programs stay apart by pid, others go together by name."""
    base = normal_name(name)
    return F.when(base.isin(*shared), F.concat_ws("#", name, pid.cast("string"))).otherwise(name)


def bucket_of(ts: Column, size: float) -> Column:
    return F.floor(ts / size) * size


def day_of(ts: Column, zone: str = "UTC") -> Column:
    """Local date of epoch seconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))


def day_bounds(day: Column, zone: str = "UTC") -> tuple[Column, Column]:
    """Epoch seconds of the local day's start and end."""
    start = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone).cast("double")
    return start(day), start(F.date_add(day, 1))


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return (lo < other_hi) & (hi > other_lo)


def categorize(df: DataFrame, categories: DataFrame, other: str = "other", name: str = "name") -> DataFrame:
    """Adds ``category`` from (name, category), joined on the normalised name; ``other`` for names without one."""
    table = categories.select(normal_name(F.col("name")).alias("_key"), F.col("category").alias("_category")).dropDuplicates(["_key"])
    return df.withColumn("_key", normal_name(F.col(name))).join(table, "_key", "left").withColumn("category", F.coalesce("_category", F.lit(other))).drop("_key", "_category")


def slot_of(hour: Column, slots: Mapping[str, tuple[int, int]]) -> Column:
    """The first named slot [from, to) that holds the hour; null where none does. A slot may pass midnight."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(slots.items())):
        inside = (hour >= lo) & (hour < hi) if lo <= hi else (hour >= lo) | (hour < hi)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.least(rank, F.lit(len(SEVERITIES) - 1)) + 1).cast("int"))


def band(value: Column, warning: float, critical: float) -> Column:
    """Rank of the band a value is in: 0 info, 1 warning, 2 critical; null stays null."""
    return F.when(value >= critical, 2).when(value >= warning, 1).when(value.isNotNull(), 0)


def worse(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def core_summary(cores: Column) -> tuple[Column, Column]:
    """Mean and maximum over a per-core array (or its JSON text parsed by ``json_array``); null for an empty one."""
    total = F.aggregate(cores, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(cores)), F.array_max(cores)


def json_array(text: Column, kind: str = "array<double>") -> Column:
    return F.from_json(text, kind)


def throttle_reasons(mask: Column, bits: Mapping[int, str] = THROTTLE_BITS) -> Column:
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) > 0, F.lit(name)) for bit, name in bits.items())))


def flatten_gpu(samples: DataFrame, gpu: DataFrame, keys: Sequence[str] = ("source", "ts")) -> DataFrame:
    """Device 0's columns with the prefix ``gpu_``; a column that ``samples`` has already wins where it is not null."""
    first = gpu.where("gpu_index = 0").drop("gpu_index")
    names = [c for c in first.columns if c not in keys]
    out = samples.join(first.select(*keys, *(F.col(c).alias(f"_gpu_{c}") for c in names)), list(keys), "left")
    for c in names:
        name = c if c.startswith("gpu_") else f"gpu_{c}"
        out = out.withColumn(name, F.coalesce(name, f"_gpu_{c}") if name in samples.columns else F.col(f"_gpu_{c}"))
    return out.drop(*(f"_gpu_{c}" for c in names))


def foreground_program(processes: Column) -> Column:
    """Lower-cased name of the foreground row of an array of (name, foreground, pid) structs, the lowest pid's; null if there is none."""
    return F.lower(F.array_min(F.transform(F.filter(processes, lambda p: p["foreground"]), lambda p: F.struct(p["pid"], p["name"])))["name"])


def features(text: Column) -> Column:
    """Parts of a signal's JSON features; malformed text gives nulls."""
    return F.from_json(text, "rules array<string>, metric string, process string, pid long, duration_s double, explanation string, evidence map<string,struct<value:double,median:double,sigma:double,z:double>>")


def contains_ci(a: Column, b: Column) -> Column:
    return F.lower(a).contains(F.lower(b))


def strict_and(*parts: Column) -> Column:
    """AND that is null if any part is (Spark's own gives false for null and false)."""
    return F.when(reduce(lambda x, y: x | y, [p.isNull() for p in parts]), F.lit(None)).otherwise(reduce(lambda x, y: x & y, parts))


def strict_or(*parts: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [p.isNull() for p in parts]), F.lit(None)).otherwise(reduce(lambda x, y: x | y, parts))


def strict_min(*parts: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [p.isNull() for p in parts]), F.lit(None)).otherwise(F.least(*parts))


def strict_max(*parts: Column) -> Column:
    return F.when(reduce(lambda x, y: x | y, [p.isNull() for p in parts]), F.lit(None)).otherwise(F.greatest(*parts))


def valid_expression(df: DataFrame, expression: str) -> bool:
    """Does a rule's SQL expression resolve against ``df``? Nothing is run."""
    from pyspark.errors import AnalysisException, ParseException

    try:
        df.limit(0).select(F.expr(expression)).schema  # noqa: B018
    except (AnalysisException, ParseException):
        return False
    return True


def with_host_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Adds machine variables; null for hosts without a profile, which leaves rules on them undecided."""
    return df.join(profile.select("source", "cores", "physical_cores", "ram_mb", "swap_total_mb"), "source", "left")


def duration_text(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def attributable(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ATTRIBUTABLE), F.lit(False))


def incident_title(claim_wins: Column, claim: Column, label: Column, named: Column, contributors: Column, evidence: Column) -> Column:
    """The detector's sentence if its claim wins; else the label with the top program and its share where one can be ``named``; else with the first evidence, if there is any."""
    top = F.get(contributors, F.lit(0))
    program = F.format_string("%s — %s %d%%", label, top["name"], F.round(top["share"] * 100).cast("int"))
    return F.when(claim_wins, claim).when(named & top.isNotNull(), program).otherwise(F.concat_ws(" — ", label, F.get(evidence, F.lit(0))))


def incident_report(df: DataFrame) -> DataFrame:
    """Adds ``report`` to rows with title, start, end, evidence, triggers, overridden_from and contributors: title, duration, evidence, rules
    that fired, what the metrics would have said where a trigger overrode them, and the five largest contributors with lead notes, one a line; null without a title."""
    lead = lambda c: F.when(c["is_new"], " (new)").when(c["lead_s"] > 0, F.format_string(" (%ds before)", c["lead_s"].cast("int"))).otherwise("")
    line = lambda c: F.concat(F.lit("- "), c["name"], F.format_string(" %d%%", F.round(c["share"] * 100).cast("int")), lead(c))
    filled = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; "))
    lines = (F.col("title"), duration_text(F.col("end") - F.col("start")), filled(F.col("evidence")), F.concat(F.lit("rules: "), filled(F.col("triggers"))), F.concat(F.lit("instead of "), F.col("overridden_from")), F.array_join(F.transform(F.slice("contributors", 1, 5), line), "\n"))
    return df.withColumn("report", F.when(F.col("title").isNotNull(), F.concat_ws("\n", *lines)))


def visible_connections(connections: DataFrame, most: int) -> DataFrame:
    """Rows with a status and a remote address or LISTEN, ``most`` of each snapshot (a display limit of the feature itself)."""
    from pyspark.sql import Window

    kept = connections.where((F.col("status") != "NONE") & (F.col("raddr").isNotNull() | (F.col("status") == "LISTEN")))
    order = Window.partitionBy("source", "ts").orderBy("pid", "lport", "raddr", "rport")
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
