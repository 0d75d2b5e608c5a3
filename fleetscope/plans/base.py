"""What the registered queries share: events as samples, machines, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch

DAY, HOUR = 86_400.0, 3600.0
#: 2024-01-01 in epoch seconds, the first day of ``events``.
START = 1_704_067_200.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (source, ts, pid, name, value, id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("source"), epoch("ts").alias("ts"), F.col("user_id").alias("pid"), F.concat(F.lit("u"), F.col("user_id")).alias("name"), "value", F.col("event_id").alias("id"))


S = "s AS (SELECT event_type AS source, epoch(ts) AS ts, user_id AS pid, 'u' || user_id AS name, value, event_id AS id FROM events)"
DAYS = "CAST(floor(ts / 86400) AS BIGINT)"


def host_of() -> Column:
    """A machine of 25 users, so that there are more machines where there are more users."""
    return F.concat(F.lit("h"), F.floor(F.col("pid") / 25)).alias("source")


H = "'h' || CAST(floor(pid / 25) AS BIGINT)"


def as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(df: DataFrame, *names: str, places: int = 3) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def rounded_as_sql(df: DataFrame, *names: str, places: int = 3) -> DataFrame:
    """``rounded`` as DuckDB's ``round`` has it: halves away from zero, told from the double's product with the power of ten. Spark rounds the shortest decimal, which near a half may go the other way."""
    power = 10.0**places

    def nearest(product: Column) -> Column:
        size = F.abs(product)
        # From 2^52 on a double has no fraction; infinity has none either.
        whole = F.floor(size).cast("double")
        return F.when(size < 2.0**52, F.signum(product) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0))).otherwise(product)

    return df.withColumns({n: nearest(F.col(n) * power) / power for n in names})


def settled_sql(number: str, places: int) -> str:
    """``rollup.settled``: halves away from zero, decided on decimals and not on a double's last bits."""
    return f"CAST(round(CAST({number} AS DECIMAL(38, {places + 6})), {places}) AS DOUBLE)"


def islands_sql(source: str, name: str) -> str:
    """CTEs that merge the spans of ``source`` (source, lo, hi) into ``name``."""
    return f"{name}_r AS (SELECT *, max(hi) OVER (PARTITION BY source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}), {name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY lo, hi) AS island FROM {name}_r), {name} AS (SELECT source, min(lo) AS lo, max(hi) AS hi FROM {name}_i GROUP BY source, island)"


def carried_sql(name: str, rows: str, keys: str, spacing: float, window: float, least: int) -> str:
    """CTEs of a carried axis: ``{name}`` has (keys, ts, md, ma, sg, n, mx) at every row of ``rows`` (keys, ts, v) that is learnt; all but n null until ready."""
    on = " AND ".join(f"e.{k} = f.{k}" for k in keys.split(", "))
    of_e = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f"""
{name}_t AS (
    SELECT {keys}, min(ts) AS ts FROM {rows} GROUP BY {keys}
    UNION ALL
    SELECT {of_e}, min(e.ts) FROM {name}_t f JOIN {rows} e ON {on} AND e.ts - f.ts >= {spacing} GROUP BY {of_e}
), {name}_w AS (
    SELECT {keys}, ts, median(v) OVER w AS md, mad(v) OVER w AS ma, count(*) OVER w AS n, max(v) OVER w AS mx FROM {rows} JOIN {name}_t USING ({keys}, ts)
    WINDOW w AS (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN {window} PRECEDING AND CURRENT ROW)
), {name} AS (
    SELECT {keys}, ts, n, CASE WHEN n >= {least} THEN md END AS md, CASE WHEN n >= {least} THEN ma END AS ma,
           CASE WHEN n >= {least} THEN greatest(ma * 1.4826, abs(md) * 0.05) END AS sg, CASE WHEN n >= {least} THEN mx END AS mx FROM {name}_w
)"""
