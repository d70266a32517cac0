"""Views of the given tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.bars import ticks_to_bars

DAY, HOUR = 86400, 3600

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks; prices that are not positive are left out as invalid."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("value") > 0)
        .select(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.col("value").alias("price"),
            F.col("event_id").alias("seq"),
        )
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("seq"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(order_ticks(spark, sf_dir), "1d")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_to_bars(price_ticks(spark, sf_dir), "1h")


DAILY_SQL = """
bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
                          count(*) OVER (PARTITION BY symbol) AS total FROM bars)"""

HOURLY_SQL = """
bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open,
         max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos,
                          count(*) OVER (PARTITION BY symbol) AS total FROM bars)"""

TR_SQL = """
p AS MATERIALIZED (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS pc FROM b),
t AS MATERIALIZED (SELECT *, CASE WHEN pc IS NULL THEN high - low
                   ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p)"""

HA_SQL = """
hc AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS c4 FROM b),
ho AS (SELECT symbol, pos, open AS o, c4 FROM hc WHERE pos = 0
       UNION ALL SELECT h.symbol, h.pos, (p.o + p.c4) / 2, h.c4 FROM ho p JOIN hc h ON h.symbol = p.symbol AND h.pos = p.pos + 1),
ha AS MATERIALIZED (SELECT h.symbol, h.ts, h.pos, h.total, h.volume, o AS open, greatest(o, h.c4, high) AS high,
       least(o, h.c4, low) AS low, h.c4 AS close FROM hc h JOIN ho ON h.symbol = ho.symbol AND h.pos = ho.pos)"""


def ewm_sql(name: str, source: str, x: str, q: str, start: str = "0") -> str:
    """CTE ``name(symbol, pos, v)``: exponential mean of ``x`` started at position ``start``."""
    return f"""
{name} AS (SELECT symbol, pos, CAST({x} AS DOUBLE) AS v FROM {source} WHERE pos = {start}
  UNION ALL SELECT s.symbol, s.pos, e.v * ({q}) + (1 - ({q})) * s.{x}
  FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.pos = e.pos + 1)"""


def rounded(df: DataFrame, digits: int, *names: str, plain: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Key columns and rounded value columns, so that equal results compare equal."""
    return df.select(*plain, *[F.round(n, digits).alias(n) for n in names])


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
