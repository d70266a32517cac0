"""Lot sizes, pip values and risk shares as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pip_size(digits: Column) -> Column:
    """Ten points of a symbol quoted with ``digits`` decimals."""
    return F.pow(F.lit(10.0), -digits.cast("double")) * 10


# Money per pip and lot when a symbol has no properties.
PIP_VALUE_DEFAULT = 10.0
PIP_VALUES = {"USDJPY": 9.0}


def pip_values(rows: DataFrame, symbols: DataFrame, rates: DataFrame, lot: Column) -> DataFrame:
    """Add ``pip_value`` in USD: from symbol properties and the last rate, else from the fixed table.

    ``symbols``: symbol, digits, tick_size, tick_value, profit_currency. ``rates``: symbol, rate (last bid). The
    currency is converted through ``<currency>USD`` or, inverted, ``USD<currency>``. Both tables have a row per symbol.
    """
    direct = rates.select(F.col("symbol").alias("_direct"), F.col("rate").alias("_times"))
    inverse = rates.select(F.col("symbol").alias("_inverse"), F.col("rate").alias("_by"))
    known = (
        symbols.withColumn("_direct", F.concat("profit_currency", F.lit("USD")))
        .withColumn("_inverse", F.concat(F.lit("USD"), F.col("profit_currency")))
        .join(direct, "_direct", "left")
        .join(inverse, "_inverse", "left")
    )
    quoted = pip_size(F.col("digits")) / F.nullif(F.col("tick_size"), F.lit(0.0)) * F.col("tick_value")
    in_usd = (
        F.when(F.col("profit_currency") == "USD", quoted)
        .when(F.col("_times").isNotNull(), quoted * F.col("_times"))
        .otherwise(quoted / F.nullif(F.col("_by"), F.lit(0.0)))
    )
    known = known.select("symbol", in_usd.alias("_usd"))
    table = F.lit(PIP_VALUE_DEFAULT)
    for name, value in PIP_VALUES.items():
        table = F.when(F.col("symbol") == name, value).otherwise(table)
    joined = rows.join(known, "symbol", "left")
    value = F.when(F.col("_usd").isNotNull(), F.round(F.col("_usd") * lot, 3)).otherwise(table * lot)
    return joined.withColumn("pip_value", value).drop("_usd")


def lot_by_tick_value(
    balance: Column, risk_percent: float, entry: Column, stop: Column, tick_size: Column, tick_value: Column,
    minimum: float = 0.01, maximum: float = 100.0, step: float = 0.01,
) -> Column:
    """Money risk over the loss per lot, rounded down to the step and kept within bounds."""
    loss = F.abs(entry - stop) / F.nullif(tick_size, F.lit(0.0)) * tick_value
    raw = F.when(loss > 0, balance * (risk_percent / 100.0) / F.nullif(loss, F.lit(0.0)))
    stepped = F.floor(raw / step) * step
    bounded = F.greatest(F.lit(minimum), F.least(F.lit(maximum), stepped))
    return F.greatest(F.lit(minimum), F.round(F.coalesce(bounded, F.lit(minimum)), 2))


# Pairs quoted in dollars per lot of one hundred thousand.
MAJOR_PAIRS = ("EURUSD", "GBPUSD", "USDCHF", "AUDUSD", "NZDUSD", "EURGBP", "EURJPY", "GBPJPY")


def lot_by_family(symbol: Column, balance: Column, risk_percent: float, price: Column, stop: Column) -> Column:
    """Lot by symbol family; suffixes and dots are ignored, unknown symbols get the smallest lot."""
    base = F.replace(F.replace(symbol, F.lit("."), F.lit("")), F.lit("_i"), F.lit(""))
    money = balance * (risk_percent / 100.0)
    gap = F.nullif(F.abs(stop - price), F.lit(0.0))
    raw = (
        F.when(base.contains("XAU"), money / (gap * 100))
        .when(base.contains("JPY"), money / (gap / 0.01) * stop / 1000)
        .when(base.contains("BTC"), money / gap)
        .when(base == "USDCAD", money / (gap / 0.0001) * stop / 10)
        .when(base.isin(*MAJOR_PAIRS), money / (gap / 0.0001) / 10)
    )
    return F.greatest(F.lit(0.01), F.coalesce(F.floor(raw * 100) / 100.0, F.lit(0.01)))


def capped_volume(
    balance: Column, risk_percent: float, entry: Column, stop: Column, tick_size: Column, tick_value: Column,
    step: float = 0.01, minimum: float = 0.01, maximum: float = 1.0, target: float = 0.01,
) -> Column:
    """Volume from money risk under a hard cap; zero when an input makes no sense."""
    cap = min(maximum, target)
    loss = F.abs(entry - stop) / F.nullif(tick_size, F.lit(0.0)) * tick_value
    raw = balance * (risk_percent / 100.0) / F.nullif(loss, F.lit(0.0))
    sized = F.floor(F.least(raw, F.lit(cap)) / step) * step
    raised = F.when((sized < minimum) & (raw >= minimum) & F.lit(minimum <= cap), F.lit(minimum)).otherwise(sized)
    valid = (balance > 0) & F.lit(risk_percent > 0 and cap > 0) & (loss > 0)
    return F.when(F.coalesce(valid, F.lit(False)), F.round(F.least(raised, F.lit(cap)), 8)).otherwise(F.lit(0.0))


def recovery_risk_percent(
    base: float, start_balance: float, rr: float, trades: Column, profit: Column, maximum: float
) -> Column:
    """Risk share needed to reach the planned profit, between the base and the maximum."""
    if start_balance <= 0 or rr <= 0:
        raise ValueError("start_balance and rr must be positive")
    goal = F.greatest(F.lit(1), trades) * (start_balance * base / 100.0 * rr)
    gap = goal - profit
    raised = F.round(gap / rr / start_balance * 100.0, 2)
    return F.when(gap <= 0, F.lit(min(base, maximum))).otherwise(
        F.least(F.greatest(raised, F.lit(base)), F.lit(maximum))
    )


def bounded_risk_percent(base: Column, maximum: float = 2.0) -> Column:
    """Risk share between zero and at most two percent."""
    return F.greatest(F.lit(0.0), F.least(base, F.lit(min(maximum, 2.0))))


def atr_stop_distance(atr: Column, smallest: float, largest: float) -> Column:
    """Two ATR kept within bounds, rounded to six places inside them."""
    wide = atr * 2
    return F.when(wide > largest, F.lit(largest)).when(wide < smallest, F.lit(smallest)).otherwise(F.round(wide, 6))
