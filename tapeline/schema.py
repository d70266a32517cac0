"""Canonical schemas and fixed value sets."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _D, _L, _T = StringType(), DoubleType(), LongType(), TimestampNTZType()

TICKS = _struct(symbol=_S, ts=_T, bid=_D, ask=_D, seq=_L)
BARS = _struct(symbol=_S, ts=_T, open=_D, high=_D, low=_D, close=_D, volume=_D)
ORDERS = _struct(
    trade_id=_S, symbol=_S, ts=_T, side=_S, volume=_D, price=_D, sl=_D, tp=_D, strategy=_S, magic=_L
)
DEALS = _struct(
    deal_id=_L, position_id=_L, ts=_T, symbol=_S, comment=_S, entry=_S, type=_S, profit=_D, commission=_D, swap=_D, fee=_D
)
LOG = _struct(timestamp=_S, level=_S, event=_S, message=_S, trade_id=_S, symbol=_S)

# Timeframe names and their minutes.
TIMEFRAME_MINUTES = {
    "1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080,
}
# The next larger frame used for confirmation; every other frame uses "15m".
HIGHER_TIMEFRAME = {"1m": "5m", "3m": "15m", "5m": "15m"}

REQUIRED_BAR_COLUMNS = ("open", "high", "low", "close")


def tf_minutes(timeframe: str | int) -> int:
    """Minutes of a timeframe name, or a positive minute count taken as it is."""
    if isinstance(timeframe, int):
        if timeframe <= 0:
            raise ValueError("timeframe must be positive")
        return timeframe
    try:
        return TIMEFRAME_MINUTES[timeframe]
    except KeyError:
        raise ValueError(f"unknown timeframe {timeframe!r}") from None


def tf_seconds(timeframe: str | int) -> int:
    return 60 * tf_minutes(timeframe)


def higher_tf(timeframe: str) -> str:
    return HIGHER_TIMEFRAME.get(timeframe, "15m")
