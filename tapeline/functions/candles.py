"""Predicates of single candles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.operators.layout import Laid
from tapeline.operators.scans import shift
from tapeline.operators.steps import Step


def colour() -> Column:
    return F.when(F.col("open") > F.col("close"), "short").otherwise("long")


def no_tail() -> Column:
    """The candle opens at its extreme: a falling one at its high, a rising one at its low."""
    o, c = F.col("open"), F.col("close")
    return ((o > c) & (o == F.col("high"))) | ((o < c) & (o == F.col("low")))


def rejection_wick(side: str = "up") -> Column:
    """Wick on one side longer than three bodies, or four when the candle moved towards it."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    wick = h - F.greatest(o, c) if side == "up" else F.least(o, c) - lo
    toward = c > o if side == "up" else c < o
    factor = F.when(toward, 4).otherwise(3)
    return (o != c) & (F.abs(c - o) * factor < wick)


def body_size() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def gap_step(out: str = "gap") -> Step:
    """Opening beyond the previous close, in the direction of two candles of one colour."""

    def apply(laid: Laid) -> Laid:
        laid = laid.add({"_rising": F.col("open") <= F.col("close")})
        up = F.col("_rising") & shift(laid, "_rising") & (F.col("open") > shift(laid, "close"))
        down = ~F.col("_rising") & ~shift(laid, "_rising") & (F.col("open") < shift(laid, "close"))
        return laid.add({out: F.coalesce(up | down, F.lit(False))}).drop("_rising")

    return Step(apply, 1)
