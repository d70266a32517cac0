"""Steps: column builders that state how many neighbouring rows they need."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeline.operators.layout import Laid, lay_out


@dataclass(frozen=True)
class Step:
    """Adds columns to a chunked series. ``causal`` is false when a value depends on later rows."""

    apply: Callable[[Laid], Laid]
    lookback: int = 0
    lookahead: int = 0
    causal: bool = True

    def __rshift__(self, other: Step) -> Step:
        """Run ``other`` on the columns this step adds."""
        return Step(
            lambda laid: other.apply(self.apply(laid)),
            self.lookback + other.lookback,
            self.lookahead + other.lookahead,
            self.causal and other.causal,
        )


def together(*steps: Step) -> Step:
    """Independent steps over the same overlap."""

    def apply(laid: Laid) -> Laid:
        for step in steps:
            laid = step.apply(laid)
        return laid

    return Step(
        apply,
        max((s.lookback for s in steps), default=0),
        max((s.lookahead for s in steps), default=0),
        all(s.causal for s in steps),
    )


def dropping(step: Step, *names: str) -> Step:
    """The step without some helper columns."""
    return Step(lambda laid: step.apply(laid).drop(*names), step.lookback, step.lookahead, step.causal)


def run(
    df: DataFrame,
    seconds: float,
    *steps: Step,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    rows: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Lay the series out once, apply independent steps, return the series with the new columns."""
    step = together(*steps)
    laid = lay_out(df, seconds, step.lookback, step.lookahead, keys, ts, tie, rows)
    return step.apply(laid).core(keep)
