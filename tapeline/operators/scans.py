"""Recurrences and prefix results over a chunked series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.layout import CHUNK, CORE, POS, SLOT, Laid
from tapeline.session import materialize

FADE = 38.0  # exp(-38) < 2**-54: older terms no longer change a double
SAFE_EXPONENT = 640.0  # keeps q**-slot inside the double range
SHORT_FADE = 64  # up to this many rows a fold over a list is the cheaper form


def fade_rows(q: float) -> int:
    """Rows after which ``q**k`` is below double precision."""
    return 0 if q <= 0.0 else math.ceil(FADE / -math.log(q))


def decayed_sum(laid: Laid, b: Column, q: float) -> Column:
    """``x[t] = q * x[t-1] + b[t]`` with ``b`` null counted as zero.

    Needs ``fade_rows(q)`` rows of lookback. Slow decay: one running sum of ``b / q**slot``, scaled back. Where those
    powers would leave the double range, either a fold over the few rows that still count, or running sums in blocks:
    two block grids lie half a block apart, and every row reads the one in which it is in the second half, which is
    further from the block start than any term that still counts.
    """
    if q <= 0.0:
        return b
    rate = -math.log(q)
    slot = F.col(SLOT)

    def scaled(place: Column, frame) -> Column:
        at = place.cast("double")
        return F.sum(b * F.pow(F.lit(q), -at)).over(frame) * F.pow(F.lit(q), at)

    if laid.span * rate < SAFE_EXPONENT:
        return scaled(slot, laid.prefix())
    if fade_rows(q) <= SHORT_FADE:
        recent = F.collect_list(F.coalesce(b, F.lit(0.0))).over(laid.frame(-fade_rows(q), 0))
        return F.aggregate(recent, F.lit(0.0), lambda acc, v: acc * F.lit(q) + v)
    half = int(SAFE_EXPONENT / rate) // 2
    grids = []
    for start in (0, half):
        block = F.floor((slot + start) / (2 * half))
        # the first block starts at the first row, which so keeps its exact value
        place = slot - F.greatest(block * (2 * half) - start, F.lit(0))
        frame = Window.partitionBy(*laid.keys, CHUNK, block).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
        grids.append(scaled(place, frame))
    return F.when(slot % (2 * half) >= half, grids[0]).otherwise(grids[1])


def affine_sum(rows: DataFrame, keys: list[str], order: str, b: str, fade: str, out: str) -> DataFrame:
    """``x[t] = exp(-fade[t]) * x[t-1] + b[t]`` from zero, with a weight per row; ``fade`` is at least zero.

    Running sums of ``b * exp(age)``, scaled back, where ``age`` is the running sum of ``fade``. Ages beyond the double range
    are cut into blocks: two block grids lie half a block apart and every row reads the one in which it is in the second
    half, so what lies before its block has faded below double precision.
    """
    half = SAFE_EXPONENT / 2
    age = F.sum(fade).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_age", age)
    found = {}
    for name, start in (("_a", 0.0), ("_b", half)):
        block = F.floor((F.col("_age") + start) / (2 * half))
        # the first block starts at age zero
        place = F.col("_age") - F.greatest(block * (2 * half) - start, F.lit(0.0))
        frame = Window.partitionBy(*keys, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        found[name] = F.sum(F.col(b) * F.exp(place)).over(frame) * F.exp(-place)
    second = F.pmod(F.col("_age"), F.lit(2 * half)) >= half
    return rows.withColumns(found).withColumn(out, F.when(second, F.col("_a")).otherwise(F.col("_b"))).drop("_age", "_a", "_b")


def ewm_adjusted(laid: Laid, x: Column, q: float) -> Column:
    """Exponential mean whose weights are divided by their sum; null where the input is null."""
    weight = decayed_sum(laid, F.when(x.isNotNull(), F.lit(1.0)), q)
    return F.when(x.isNotNull(), decayed_sum(laid, x, q) / weight)


def ewm_from_start(laid: Laid, x: Column, q: float) -> Column:
    """``ewm_adjusted`` of a column without gaps: the sum of the weights follows from the row number."""
    weight = (1.0 - F.pow(F.lit(q), F.col(POS).cast("double") + 1.0)) / (1.0 - q)
    return decayed_sum(laid, x, q) / weight


def ewm_columns(laid: Laid, specs: dict[str, tuple[Column, float]]) -> Laid:
    """Several ``ewm`` columns at once: ``name -> (input, q)``, not adjusted, null until the first known value."""
    inputs = {f"_in_{n}": x for n, (x, _) in specs.items()}
    laid = laid.add(inputs)
    seen = {f"_seen_{n}": F.count(f"_in_{n}").over(laid.prefix(-1)) for n in specs}
    laid = laid.add(seen)
    fed = {
        f"_fed_{n}": F.when(F.col(f"_seen_{n}") == 0, F.col(f"_in_{n}")).otherwise(F.col(f"_in_{n}") * (1.0 - q))
        for n, (_, q) in specs.items()
    }
    laid = laid.add(fed)
    out = {
        n: F.when((F.col(f"_seen_{n}") > 0) | F.col(f"_in_{n}").isNotNull(), decayed_sum(laid, F.col(f"_fed_{n}"), q))
        for n, (_, q) in specs.items()
    }
    laid = laid.add(out)
    return laid.drop(*inputs, *seen, *fed)


def prefix_carry(
    laid: Laid, specs: dict[str, tuple[str, Column]], reverse: bool = False, inclusive: bool = True
) -> Laid:
    """Prefix (or suffix) results over the whole series: ``name -> (kind, input)``.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last``. Inside a chunk it is a running frame; between chunks one summary
    row per chunk is scanned and joined back. Of the overlap, only the row next to the chunk keeps a right value.
    """
    bound = 0 if inclusive else (1 if reverse else -1)
    if reverse:
        inner = laid.by_chunk().rowsBetween(bound, Window.unboundedFollowing)
        outer = Window.partitionBy(*laid.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    else:
        inner = laid.by_chunk().rowsBetween(Window.unboundedPreceding, bound)
        outer = Window.partitionBy(*laid.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    staged = laid.add({f"_in_{n}": F.when(F.col(CORE), x) for n, (_, x) in specs.items()})

    def inside(kind: str, name: str) -> Column:
        col = F.col(f"_in_{name}")
        if kind == "last":
            pick = F.first if reverse else F.last
            return pick(col, ignorenulls=True).over(inner)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col).over(inner)

    def summary(kind: str, name: str) -> Column:
        col = F.col(f"_in_{name}")
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            return pick(col, F.when(col.isNotNull(), F.col(POS)))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col)

    def between(kind: str, name: str) -> Column:
        col = F.col(f"_sum_{name}")
        if kind == "last":
            return F.last(col, ignorenulls=True).over(outer)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](col).over(outer)

    def merged(kind: str, name: str) -> Column:
        local, before = F.col(f"_local_{name}"), F.col(f"_before_{name}")
        if kind == "sum":
            return F.coalesce(local + before, local, before)
        if kind == "last":
            return F.coalesce(local, before)
        return {"max": F.greatest, "min": F.least}[kind](local, before)

    keys = [*laid.keys, CHUNK]
    tops = staged.df.groupBy(*keys).agg(*[summary(k, n).alias(f"_sum_{n}") for n, (k, _) in specs.items()])
    carry = materialize(tops).select(*keys, *[between(k, n).alias(f"_before_{n}") for n, (k, _) in specs.items()])
    local = staged.add({f"_local_{n}": inside(k, n) for n, (k, _) in specs.items()})
    joined = local.on(local.df.join(carry, keys, "left"))
    done = joined.add({n: merged(k, n) for n, (k, _) in specs.items()})
    scratch = [f"{p}{n}" for n in specs for p in ("_in_", "_local_", "_before_")]
    return done.drop(*scratch)


def shift(laid: Laid, x: Column | str, k: int = 1) -> Column:
    """Value ``k`` rows earlier (later when negative); ``k`` must fit the overlap."""
    col = F.col(x) if isinstance(x, str) else x
    return F.lag(col, k).over(laid.by_chunk()) if k >= 0 else F.lead(col, -k).over(laid.by_chunk())


def rolling(laid: Laid, agg, x: Column | str, n: int, last: int = 0) -> Column:
    """Aggregate over the ``n`` rows ending at row ``last``; null unless all ``n`` values are known."""
    col = F.col(x) if isinstance(x, str) else x
    frame = laid.frame(last - n + 1, last)
    return F.when(F.count(col).over(frame) == n, agg(col).over(frame))
