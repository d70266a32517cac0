"""Future labels and time-ordered splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.layout import POS, TOTAL, Laid, with_positions
from tapeline.operators.scans import shift
from tapeline.operators.steps import Step

DEFAULT_HORIZONS = (1, 3, 5, 10)
DEFAULT_RATIOS = (0.7, 0.15, 0.15)


def label_step(horizons: Sequence[int] = DEFAULT_HORIZONS, threshold: float = 0.0) -> Step:
    """``future_return_h`` and ``label_h`` (1 above the threshold, 0 otherwise, null when the future is unknown)."""
    wanted = sorted(set(horizons))
    if not wanted or wanted[0] <= 0:
        raise ValueError("horizons must be positive")

    def apply(laid: Laid) -> Laid:
        ahead = {h: F.try_divide(shift(laid, "close", -h), F.col("close")) - 1 for h in wanted}
        laid = laid.add({f"future_return_{h}": r for h, r in ahead.items()})
        labels = {
            f"label_{h}": F.when(F.col(f"future_return_{h}") > threshold, 1.0).when(
                F.col(f"future_return_{h}").isNotNull(), 0.0
            )
            for h in wanted
        }
        return laid.add(labels)

    return Step(apply, 0, wanted[-1], causal=False)


def split_sizes(total: Column, ratios: Sequence[float] = DEFAULT_RATIOS) -> list[Column]:
    """Part sizes by largest remainder; a tie goes to the later part."""
    if any(r <= 0 for r in ratios) or sum(ratios) > 1 + 1e-9:
        raise ValueError("ratios must be positive and sum to at most one")
    exact = [total * float(r) for r in ratios]
    floors = [F.floor(e) for e in exact]
    left = total - sum(floors[1:], floors[0])
    order = F.array_sort(
        F.array(*[F.struct((f - e).alias("rest"), F.lit(-i).alias("part")) for i, (e, f) in enumerate(zip(exact, floors))])
    )
    parts = F.transform(order, lambda s: s["part"])
    return [f + (F.array_position(parts, F.lit(-i)) <= left).cast("long") for i, f in enumerate(floors)]


def positioned(df: DataFrame, seconds: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Row number and series length as plain columns ``row`` and ``rows``."""
    return with_positions(df, seconds, keys).withColumnsRenamed({POS: "row", TOTAL: "rows"})


def split_time_series(
    df: DataFrame,
    seconds: float,
    horizon: int,
    purge: int = 0,
    embargo: int = 0,
    sizes: Sequence[int] | None = None,
    ratios: Sequence[float] = DEFAULT_RATIOS,
    layout: str = "shifted",
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Column ``split`` (train, validation, test); rows outside every part are dropped.

    ``shifted``: validation starts where the shortened training part ends, plus the embargo. ``gapped``: the rows cut
    off the training part stay unused.
    """
    if layout not in ("shifted", "gapped"):
        raise ValueError(f"unknown layout {layout!r}")
    guard = max(horizon, purge)
    numbered = positioned(df, seconds, keys)
    parts = [F.lit(s) for s in sizes] if sizes else split_sizes(F.col("rows"), ratios)
    cut = parts[0] - guard
    start = (cut if layout == "shifted" else parts[0]) + embargo
    stop = start + parts[1]
    test = stop + embargo
    row = F.col("row")
    split = (
        F.when(row < cut, "train")
        .when((row >= start) & (row < stop), "validation")
        .when((row >= test) & (row < test + parts[2]), "test")
    )
    return numbered.withColumn("split", split).filter(F.col("split").isNotNull())


def holdout_split(
    df: DataFrame, seconds: float, ratio: float = 0.7, purge: int = 5, embargo: int = 60, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Training part, an unused gap of ``purge + embargo`` rows, holdout."""
    numbered = positioned(df, seconds, keys)
    cut = F.floor(F.col("rows") * ratio)
    split = F.when(F.col("row") < cut, "train").when(F.col("row") >= cut + purge + embargo, "holdout")
    return numbered.withColumn("split", split).filter(F.col("split").isNotNull())


def two_way_split(df: DataFrame, seconds: float, ratio: float = 0.7, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    numbered = positioned(df, seconds, keys)
    cut = F.greatest(F.lit(1), F.floor(F.col("rows") * ratio))
    return numbered.withColumn("split", F.when(F.col("row") < cut, "train").otherwise("test"))


def walk_forward_folds(
    df: DataFrame,
    seconds: float,
    train: int,
    validation: int,
    test: int,
    horizon: int,
    step: int | None = None,
    purge: int = 0,
    embargo: int = 0,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Every row once per fold and part that holds it: columns ``fold``, ``split``.

    The folds of a row follow from its position by arithmetic, so nothing is joined.
    """
    stride = step or validation
    guard = max(horizon, purge)
    need = train + validation + test + guard + embargo
    numbered = positioned(df, seconds, keys).filter(F.col("rows") >= need)
    last = F.floor((F.col("rows") - need) / stride)
    cut = train - guard
    bounds = [
        ("train", 0, cut),
        ("validation", cut + embargo, cut + embargo + validation),
        ("test", cut + 2 * embargo + validation, cut + 2 * embargo + validation + test),
    ]
    member = []
    for name, lo, hi in bounds:
        first = F.greatest(F.lit(0), F.floor((F.col("row") - hi) / stride) + 1)
        until = F.least(last, F.floor((F.col("row") - lo) / stride))
        folds = F.when(first <= until, F.sequence(first, until)).otherwise(F.array().cast("array<bigint>"))
        member.append(F.arrays_zip(folds.alias("fold"), F.array_repeat(F.lit(name), F.size(folds)).alias("split")))
    spread = numbered.withColumn("_m", F.explode(F.concat(*member)))
    return spread.withColumns({"fold": F.col("_m.fold"), "split": F.col("_m.split")}).drop("_m")


def split_bounds(split: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First and last row and time per part."""
    return split.groupBy(*keys, "split").agg(
        F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.min("row").alias("first_row"),
        F.max("row").alias("last_row"),
    )


def leakage_check(split: DataFrame, horizon: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key: parts in time order, and every training label known before the next part starts."""
    parts = [r for r in ("train", "validation", "test", "holdout")]
    aggs = []
    for p in parts:
        inside = F.when(F.col("split") == p, F.col("row"))
        aggs += [F.min(inside).alias(f"_{p}_lo"), F.max(inside).alias(f"_{p}_hi")]
    wide = split.groupBy(*keys).agg(*aggs)
    after = F.coalesce(*[F.col(f"_{p}_lo") for p in parts[1:]])
    ordered = F.coalesce(F.col("_train_hi") < after, F.lit(True)) & F.coalesce(
        F.col("_validation_hi") < F.col("_test_lo"), F.lit(True)
    )
    clears = F.coalesce(F.col("_train_hi") + horizon < F.coalesce("_holdout_lo", "_test_lo"), F.lit(True))
    return wide.select(*keys, ordered.alias("in_order"), clears.alias("labels_clear"))
