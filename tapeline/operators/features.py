"""The 26 trailing features of a bar series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators.layout import Laid
from tapeline.operators.moving_averages import span_decay
from tapeline.operators.scans import ewm_columns, fade_rows, rolling, shift
from tapeline.operators.steps import Step, run

FEATURES_VERSION = "1"
PRICE_FEATURES = (
    "return_1", "return_3", "return_5", "return_10", "log_return_1", "true_range", "atr_14", "rolling_std_10",
    "normalized_volatility", "sma_10", "ema_10", "price_vs_sma_10", "price_vs_ema_10", "ema_relationship", "rsi_14",
    "roc_10", "momentum_10", "range", "body", "upper_wick", "lower_wick", "body_range_ratio", "close_position",
)
VOLUME_FEATURES = ("volume_change_1", "volume_mean_10", "relative_volume_10")


def feature_names(with_volume: bool = True) -> tuple[str, ...]:
    return PRICE_FEATURES + (VOLUME_FEATURES if with_volume else ())


def feature_step(with_volume: bool = True) -> Step:
    def apply(laid: Laid) -> Laid:
        o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
        prev = shift(laid, "close")
        change = c - prev
        laid = laid.add(
            {
                **{f"return_{k}": F.try_divide(c, shift(laid, "close", k)) - 1 for k in (1, 3, 5, 10)},
                "log_return_1": F.ln(F.try_divide(c, prev)),
                "true_range": F.when(prev.isNotNull(), F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))),
                "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
                "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
                "roc_10": F.try_divide(c, shift(laid, "close", 10)) - 1,
                "momentum_10": c - shift(laid, "close", 10),
                "range": h - lo,
                "body": c - o,
                "upper_wick": h - F.greatest(o, c),
                "lower_wick": F.least(o, c) - lo,
                "sma_10": rolling(laid, F.avg, "close", 10),
                "_known": F.count("close").over(laid.prefix()),
            }
        )
        laid = laid.add(
            {
                "atr_14": rolling(laid, F.avg, "true_range", 14),
                "rolling_std_10": rolling(laid, F.stddev_samp, "return_1", 10),
                "_up": rolling(laid, F.avg, "_gain", 14),
                "_down": rolling(laid, F.avg, "_loss", 14),
            }
        )
        laid = ewm_columns(laid, {"ema_10": (c, span_decay(10))})
        laid = laid.add({"ema_10": F.when(F.col("_known") >= 10, F.col("ema_10"))})
        up, down, width = F.col("_up"), F.col("_down"), F.nullif(F.col("range"), F.lit(0.0))
        strength = F.when(down > 0, 100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
        strength = strength.when(up > 0, F.lit(100.0)).when(up.isNotNull() & down.isNotNull(), F.lit(50.0))
        laid = laid.add(
            {
                "normalized_volatility": F.try_divide(F.col("rolling_std_10"), c),
                "price_vs_sma_10": F.try_divide(c, F.col("sma_10")) - 1,
                "price_vs_ema_10": F.try_divide(c, F.col("ema_10")) - 1,
                "ema_relationship": F.try_divide(F.col("ema_10"), F.col("sma_10")) - 1,
                "rsi_14": strength,
                "body_range_ratio": F.col("body") / width,
                "close_position": (c - lo) / width,
            }
        )
        if with_volume:
            v = F.col("volume")
            laid = laid.add(
                {
                    "volume_change_1": F.try_divide(v, shift(laid, "volume")) - 1,
                    "volume_mean_10": rolling(laid, F.avg, "volume", 10),
                }
            )
            laid = laid.add({"relative_volume_10": F.try_divide(v, F.col("volume_mean_10"))})
        return laid.drop("_gain", "_loss", "_up", "_down", "_known")

    return Step(apply, fade_rows(span_decay(10)) + 15)


def build_features(bars: DataFrame, seconds: float, drop_warmup: bool = True) -> DataFrame:
    """All features, in one pass over the chunked series; warm-up rows stay null or are dropped, never filled."""
    with_volume = "volume" in bars.columns
    out = run(bars, seconds, feature_step(with_volume))
    return out.dropna(subset=list(feature_names(with_volume))) if drop_warmup else out


def feature_metadata(bars: DataFrame, features: DataFrame, drop_warmup: bool = True) -> DataFrame:
    """One row: names, counts, warm-up policy and version."""
    with_volume = "volume" in bars.columns
    names = F.array(*[F.lit(n) for n in feature_names(with_volume)])
    before = bars.agg(F.count("*").alias("input_rows"))
    after = features.agg(F.count("*").alias("output_rows"))
    # two one-row aggregates side by side
    return before.join(after, F.lit(True)).select(
        names.alias("features"),
        F.lit(len(feature_names(with_volume))).alias("feature_count"),
        "input_rows",
        "output_rows",
        (F.col("input_rows") - F.col("output_rows")).alias("dropped_rows"),
        F.lit("drop" if drop_warmup else "keep").alias("warmup_policy"),
        F.lit(FEATURES_VERSION).alias("version"),
    )
