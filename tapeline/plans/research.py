"""The research run: bars, features, labels, split, model, predictions, trades, metrics, artifacts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.operators import labels
from tapeline.operators.features import feature_names, feature_step
from tapeline.operators.metrics import holdout_report, max_drawdown
from tapeline.operators.steps import run
from tapeline.operators.trades import lagged_trades
from tapeline.plans import learning
from tapeline.session import materialize
from tapeline.sources import sinks


@dataclass(frozen=True)
class Settings:
    horizon: int = 5
    ratio: float = 0.7
    purge: int = 5
    embargo: int = 60
    lag: int = 1
    fraction: float = 0.1
    cost: float = 0.3
    equity: float = 100000.0
    iterations: int = 1000


def usable_rows(bars: DataFrame, seconds: float, settings: Settings) -> DataFrame:
    """Rows with all features and a known label, in one pass over the chunked series."""
    names = feature_names("volume" in bars.columns)
    rows = run(bars, seconds, feature_step("volume" in bars.columns), labels.label_step((settings.horizon,)))
    return rows.dropna(subset=[*names, f"label_{settings.horizon}"]).withColumnRenamed(f"label_{settings.horizon}", "label")


def research_run(bars: DataFrame, seconds: float, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Tables of one run: ``predictions``, ``signals``, ``trades``, ``metrics``, ``split``.

    The usable rows are written once, because fitting, scoring and the checks all read them. One model is fitted over
    all symbols; splits, trades and metrics are per symbol.
    """
    names = feature_names("volume" in bars.columns)
    usable = materialize(labels.holdout_split(usable_rows(bars, seconds, settings), seconds, settings.ratio, settings.purge, settings.embargo))
    if not labels.leakage_check(usable, settings.horizon).filter("NOT (in_order AND labels_clear)").isEmpty():
        raise ValueError("the holdout overlaps the training part")
    train = usable.filter("split = 'train'")
    learning.check_inputs(usable, names, "label")
    model = learning.fit_logistic(train, names, "label", iterations=settings.iterations, population=True)
    scored = model.predict(usable)
    holdout = scored.filter("split = 'holdout'").withColumn("prediction", (F.col("probability") >= 0.5).cast("double"))
    holdout = materialize(holdout.select("symbol", "ts", "open", "label", "probability", "prediction"))
    done = lagged_trades(
        holdout, seconds, F.col("probability") >= 0.5, settings.lag, settings.horizon, settings.fraction, settings.cost, settings.equity
    )
    report = holdout_report(holdout, done, settings.equity)
    falls = max_drawdown(done, seconds, "equity", initial=settings.equity).select("symbol", "max_drawdown", "max_drawdown_percent")
    return {
        "predictions": holdout,
        "signals": learning.signal_table(holdout),
        "trades": done.filter("traded"),
        "metrics": report.join(falls, "symbol"),
        "accuracy": learning.accuracy(scored, "label", ("split",)),
        "split": labels.split_bounds(usable),
    }


def write_run(tables: dict[str, DataFrame], path: str, fields: dict[str, object]) -> None:
    """CSV per table and a manifest with their hashes."""
    kept = {name: materialize(df) for name, df in tables.items()}
    for name, df in kept.items():
        sinks.write_csv(df, f"{path}/{name}")
    spark = next(iter(kept.values())).sparkSession
    sinks.write_manifest(sinks.manifest(spark, fields, kept), f"{path}/manifest")


def rule_run(bars: DataFrame, seconds: float, settings: Settings = Settings(fraction=0.002, cost=30.0)) -> DataFrame:
    """The run without a model: long above SMA(10), lagged trades, metrics and drawdown per symbol."""
    from tapeline.operators.layout import POS, TOTAL
    from tapeline.operators.metrics import trade_metrics

    rows = run(bars, seconds, feature_step("volume" in bars.columns), labels.label_step((settings.horizon,)), keep=[POS, TOTAL])
    label = f"label_{settings.horizon}"
    done = lagged_trades(
        rows, seconds, F.col("close") > F.col("sma_10"), settings.lag, settings.horizon, settings.fraction, settings.cost, settings.equity,
        keep=[label, POS, TOTAL],
    )
    done = materialize(done.select("symbol", "ts", "traded", "profit", "equity", label, POS, TOTAL))
    traded = done.filter("traded")
    falls = max_drawdown(done, seconds, "equity", initial=settings.equity).select("symbol", "max_drawdown", "max_drawdown_percent")
    hits = traded.groupBy("symbol").agg(F.avg(label).alias("label_rate"))
    return trade_metrics(traded).join(falls, "symbol").join(hits, "symbol")
