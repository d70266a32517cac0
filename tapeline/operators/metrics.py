"""Performance of trades and equity curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.asof import asof_join
from tapeline.operators.layout import POS, TOTAL, lay_out
from tapeline.operators.scans import prefix_carry, shift
from tapeline.session import materialize


def trade_metrics(
    trades: DataFrame, keys: Sequence[str] = ("symbol",), initial_balance: float = 0.0, periods: int = 252
) -> DataFrame:
    """Counts, win rate, profit factor, expectancy, averages, Sharpe and Sortino per key."""
    p = F.col("profit")
    r = p / initial_balance if initial_balance else p
    gross_profit = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))
    gross_loss = F.coalesce(F.sum(F.when(p < 0, -p)), F.lit(0.0))
    zero = F.lit(0.0)
    sums = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(p > 0).alias("wins"),
        F.count_if(p < 0).alias("losses"),
        gross_profit.alias("gross_profit"),
        gross_loss.alias("gross_loss"),
        F.sum(p).alias("net_profit"),
        F.avg(p).alias("expectancy"),
        F.coalesce(F.avg(F.when(p > 0, p)), zero).alias("average_win"),
        F.coalesce(F.avg(F.when(p < 0, p)), zero).alias("average_loss"),
        F.avg(r).alias("_mean"),
        F.coalesce(F.stddev_samp(r), zero).alias("_dev"),
        F.sqrt(F.avg(F.pow(F.least(r, zero), F.lit(2.0)))).alias("_down"),
    )
    scale = math.sqrt(periods)
    factor = F.when(F.col("gross_loss") > 0, F.try_divide(F.col("gross_profit"), F.col("gross_loss")))
    return sums.withColumns(
        {
            "win_rate": F.col("wins") / F.col("trades") * 100,
            "profit_factor": factor.when(F.col("gross_profit") > 0, F.lit(float("inf"))).otherwise(zero),
            "sharpe": F.coalesce(F.try_divide(F.col("_mean"), F.col("_dev")) * scale, zero),
            "sortino": F.coalesce(F.try_divide(F.col("_mean"), F.col("_down")) * scale, zero),
        }
    ).drop("_mean", "_dev", "_down")


def balance_curve(
    trades: DataFrame,
    seconds: float,
    initial_balance: float,
    keys: Sequence[str] = ("symbol",),
    ts: str = "exit_ts",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Balance after every trade, in order of exit. The trades are written once, as several passes read them."""
    laid = lay_out(materialize(trades), seconds, keys=keys, ts=ts, tie=tie)
    laid = prefix_carry(laid, {"_sum": ("sum", F.col("profit"))})
    return laid.add({"balance": F.col("_sum") + initial_balance}).drop("_sum").core(keep=[POS, TOTAL])


def max_drawdown(
    curve: DataFrame,
    seconds: float,
    value: str,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    initial: float | None = None,
) -> DataFrame:
    """Worst fall from a running peak and three percentages per key.

    ``max_drawdown_percent`` divides by the peak of that fall, ``percent_of_final_peak`` by the last peak,
    ``max_percent`` is the worst percentage of any row.
    """
    laid = lay_out(curve, seconds, keys=keys, ts=ts, tie=tie)
    laid = prefix_carry(laid, {"_peak": ("max", F.col(value))})
    if initial is not None:
        laid = laid.add({"_peak": F.greatest(F.col("_peak"), F.lit(float(initial)))})
    rows = laid.add({"_fall": F.col("_peak") - F.col(value)}).core(keep=[POS])
    worst = F.max_by(F.struct("_peak", F.col(value).alias("_value"), "_fall"), F.struct("_fall", -F.col(POS)))
    sums = rows.groupBy(*keys).agg(
        worst.alias("_w"),
        F.max("_peak").alias("_final"),
        F.max(F.try_divide(F.col("_fall"), F.col("_peak")) * 100).alias("max_percent"),
    )
    fall = F.col("_w._fall")
    trough = F.when(fall > 0, F.col("_w._value")).otherwise(F.col("_w._peak"))
    return sums.select(
        *keys,
        fall.alias("max_drawdown"),
        (F.coalesce(F.try_divide(fall, F.col("_w._peak")), F.lit(0.0)) * 100).alias("max_drawdown_percent"),
        F.col("_w._peak").alias("peak"),
        trough.alias("trough"),
        (F.coalesce(F.try_divide(fall, F.col("_final")), F.lit(0.0)) * 100).alias("percent_of_final_peak"),
        F.coalesce("max_percent", F.lit(0.0)).alias("max_percent"),
    )


def worst_daily_drawdown(
    bars: DataFrame,
    trades: DataFrame,
    seconds: float,
    initial_balance: float,
    worth: float,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Deepest fall of the marked equity below the balance at the start of its day.

    A bar is inside a trade after its entry bar and up to its exit bar; ``worth`` is money per price unit.
    """
    keys = list(keys)
    trades = materialize(trades)
    numbered = lay_out(bars, seconds, keys=keys).core(keep=[POS]).select(*keys, "ts", "close", F.to_date("ts").alias("day"))
    curve = balance_curve(trades, seconds, initial_balance, keys)
    known = curve.select(*keys, F.col("exit_ts").alias("ts"), "balance")
    marked = asof_join(numbered, known, ["balance"], seconds=seconds, keys=keys, strict=True)
    entries = trades.select(*keys, F.col("entry_ts").alias("ts"), "side", "entry_price", "exit_ts", "by_signal")
    marked = asof_join(marked, entries, ["side", "entry_price", "exit_ts", "by_signal"], seconds=seconds, keys=keys, strict=True)
    balance = F.coalesce("balance", F.lit(float(initial_balance)))
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    inside = (F.col("ts") < F.col("exit_ts")) | ((F.col("ts") == F.col("exit_ts")) & ~F.col("by_signal"))
    equity = F.when(inside, balance + sign * (F.col("close") - F.col("entry_price")) * worth)
    marked = marked.withColumns({"_balance": balance, "_equity": equity})
    starts = marked.groupBy(*keys, "day").agg(F.min_by("_balance", "ts").alias("_start"), F.min("_equity").alias("_low"))
    fall = F.greatest(F.col("_start") - F.col("_low"), F.lit(0.0))
    falls = starts.withColumns({"_fall": F.coalesce(fall, F.lit(0.0))})
    worst = F.max_by(F.struct("_fall", "_start", "day"), F.struct("_fall", -F.unix_date("day"))).alias("_w")
    return falls.groupBy(*keys).agg(worst).select(
        *keys,
        F.col("_w._fall").alias("max_daily_drawdown"),
        (F.coalesce(F.try_divide(F.col("_w._fall"), F.col("_w._start")), F.lit(0.0)) * 100).alias("max_daily_drawdown_percent"),
    )


def streaks(trades: DataFrame, seconds: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longest runs of losing stops and of targets. Break-even stops are skipped, a manual close ends a run."""
    kind = F.when((F.col("exit_reason") == "SL") & (F.col("profit") < 0), "sl").when(F.col("exit_reason") == "TP", "tp")
    kind = kind.when(F.col("exit_reason") == "Manual Close", "manual")
    counted = trades.withColumn("_kind", kind).filter("_kind IS NOT NULL").select(*keys, "exit_ts", "_kind")
    laid = lay_out(materialize(counted), seconds, 1, keys=keys, ts="exit_ts")
    changed = shift(laid, "_kind").isNull() | (shift(laid, "_kind") != F.col("_kind"))
    laid = laid.add({"_turn": changed.cast("long")})
    laid = prefix_carry(laid, {"_run": ("sum", F.col("_turn"))})
    runs = laid.core().groupBy(*keys, "_run", "_kind").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_kind") == "sl", F.col("_n"))), F.lit(0)).alias("max_consecutive_sl"),
        F.coalesce(F.max(F.when(F.col("_kind") == "tp", F.col("_n"))), F.lit(0)).alias("max_consecutive_tp"),
    )


def backtest_report(trades: DataFrame, initial_balance: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exit-reason counts, win rate without break-even trades, average lot, ROI, population Sharpe."""
    p = F.col("profit")
    reason = F.col("exit_reason")
    dev = F.stddev_pop(p)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        F.count_if(p == 0).alias("breakeven"),
        F.coalesce(F.try_divide(F.count_if(p > 0), F.count_if(p != 0)) * 100, F.lit(0.0)).alias("win_rate_no_breakeven"),
        F.count_if(reason == "TP").alias("tp"),
        F.count_if((reason == "SL") & (p < 0)).alias("sl"),
        F.count_if(reason == "Manual Close").alias("manual"),
        F.avg("lot").alias("average_lot"),
        (F.sum(p) / initial_balance * 100).alias("roi"),
        (F.sum(p) + initial_balance).alias("final_balance"),
        F.coalesce(F.try_divide(F.avg(p), dev) * math.sqrt(252), F.lit(0.0)).alias("sharpe_pop"),
    )


def profit_by_weekday(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Profit and count for Monday (0) to Sunday (6); days without trades are zero."""
    keys = list(keys)
    days = trades.select(*keys).distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    sums = trades.groupBy(*keys, F.weekday("entry_ts").alias("weekday")).agg(
        F.sum("profit").alias("profit"), F.count("*").alias("trades")
    )
    return days.join(sums, [*keys, "weekday"], "left").fillna({"profit": 0.0, "trades": 0})


def session_starts(hours: float) -> list[int]:
    """Start minutes of sessions of a given length: every full and half hour that ends within the day."""
    length = int(hours * 60)
    starts = [h * 60 + m for h in range(24) for m in (0, 30) if m == 0 or h < 23 or length <= 30]
    return [s for s in starts if s + length <= 1440]


def _clock(minutes: int) -> str:
    return f"{minutes // 60:02d}:{minutes % 60:02d}"


def profit_by_session(trades: DataFrame, hours: float = 4.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Profit and count per sliding time-of-day session, with the best and the worst one marked."""
    keys = list(keys)
    length = int(hours * 60)
    slots = F.array(
        *[F.struct(F.lit(s).alias("start"), F.lit(f"{_clock(s)}-{_clock(s + length)}").alias("session")) for s in session_starts(hours)]
    )
    every = trades.select(*keys).distinct().select(*keys, F.explode(slots).alias("_s")).select(*keys, "_s.start", "_s.session")
    minute = F.hour("entry_ts") * 60 + F.minute("entry_ts")
    # a trade belongs to a fixed number of sessions, found by arithmetic
    by_minute = trades.groupBy(*keys, minute.alias("_m")).agg(F.sum("profit").alias("_p"), F.count("*").alias("_n"))
    held = F.filter(slots, lambda s: (s["start"] <= F.col("_m")) & (F.col("_m") < s["start"] + length))
    sums = (
        by_minute.withColumn("_s", F.explode(held))
        .groupBy(*keys, F.col("_s.start").alias("start"))
        .agg(F.sum("_p").alias("profit"), F.sum("_n").alias("trades"))
    )
    rows = every.join(sums, [*keys, "start"], "left").fillna({"profit": 0.0, "trades": 0})
    ends = rows.groupBy(*keys).agg(
        F.min_by("start", F.struct(-F.col("profit"), "start")).alias("_best"),
        F.min_by("start", F.struct("profit", "start")).alias("_worst"),
    )
    marked = rows.join(ends, keys)
    return marked.withColumns(
        {"is_best": F.col("start") == F.col("_best"), "is_worst": F.col("start") == F.col("_worst")}
    ).drop("_best", "_worst", "start")


def holdout_report(predictions: DataFrame, trades: DataFrame, equity: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Accuracy and signal counts of predictions beside trade counts, win rate, profit factor and return."""
    scores = predictions.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.count_if(F.col("prediction") == 1).alias("long_signals"),
        F.count_if(F.col("prediction") != 1).alias("flat_signals"),
    )
    done = trade_metrics(trades.filter("traded"), keys).select(*keys, "trades", "win_rate", "profit_factor", "net_profit")
    joined = scores.join(done, list(keys), "left")
    return joined.withColumn("return_percent", F.coalesce(F.col("net_profit"), F.lit(0.0)) / equity * 100)


def roi(net: Column, initial_balance: float) -> Column:
    return net / initial_balance * 100
