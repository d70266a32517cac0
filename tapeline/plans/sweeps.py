"""Parameter grids, sweeps, hit rates, experiments and walk-forward selection."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.operators.layout import POS, lay_out, with_positions
from tapeline.operators.metrics import balance_curve, max_drawdown, trade_metrics
from tapeline.operators.scans import shift
from tapeline.operators.trades import set_trades

# Default grids per indicator.
DEFAULT_GRIDS = {
    "ema": {"window": [5, 10, 15, 20, 30, 40, 50, 70, 100, 150, 170, 200]},
    "ema_cross": {
        "fast_period": [10, 15, 20, 25, 30, 35, 40, 45, 50],
        "slow_period": [20, 30, 40, 50, 70, 90, 100, 130, 150, 170, 200],
    },
    "macd": {"fast": [10, 12, 15, 17, 20], "slow": [10, 21, 26, 34, 50], "signal": [5, 9, 13]},
    "super_trend": {"atr_period": [5, 10, 12, 13, 14, 15, 20], "multiplier": [2.0, 3.0, 4.0, 5.0]},
    "ut_bot": {"key_value": [2, 3, 4, 5, 6, 7], "atr_period": [8, 10, 12, 14, 16]},
    "kalman_trend": {"sell_len": [5, 10, 20, 30, 40, 50, 60, 70, 80], "buy_len": [50, 70, 100, 150, 200]},
    "trend_ali": {"length": [60], "length_mult": [6.0], "mode": ["Hma"]},
    "half_trend": {"amplitude": [2, 3, 4, 5, 6], "channel_deviation": [2, 3]},
    "volumatic_vidya": {"vidya_length": [8, 10, 12], "vidya_momentum": [15, 20, 25], "band_distance": [1.5, 2.0, 2.5]},
    "deviation_trend": {"sma_length": [10, 20, 30, 40, 50, 70]},
    "stoch_rsi": {"rsi_length": [9, 14, 21], "stoch_length": [9, 14, 21], "k_period": [3, 5, 7], "d_period": [3, 5, 7]},
}


def param_grid(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """Every combination as a row, by exploding one axis after the other; ``combo`` is its canonical text."""
    grid = spark.range(1).drop("id")
    for name, options in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    quoted = [F.concat(F.lit("'"), F.col(n).cast("string"), F.lit("'")) for n in values]
    inner = F.concat_ws(", ", *quoted)
    comma = F.lit(",)") if len(values) == 1 else F.lit(")")
    return grid.withColumn("combo", F.concat(F.lit("("), inner, comma))


def cap_by_hash(grid: DataFrame, seed: str, limit: int | None = None) -> DataFrame:
    """The whole grid, or with ``limit`` at most that many combinations, those with the smallest SHA-256 of ``seed:combo``."""
    return grid if limit is None else grid.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "combo"), 256)).limit(limit)


def risk_grid(
    break_even: Sequence[float], stops: Sequence[float], targets: Sequence[float], switches: Sequence[bool] = (True, False)
) -> Iterator[dict]:
    """Backtest settings; a distance varies only where its switch is on."""
    for free, stop, target in itertools.product(switches, repeat=3):
        axes = (break_even if free else [0], stops if stop else [0], targets if target else [0], switches)
        for b, s, t, opposite in itertools.product(*axes):
            yield {
                "use_risk_free": free, "risk_free_distance_pips": b, "use_sl": stop, "sl_pips": s, "use_tp": target, "tp_pips": t,
                "close_opposite_position": opposite,
            }


def with_params(bars: DataFrame, params: Sequence[dict]) -> DataFrame:
    """Every bar once per parameter set with ``param_id`` and the parameters, for signals that no single row can give.

    The sets are one constant of the plan, however many there are. Sweeps of trades do not copy bars (``sweep_trades``).
    """
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    shape = "param_id int, " + ", ".join(f"{n} {kinds[type(v)]}" for n, v in params[0].items())
    told = json.dumps([{"param_id": i, **p} for i, p in enumerate(params)])
    sets = F.from_json(F.lit(told), f"array<struct<{shape.replace(' ', ':').replace(',:', ',')}>>")
    return bars.withColumn("_p", F.explode(sets)).select("*", "_p.*").drop("_p")


def _half_up(value: float, digits: int) -> float:
    """Rounding of a constant as the column function rounds."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def trade_setting(p: dict, pip: float, per_lot: float, initial_balance: float = 5000.0, risk_percent: float = 2.0) -> dict:
    """Distances, lot and money per price unit of a parameter set; missing ones default to stop 500, target 1000 pips, no break-even."""
    p = {"use_risk_free": False, "risk_free_distance_pips": 0.0, "use_sl": True, "sl_pips": 500.0, "use_tp": True, "tp_pips": 1000.0,
         "close_opposite_position": False, **p}
    distance = lambda switch, pips: float(p[pips]) * pip if p[switch] else float("nan")
    stop = distance("use_sl", "sl_pips")
    pips = (stop if p["use_sl"] else 50 * pip) / pip
    lot = max(0.01, _half_up(initial_balance * risk_percent / 100.0 / (pips * per_lot), 2)) if pips > 0 else float("nan")
    worth = _half_up(lot * per_lot, 3) / pip if pips > 0 else float("nan")
    return {"stop": stop, "target": distance("use_tp", "tp_pips"), "break_even": distance("use_risk_free", "risk_free_distance_pips"),
            "close_opposite": p["close_opposite_position"], "lot": lot, "worth": worth}


def sweep_trades(
    bars: DataFrame,
    seconds: float,
    params: Sequence[dict],
    signal: Callable[[dict], Column],
    pip: float,
    per_lot: float,
    initial_balance: float = 5000.0,
    risk_percent: float = 2.0,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Trades of every parameter set; ``signal`` gives the signal column of a set. A chunk of bars is walked for all sets at once."""
    settings = [trade_setting(p, pip, per_lot, initial_balance, risk_percent) for p in params]
    signals = F.array(*[F.coalesce(signal(p), F.lit(0)).cast("byte") for p in params])
    return set_trades(bars if POS in bars.columns else with_positions(bars, seconds, keys), seconds, signals, settings, keys)


def sweep_metrics(
    trades: DataFrame, seconds: float, params: Sequence[dict], initial_balance: float, keys: Sequence[str] = ("symbol",),
    universe: DataFrame | None = None,
) -> DataFrame:
    """ROI, win rate, profit factor and drawdown per key and parameter set; sets without trades have that status."""
    by = [*keys, "param_id"]
    sums = trade_metrics(trades, by, initial_balance)
    falls = max_drawdown(
        balance_curve(trades, seconds, initial_balance, by), seconds, "balance", by, ts="exit_ts", initial=initial_balance
    ).select(*by, F.col("percent_of_final_peak").alias("max_drawdown"))
    rows = sums.join(falls, by).select(
        *by, (F.col("net_profit") / initial_balance * 100).alias("roi"), F.col("win_rate").alias("winrate"), F.col("trades").alias("total_trades"),
        "profit_factor", "max_drawdown", (F.col("net_profit") + initial_balance).alias("final_balance"), F.col("net_profit").alias("total_profit"),
    )
    base = universe if universe is not None else trades.select(*keys).distinct()
    every = base.withColumn("param_id", F.explode(F.sequence(F.lit(0), F.lit(len(params) - 1))))
    joined = every.join(rows, by, "left")
    return joined.withColumn("status", F.when(F.col("total_trades").isNull(), "no_trades").otherwise("success"))


def best_result(results: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key the successful set with the highest ROI, then win rate, then the earliest."""
    keys = list(keys)
    rest = [c for c in results.columns if c not in keys]
    done = results.filter("status = 'success'")
    picked = done.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("roi", "winrate", -F.col("param_id"))).alias("_b"))
    return picked.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def top_setups(results: DataFrame, n: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sets among the best ``n`` both by ROI and by win rate. A key has at most as many rows as there are sets."""
    done = results.filter("status = 'success'")
    by = lambda c: Window.partitionBy(*keys).orderBy(F.desc(c), "param_id")
    roi = done.withColumn("_r", F.row_number().over(by("roi"))).filter(F.col("_r") <= n).drop("_r")
    rate = done.withColumn("_r", F.row_number().over(by("winrate"))).filter(F.col("_r") <= n)
    return roi.join(rate.select(*keys, "param_id"), [*keys, "param_id"], "left_semi")


# -- hit rates --------------------------------------------------------------------------------------------------


def wald_bounds(rate: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a percentage, within 0..100."""
    p = rate / 100
    width = F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0))) * 1.96
    return F.greatest(F.lit(0.0), p - width) * 100, F.least(F.lit(100.0), p + width) * 100


def hit_rate_events(rows: DataFrame, seconds: float, horizons: Sequence[int], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entries into ``buy`` or ``sell`` with the close ``h`` bars later, one row per horizon.

    ``rows``: keys, ts, close, state. The keys may include a window id: states and closes never cross it.
    """
    laid = lay_out(rows, seconds, 1, max(horizons), keys=keys)
    prev = shift(laid, "state")
    entered = F.col("state").isin("buy", "sell") & prev.isNotNull() & (F.col("state") != prev)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), shift(laid, "close", -h).alias("later")) for h in horizons])
    laid = laid.add({"_in": entered, "_h": ahead})
    return laid.core().filter("_in").select(*keys, "ts", "state", "close", F.explode("_h").alias("_e")).select(
        *keys, "ts", "state", "close", "_e.horizon", "_e.later"
    )


def hit_rates(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Events, hits, excluded entries, rate and interval per key and horizon."""
    known = F.col("later").isNotNull()
    hit = F.when(F.col("state") == "buy", F.col("later") > F.col("close")).otherwise(F.col("later") < F.col("close"))
    sums = events.groupBy(*keys, "horizon").agg(
        F.count_if(known).alias("events"), F.count_if(known & hit).alias("hits"), F.count_if(~known).alias("excluded")
    )
    rate = F.try_divide(F.col("hits") * 100.0, F.col("events"))
    rows = sums.withColumn("rate_pct", rate)
    low, high = wald_bounds(F.col("rate_pct"), F.col("events"))
    return rows.withColumns({"wald_low": low, "wald_high": high})


def pooled_hit_rates(events: DataFrame, window: str = "window_id", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Hit rates per window and, with a null window, over all windows, from one rollup."""
    known = F.col("later").isNotNull()
    hit = F.when(F.col("state") == "buy", F.col("later") > F.col("close")).otherwise(F.col("later") < F.col("close"))
    sums = events.groupingSets(
        [[F.col(k) for k in (*keys, "horizon", window)], [F.col(k) for k in (*keys, "horizon")]], *keys, "horizon", window
    ).agg(F.count_if(known).alias("events"), F.count_if(known & hit).alias("hits"), F.count_if(~known).alias("excluded"))
    rows = sums.withColumn("rate_pct", F.try_divide(F.col("hits") * 100.0, F.col("events")))
    low, high = wald_bounds(F.col("rate_pct"), F.col("events"))
    return rows.withColumns({"wald_low": low, "wald_high": high})


# -- walk-forward and experiments -------------------------------------------------------------------------------


def walk_forward(
    results: DataFrame, metric: str = "roi", min_trades: int = 10, keys: Sequence[str] = ("symbol",), window: str = "window_id"
) -> DataFrame:
    """Per window the set with the best metric, then most trades, scored on the next window.

    ``results``: one row per key, window and set. Windows without an eligible set have status ``THIN_IS``.
    """
    keys = list(keys)
    last = results.groupBy(*keys).agg(F.max(window).alias("_last"))
    eligible = F.coalesce(F.col("total_trades") >= min_trades, F.lit(False))
    value = F.struct(F.col(metric), F.col("total_trades"), -F.col("param_id"))
    picked = results.groupBy(*keys, window).agg(
        F.max_by("param_id", F.when(eligible, value)).alias("param_id"),
        F.max_by(metric, F.when(eligible, value)).alias(f"is_{metric}"),
    )
    folds = picked.join(last, keys).filter(F.col(window) < F.col("_last")).drop("_last")
    nxt = results.select(
        *keys, (F.col(window) - 1).alias(window), "param_id", F.col(metric).alias(f"oos_{metric}"), F.col("total_trades").alias("oos_trades")
    )
    rows = folds.join(nxt, [*keys, window, "param_id"], "left")
    return rows.withColumn("status", F.when(F.col("param_id").isNull(), "THIN_IS").otherwise("OK")).withColumnRenamed(window, "fold")


def experiment_id(spec: dict) -> str:
    """First 16 digits of the SHA-256 of the settings as sorted compact JSON."""
    text = json.dumps(spec, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def experiment_results(
    trades: DataFrame, seconds: float, spec: dict, initial_balance: float, min_trades: int = 1, max_drawdown_percent: float = 20.0,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Train and test metrics of one experiment (``split`` column), the gate and the score."""
    by = [*keys, "split"]
    sums = trade_metrics(trades, by, initial_balance)
    curve = balance_curve(trades, seconds, initial_balance, by)
    falls = max_drawdown(curve, seconds, "balance", by, ts="exit_ts", initial=initial_balance)
    rows = sums.join(falls.select(*by, "max_drawdown", "max_drawdown_percent"), by)
    pick = lambda part, c: F.max(F.when(F.col("split") == part, F.col(c))).alias(f"{part}_{c}")
    wide = rows.groupBy(*keys).agg(
        *[pick(part, c) for part in ("train", "test") for c in ("trades", "net_profit", "max_drawdown", "max_drawdown_percent")]
    )
    passed = (
        (F.col("test_trades") >= min_trades) & (F.col("test_max_drawdown_percent") <= max_drawdown_percent) & (F.col("test_net_profit") > 0)
    )
    return wide.withColumns(
        {
            "experiment_id": F.lit(experiment_id(spec)),
            "passed": F.coalesce(passed, F.lit(False)),
            "score": F.col("test_net_profit") - F.col("test_max_drawdown") * 0.5,
        }
    )


def best_experiment(results: DataFrame) -> DataFrame:
    return results.filter("passed").orderBy(F.desc("score"), "experiment_id").limit(1)


def equivalence(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of two metric tables that are missing on one side or differ."""
    right = b.select(*keys, *[F.col(v).alias(f"other_{v}") for v in values], F.lit(True).alias("_b"))
    both = a.select(*keys, *values, F.lit(True).alias("_a")).join(right, list(keys), "full")
    same = F.lit(True)
    for v in values:
        x, y = F.col(v), F.col(f"other_{v}")
        close = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y)), F.lit(False))
        same = same & close
    return both.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~same).drop("_a", "_b")


def compare_strategies(runs: dict[str, DataFrame], bars: DataFrame, seconds: float, initial_balance: float) -> DataFrame:
    """One row per strategy and symbol: bars, closed trades, net profit, profit factor, drawdown."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("candles"))
    parts = []
    for label, trades in runs.items():
        falls = max_drawdown(balance_curve(trades, seconds, initial_balance), seconds, "balance", ts="exit_ts", initial=initial_balance)
        rows = trade_metrics(trades).join(falls, "symbol").join(counts, "symbol")
        parts.append(
            rows.select(F.lit(label).alias("strategy"), "symbol", "candles", F.col("trades").alias("closed"), "net_profit", "profit_factor", "max_drawdown")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

