"""Strategies: columns of indicators to rows ``symbol, ts, side, entry, sl, tp, strategy``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators import moving_averages as ma
from tapeline.operators import oscillators as osc
from tapeline.operators import structure, trend
from tapeline.operators.asof import asof_join
from tapeline.operators.layout import POS, Laid, epoch_seconds
from tapeline.operators.scans import shift
from tapeline.operators.steps import Step, dropping, run, together


def flip_signals(rows: DataFrame, strategy: str, buy: Column, sell: Column, line: Column, rr: float) -> DataFrame:
    """Entries at the close with the stop at a line and the target ``rr`` times as far."""
    side = F.when(buy, "buy").when(sell, "sell")
    chosen = rows.withColumn("side", side).filter("side IS NOT NULL")
    entry = F.col("close")
    return chosen.select(
        "symbol", "ts", "side", entry.alias("entry"), line.alias("sl"), (entry + (entry - line) * rr).alias("tp"), F.lit(strategy).alias("strategy")
    )


def _filters() -> dict[str, tuple[Step | None, Callable[[], Column], Callable[[], Column]]]:
    """Name of a filter to the step it needs and its buy and sell conditions."""
    up = lambda: F.col("st_signal") == "buy"
    down = lambda: F.col("st_signal") == "sell"
    long = lambda: F.col("st_position") == "long"
    short = lambda: F.col("st_position") == "short"
    hist = Step(lambda laid: laid.add({"_ph": shift(laid, "macd_hist")}), 1)
    return {
        "supertrend": (None, up, down),
        "adx": (osc.adx(), lambda: up() & (F.col("adx") > 25), lambda: down() & (F.col("adx") > 25)),
        "ichimoku": (
            osc.ichimoku(),
            lambda: up() & (F.col("close") > F.col("upper_kumo")),
            lambda: down() & (F.col("close") < F.col("lower_kumo")),
        ),
        "sar": (trend.sar(), lambda: long() & (F.col("sar_signal") == "buy"), lambda: short() & (F.col("sar_signal") == "sell")),
        "macd": (
            osc.macd() >> hist,
            lambda: long() & (F.col("macd_hist") > 0) & (F.col("_ph") < 0),
            lambda: short() & (F.col("macd_hist") < 0) & (F.col("_ph") > 0),
        ),
        "keltner": (
            osc.keltner(),
            lambda: up() & (F.col("close") > F.col("kc_upper")),
            lambda: down() & (F.col("close") < F.col("kc_lower")),
        ),
        "trend_magic": (
            trend.trend_magic(),
            lambda: up() & (F.col("magic_signal") == "long"),
            lambda: down() & (F.col("magic_signal") == "short"),
        ),
        "vidya": (
            trend.volumatic_vidya(),
            lambda: up() & (F.col("vidya_trend") == "long"),
            lambda: down() & (F.col("vidya_trend") == "short"),
        ),
        "hull": (
            trend.hull_trend(),
            lambda: up() & (F.col("hull_trend") == "long"),
            lambda: down() & (F.col("hull_trend") == "short"),
        ),
    }


STRATEGIES = ("supertrend", "adx", "ichimoku", "sar", "macd", "keltner", "trend_magic", "vidya", "hull")


def strategy_signals(
    bars: DataFrame, seconds: float, name: str, rr: float = 2.0, filter_step: Step | None = None
) -> DataFrame:
    """Signals of a named strategy: a Supertrend flip or side, joined with a filter; the stop is the Supertrend line.

    ``filter_step`` replaces the filter's own step, to use other parameters.
    """
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    step, buy, sell = _filters()[name]
    base = run(bars, seconds, trend.supertrend())
    line = F.col("st_value")
    step = filter_step or step
    if step is None:
        return flip_signals(base, name, buy(), sell(), line, rr)
    extra = run(bars, seconds, step)
    new = [c for c in extra.columns if c not in bars.columns]
    joined = base.join(extra.select("symbol", "ts", *new), ["symbol", "ts"])
    return flip_signals(joined, name, buy(), sell(), line, rr)


def voting_columns(step: Step | None = None) -> Step:
    """The four voting indicators: adaptive Supertrend, HalfTrend, RSI reversal, MACD cross."""
    return step or (together(osc.rsi_reversal(), osc.macd_cross(), trend.half_trend_voting()) >> trend.supertrend_voting())


def voting_signals(
    bars: DataFrame, seconds: float, min_votes: int, rr: float = 2.0, entry_lag: int = 1, strategy: str = "voting"
) -> DataFrame:
    """Signals with at least ``min_votes`` equal votes; the stop is the lower (upper) price line.

    The entry is the open ``entry_lag`` bars after the signal bar; 0 takes the open of the signal bar itself, which
    was not known at that time. Signals whose stop lies beyond the entry are dropped.
    """
    voted = run(bars, seconds, voting_columns())
    votes = F.array("stv_signal", "htv_signal", "rsi_signal", "macd_cross")
    count = lambda side: F.size(F.filter(votes, lambda v: v == side))
    side = F.when(count("buy") >= min_votes, "buy").when(count("sell") >= min_votes, "sell")
    opened = run(
        voted.withColumn("side", side),
        seconds,
        Step(lambda laid: laid.add({"entry": shift(laid, "open", -entry_lag), "entry_ts": shift(laid, "ts", -entry_lag)}), 0, entry_lag),
    )
    stop = F.when(F.col("side") == "buy", F.least("stv_line", "htv_line")).otherwise(F.greatest("stv_line", "htv_line"))
    rows = opened.filter("side IS NOT NULL AND entry IS NOT NULL").withColumn("sl", stop)
    rows = rows.filter(F.when(F.col("side") == "buy", F.col("sl") < F.col("entry")).otherwise(F.col("sl") > F.col("entry")))
    target = F.col("entry") + (F.col("entry") - F.col("sl")) * rr
    trade_id = F.concat_ws(":", F.lit(strategy), "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "side")
    return rows.select("symbol", "ts", "side", "entry_ts", "entry", "sl", target.alias("tp"), F.lit(strategy).alias("strategy"), trade_id.alias("trade_id"))


def confirmed_signal(trigger: Column, confirmation: Column) -> Column:
    """1 or -1 where both columns say buy or both say sell, else 0."""
    both = F.coalesce(trigger == confirmation, F.lit(False))
    return F.when(both & (trigger == "buy"), 1).when(both & (trigger == "sell"), -1).otherwise(0)


def _named(state: str, long: str = "long") -> Callable[[], Column]:
    return lambda: F.when(F.col(state) == long, "buy").when(F.col(state).isNotNull(), "sell")


def _turns(out: str) -> Step:
    """Change signal of the column ``<out>_side`` as ``<out>``."""

    def apply(laid: Laid) -> Laid:
        now, prev = F.col("trend"), shift(laid, "trend")
        turn = F.when(prev.isNull() | now.isNull(), None).when((now == "buy") & (prev != "buy"), "buy")
        turn = turn.when((now == "sell") & (prev != "sell"), "sell").otherwise("hold")
        return laid.add({out: turn})

    return Step(apply, 1)


def indicator(name: str, params: dict) -> Step:
    """Step of a named indicator with its parameters; adds ``trend`` (buy, sell) and ``signal`` (turns of it).

    The names are those the sweeps use. Parameter pairs that make no sense raise ``ValueError``.
    """
    p = dict(params)
    if name == "ema":
        step, side = ma.ema(p.get("window", 20), out="_line", adjust=True), lambda: _against("_line")
    elif name == "sma":
        step, side = ma.sma(p.get("window", 20), out="_line"), lambda: _against("_line")
    elif name == "ema_cross":
        fast, slow = p.get("fast_period", 20), p.get("slow_period", 50)
        if fast >= slow:
            raise ValueError("fast_period must be below slow_period")
        step, side = dropping(trend.ema_cross(fast, slow), "ema_signal", "ema_fast", "ema_slow"), lambda: F.col("ema_state")
    elif name == "macd":
        fast, slow = p.get("fast", 12), p.get("slow", 26)
        if fast >= slow:
            raise ValueError("fast must be below slow")
        step, side = osc.macd(fast, slow, p.get("signal", 9)), lambda: _over("macd_hist")
    elif name in ("supertrend", "super_trend"):
        step, side = trend.supertrend(p.get("atr_period", 10), p.get("multiplier", 3.0)), _named("st_position")
    elif name == "ut_bot":
        step = trend.ut_bot(p.get("key_value", 3), p.get("atr_period", 10))
        side = lambda: F.when(F.col("ut_state") == "long", "buy").when(F.col("ut_state") == "short", "sell")
    elif name == "kalman_trend":
        short, long = p.get("sell_len", 50), p.get("buy_len", 150)
        if short >= long:
            raise ValueError("sell_len must be below buy_len")
        step, side = trend.kalman_trend(short, long), _named("kalman_trend")
    elif name == "trend_ali":
        step, side = trend.hull_trend(p.get("length", 60), p.get("length_mult", 6.0), p.get("mode", "Hma")), _named("hull_trend")
    elif name == "half_trend":
        step, side = trend.half_trend(p.get("amplitude", 2), p.get("channel_deviation", 2)), _named("ht_position")
    elif name == "volumatic_vidya":
        step = trend.volumatic_vidya(p.get("vidya_length", 10), p.get("vidya_momentum", 20), p.get("band_distance", 2.0))
        side = _named("vidya_trend")
    elif name == "deviation_trend":
        step, side = trend.deviation_trend(p.get("sma_length", 50)), _named("deviation_trend")
    elif name in ("stochrsi", "stoch_rsi"):
        step = osc.stoch_rsi(p.get("rsi_length", 14), p.get("stoch_length", 14), p.get("k_period", 3), p.get("d_period", 3))
        side = lambda: F.when(F.col("stoch_k") > F.col("stoch_d"), "buy").when(F.col("stoch_k") <= F.col("stoch_d"), "sell")
    elif name == "sar":
        step = trend.sar(p.get("start", 0.02), p.get("increment", 0.02), p.get("maximum", 0.2))
        side = lambda: _over("sar_trend")
    else:
        raise ValueError(f"unknown indicator {name!r}")
    named = Step(lambda laid: laid.add({"trend": side()}))
    return step >> named >> _turns("signal")


def _against(line: str) -> Column:
    return F.when(F.col("close") > F.col(line), "buy").when(F.col("close") < F.col(line), "sell")


def _over(value: str) -> Column:
    return F.when(F.col(value) > 0, "buy").when(F.col(value) <= 0, "sell")


def indicator_signals(bars: DataFrame, seconds: float, name: str, params: dict) -> DataFrame:
    """``symbol, ts, trend, signal`` of one named indicator."""
    return run(bars, seconds, indicator(name, params)).select("symbol", "ts", "trend", "signal")


def price_ladder(rows: DataFrame, middle: Column, step: Column, levels: int) -> DataFrame:
    """``levels`` prices above and below a middle: columns ``level``, ``side``, ``level_price``."""
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    spread = rows.select("*", middle.alias("_mid"), step.alias("_step"), level)
    sides = F.explode(F.array(F.struct(F.lit("buy").alias("side"), F.lit(1).alias("sign")), F.struct(F.lit("sell").alias("side"), F.lit(-1).alias("sign"))))
    out = spread.withColumn("_s", sides)
    return out.select(
        *rows.columns, "level", "_s.side", (F.col("_mid") + F.col("_s.sign") * F.col("level") * F.col("_step")).alias("level_price")
    )


def flag_news(signals: DataFrame, news: DataFrame) -> DataFrame:
    """Flags for signals near news: within half an hour, within an hour ahead, holiday within twelve hours.

    ``news``: ts, event. Only the nearest news before and after a time can matter, so distinct signal times meet the news in
    as-of joins, forwards and with time reversed, and no signal meets more than one row of each.
    """
    at = epoch_seconds("ts")
    told = news.select(at.alias("_at"), F.lower("event").contains("holiday").alias("_holiday"))
    times = signals.select("ts", at.alias("_at")).distinct()

    def nearest(rows: DataFrame, right: DataFrame, name: str, ahead: bool, strict: bool = False) -> DataFrame:
        """Seconds of the newest ``right`` at or before each time, or with ``ahead`` of the first at or after it."""
        clock = lambda c: F.timestamp_seconds(-F.col(c) if ahead else F.col(c)).cast("timestamp_ntz")
        found = right.select(clock("_at").alias("_clock"), F.col("_at").alias(name)).distinct()
        return asof_join(rows.withColumn("_clock", clock("_at")), found, [name], seconds=1, keys=(), ts="_clock", strict=strict).drop("_clock")

    holidays = told.filter("_holiday")
    rows = nearest(nearest(times, told, "_next", True), told, "_later", True, strict=True)
    rows = nearest(nearest(rows, holidays, "_feast", True), holidays, "_past", False)
    within = lambda gap, most: F.coalesce(gap <= most, F.lit(False))
    flags = rows.select(
        "ts",
        F.coalesce(F.col("_next") - F.col("_at") < 1800, F.lit(False)).alias("during_news"),
        within(F.col("_later") - F.col("_at"), 3600).alias("upcoming_news"),
        (within(F.col("_feast") - F.col("_at"), 43200) | within(F.col("_at") - F.col("_past"), 43200)).alias("holiday"),
    ).distinct()
    out = signals.join(flags, "ts", "left").fillna({"during_news": False, "upcoming_news": False, "holiday": False})
    return out.withColumn("avoid", F.col("during_news") | F.col("upcoming_news") | F.col("holiday"))


def abcd_signals(
    bars: DataFrame, seconds: float, htf_trend: DataFrame, htf_seconds: float, losses: Column, minutes: int,
    use_rsi: bool = False, use_macd: bool = False, depth: int = 12, min_stop: float = 0.0, strategy: str = "abcd",
    **zigzag_args,
) -> DataFrame:
    """Limit entries at point D of scored AB=CD patterns: stop 1.5 ATR away, target at C, one signal per side and C.

    ``htf_trend``: symbol, ts, htf_trend of a larger frame. Indicators are those of the bar that confirms C.
    """
    swings = structure.confirmed(structure.zigzag(bars, seconds, depth, **zigzag_args), depth)
    patterns = structure.abcd_patterns(swings, seconds)
    context = together(osc.atr(14), osc.adx(), osc.rsi(14), osc.macd())

    def recent(laid: Laid) -> Laid:
        frame = laid.frame(-19, 0)
        return laid.add(
            {
                "atr_mean": F.avg("atr").over(frame), "atr_prev": shift(laid, "atr"), "rsi_prev": shift(laid, "rsi"),
                "hist_prev": shift(laid, "macd_hist"), "hist_prev2": shift(laid, "macd_hist", 2),
            }
        )

    rows = run(bars, seconds, context >> Step(recent, 20), keep=[POS])
    rows = asof_join(rows, htf_trend, ["htf_trend"], seconds=htf_seconds)
    rows = rows.filter(F.col("adx") >= 20).select(
        "symbol", F.col(POS).alias("c_pos"), "htf_trend", F.col("atr_prev").alias("atr"), "atr_mean", F.col("rsi_prev").alias("rsi"),
        F.col("hist_prev").alias("macd_hist"), F.col("hist_prev2").alias("macd_prev"),
    )
    zones = structure.zone_lives(bars, seconds)
    scored = structure.pattern_score(patterns, rows, zones, use_rsi, use_macd, minutes)
    kept = scored.filter(F.col("score") >= structure.min_score(losses))
    sign = F.when(F.col("type") == "bullish", 1).otherwise(-1)
    gap = F.greatest(F.col("atr") * 1.5, F.lit(min_stop))
    return kept.select(
        "symbol", F.col("c_ts").alias("ts"), F.when(sign > 0, "buy").otherwise("sell").alias("side"), F.col("d_price").alias("entry"),
        (F.col("d_price") - gap * sign).alias("sl"), F.col("c_price").alias("tp"), "score", F.lit(strategy).alias("strategy"),
    ).dropDuplicates(["symbol", "side", "ts"])
