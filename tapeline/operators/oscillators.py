"""Oscillators, bands and channels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.layout import POS, Laid, with_positions
from tapeline.operators.moving_averages import ema, rma, seeded_ema, sma, span_decay
from tapeline.operators.scans import ewm_columns, fade_rows, rolling, shift
from tapeline.operators.steps import Step, dropping, together


def true_range(out: str = "tr", first_row: bool = True) -> Step:
    """Largest of the bar range and the distances to the previous close; the first row may be left null."""

    def apply(laid: Laid) -> Laid:
        h, lo, prev = F.col("high"), F.col("low"), shift(laid, "close")
        value = F.greatest(h - lo, F.abs(h - prev), F.abs(lo - prev))
        return laid.add({out: value if first_row else F.when(prev.isNotNull(), value)})

    return Step(apply, 1)


def atr(n: int = 14, out: str = "atr") -> Step:
    """Wilder mean of the true range from the second bar on, shown after ``n`` ranges."""
    return dropping(true_range("_tr", first_row=False) >> rma(n, "_tr", out, warmup=True), "_tr")


def atr_rma(n: int, out: str = "atr") -> Step:
    """Wilder mean of the true range from the first bar on."""
    return dropping(true_range("_tr") >> rma(n, "_tr", out), "_tr")


def _gains(x: str, blank_first: bool) -> Step:
    def apply(laid: Laid) -> Laid:
        change = F.col(x) - shift(laid, x)
        known = change if blank_first else F.coalesce(change, F.lit(0.0))
        return laid.add(
            {
                "_gain": F.when(known.isNotNull(), F.greatest(known, F.lit(0.0))),
                "_loss": F.when(known.isNotNull(), F.greatest(-known, F.lit(0.0))),
            }
        )

    return Step(apply, 1)


def rsi(n: int = 14, x: str = "close", out: str = "rsi") -> Step:
    """Wilder RSI whose first change counts as zero; null for the first ``n - 1`` rows."""
    q = (n - 1.0) / n

    def strength(laid: Laid) -> Laid:
        laid = ewm_columns(laid, {"_up": (F.col("_gain"), q), "_down": (F.col("_loss"), q)})
        up, down = F.col("_up"), F.col("_down")
        value = F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
        return laid.add({out: F.when(F.count(x).over(laid.prefix()) >= n, value)})

    return dropping(_gains(x, False) >> Step(strength, fade_rows(q) + n), "_gain", "_loss", "_up", "_down")


def sma_rsi(n: int = 14, window: int = 14, out: str = "sma_rsi") -> Step:
    return dropping(rsi(n, out="_rsi") >> sma(window, "_rsi", out), "_rsi")


def rsi_reversal(n: int = 14, low: float = 30.0, high: float = 70.0, x: str = "close") -> Step:
    """RSI from the first change on (unknown is 50) and the signal when it leaves an extreme zone."""
    q = (n - 1.0) / n

    def strength(laid: Laid) -> Laid:
        laid = ewm_columns(laid, {"_up": (F.col("_gain"), q), "_down": (F.col("_loss"), q)})
        value = 100 - 100 / (1 + F.try_divide(F.col("_up"), F.col("_down")))
        return laid.add({"rsi": F.coalesce(value, F.lit(50.0))})

    def signal(laid: Laid) -> Laid:
        now, prev = F.col("rsi"), shift(laid, "rsi")
        turn = F.when((prev <= low) & (now > low), "buy").when((prev >= high) & (now < high), "sell").otherwise("hold")
        return laid.add({"rsi_signal": turn, "rsi_direction": F.when(now >= 50, "long").otherwise("short")})

    chain = _gains(x, True) >> Step(strength, fade_rows(q)) >> Step(signal, 1)
    return dropping(chain, "_gain", "_loss", "_up", "_down")


def stoch_rsi(rsi_n: int = 14, stoch_n: int = 14, k: int = 3, d: int = 3, x: str = "close") -> Step:
    def stochastic(laid: Laid) -> Laid:
        low, high = rolling(laid, F.min, "_rsi", stoch_n), rolling(laid, F.max, "_rsi", stoch_n)
        laid = laid.add({"_lo": low, "_hi": high})
        return laid.add({"_stoch": F.try_divide((F.col("_rsi") - F.col("_lo")) * 100, F.col("_hi") - F.col("_lo"))})

    chain = rsi(rsi_n, x, "_rsi") >> Step(stochastic, stoch_n) >> sma(k, "_stoch", "stoch_k") >> sma(d, "stoch_k", "stoch_d")
    return dropping(chain, "_rsi", "_lo", "_hi", "_stoch")


def macd(fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> Step:
    """Line, signal and histogram; every mean starts with a plain mean of its first rows."""
    lines = together(seeded_ema(fast, x, "_fast"), seeded_ema(slow, x, "_slow"))
    line = Step(lambda laid: laid.add({"macd": F.col("_fast") - F.col("_slow")}))
    last = Step(lambda laid: laid.add({"macd_hist": F.col("macd") - F.col("macd_signal")}))
    return dropping(lines >> line >> seeded_ema(signal, "macd", "macd_signal") >> last, "_fast", "_slow")


def macd_cross(fast: int = 12, slow: int = 26, signal: int = 9, x: str = "close") -> Step:
    """Variant from the first bar on; signal when the line crosses its mean."""
    lines = together(ema(fast, x, "_fast"), ema(slow, x, "_slow"))
    line = Step(lambda laid: laid.add({"macd": F.col("_fast") - F.col("_slow")}))

    def cross(laid: Laid) -> Laid:
        now, mean = F.col("macd"), F.col("macd_signal")
        was, was_mean = shift(laid, "macd"), shift(laid, "macd_signal")
        turn = (
            F.when((was <= was_mean) & (was_mean < now), "buy")
            .when((was >= was_mean) & (was_mean > now), "sell")
            .otherwise("hold")
        )
        return laid.add({"macd_cross": turn, "macd_direction": F.when(now >= 0, "long").otherwise("short")})

    return dropping(lines >> line >> ema(signal, "macd", "macd_signal") >> Step(cross, 1), "_fast", "_slow")


def mfi(n: int = 14, out: str = "mfi") -> Step:
    def apply(laid: Laid) -> Laid:
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3
        laid = laid.add({"_tp": typical})
        change = F.col("_tp") - shift(laid, "_tp")
        flow = F.col("_tp") * F.col("volume")
        laid = laid.add(
            {
                "_in": F.when(change > 0, flow).when(change.isNotNull(), F.lit(0.0)),
                "_out": F.when(change < 0, flow).when(change.isNotNull(), F.lit(0.0)),
            }
        )
        gained, lost = rolling(laid, F.sum, "_in", n), rolling(laid, F.sum, "_out", n)
        return laid.add({out: F.try_divide(gained * 100, gained + lost)}).drop("_tp", "_in", "_out")

    return Step(apply, n + 1)


def cci(n: int = 20, out: str = "cci") -> Step:
    """Distance from the mean in units of the mean absolute deviation around the current mean."""

    def apply(laid: Laid) -> Laid:
        laid = laid.add({"_tp": (F.col("high") + F.col("low") + F.col("close")) / 3})
        frame = laid.frame(-(n - 1), 0)
        laid = laid.add({"_mean": rolling(laid, F.avg, "_tp", n), "_near": F.collect_list("_tp").over(frame)})
        spread = F.aggregate("_near", F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col("_mean"))) / n
        value = F.try_divide(F.col("_tp") - F.col("_mean"), spread * 0.015)
        return laid.add({out: value}).drop("_tp", "_mean", "_near")

    return Step(apply, n - 1)


def adx(di: int = 14, smoothing: int = 14) -> Step:
    """Directional movement: ``plus_di``, ``minus_di`` and ``adx``."""
    q, q2 = (di - 1.0) / di, (smoothing - 1.0) / smoothing

    def moves(laid: Laid) -> Laid:
        up = F.col("high") - shift(laid, "high")
        down = shift(laid, "low") - F.col("low")
        laid = laid.add({"_u": up, "_d": down})
        u, d = F.col("_u"), F.col("_d")
        return laid.add(
            {
                "_pdm": F.when((u > d) & (u > 0), u).otherwise(F.lit(0.0)),
                "_mdm": F.when((d > u) & (d > 0), d).otherwise(F.lit(0.0)),
            }
        )

    def index(laid: Laid) -> Laid:
        laid = ewm_columns(
            laid, {"_str": (F.col("_tr"), q), "_spdm": (F.col("_pdm"), q), "_smdm": (F.col("_mdm"), q)}
        )
        laid = laid.add(
            {
                "plus_di": F.try_divide(F.col("_spdm") * 100, F.col("_str")),
                "minus_di": F.try_divide(F.col("_smdm") * 100, F.col("_str")),
            }
        )
        plus, minus = F.col("plus_di"), F.col("minus_di")
        return laid.add({"_dx": F.try_divide(F.abs(plus - minus) * 100, plus + minus)})

    last = Step(lambda laid: ewm_columns(laid, {"adx": (F.col("_dx"), q2)}), fade_rows(q2))
    chain = true_range("_tr") >> Step(moves, 1) >> Step(index, fade_rows(q)) >> last
    return dropping(chain, "_tr", "_u", "_d", "_pdm", "_mdm", "_str", "_spdm", "_smdm", "_dx")


def bollinger(n: int = 20, k: float = 2.0, x: str = "low") -> Step:
    def apply(laid: Laid) -> Laid:
        mean, dev = rolling(laid, F.avg, x, n), rolling(laid, F.stddev_samp, x, n)
        laid = laid.add({"bb_mid": mean, "_dev": dev})
        return laid.add(
            {"bb_upper": F.col("bb_mid") + F.col("_dev") * k, "bb_lower": F.col("bb_mid") - F.col("_dev") * k}
        ).drop("_dev")

    return Step(apply, n - 1)


def donchian(n: int = 20) -> Step:
    """Channel of the ``n`` bars before the current one."""

    def apply(laid: Laid) -> Laid:
        laid = laid.add({"dc_upper": rolling(laid, F.max, "high", n, -1), "dc_lower": rolling(laid, F.min, "low", n, -1)})
        return laid.add({"dc_mid": (F.col("dc_upper") + F.col("dc_lower")) / 2})

    return Step(apply, n)


def keltner(n: int = 20, atr_n: int = 10, mult: float = 2.0) -> Step:
    """EMA channel of width ``mult`` mean true ranges, moved one bar later."""

    def channel(laid: Laid) -> Laid:
        width = rolling(laid, F.avg, "_tr", atr_n) * mult
        laid = laid.add({"_width": width})
        return laid.add(
            {
                "kc_mid": shift(laid, "_ema"),
                "kc_upper": shift(laid, F.col("_ema") + F.col("_width")),
                "kc_lower": shift(laid, F.col("_ema") - F.col("_width")),
            }
        )

    chain = together(true_range("_tr"), ema(n, "close", "_ema")) >> Step(channel, atr_n + 1)
    return dropping(chain, "_tr", "_ema", "_width")


def ichimoku(conversion: int = 9, base: int = 26, lagging: int = 26, leading_b: int = 52) -> Step:
    """Cloud lines without forward displacement. The lagging line is the later close, so the step is not causal."""

    def middle(laid: Laid, n: int) -> Column:
        return (rolling(laid, F.max, "high", n) + rolling(laid, F.min, "low", n)) / 2

    def apply(laid: Laid) -> Laid:
        laid = laid.add(
            {
                "conversion_line": middle(laid, conversion),
                "base_line": middle(laid, base),
                "leading_b": middle(laid, leading_b),
                "lagging_span": shift(laid, "close", -lagging),
            }
        )
        laid = laid.add({"leading_a": (F.col("conversion_line") + F.col("base_line")) / 2})
        a, b = F.col("leading_a"), F.col("leading_b")
        known = a.isNotNull() & b.isNotNull()
        zero = F.lit(0.0)
        return laid.add(
            {
                "upper_kumo": F.when(known, F.greatest(a, b)),
                "lower_kumo": F.when(known, F.least(a, b)),
                "cloud": F.when(F.coalesce(a, zero) > F.coalesce(b, zero), "green").otherwise("red"),
            }
        )

    return Step(apply, leading_b, lagging, causal=False)


def nadaraya_watson(
    bars: DataFrame, seconds: float, h: float = 8.0, mult: float = 3.0, x: str = "close", last: int = 500
) -> DataFrame:
    """Gaussian kernel mean over the newest ``last`` bars on both sides, with an error band and band crossings.

    The kernel is below double precision beyond ``9 h`` bars, so a band of neighbours holds every term that counts.
    Works on ``last`` rows per symbol; it repaints and must not feed a model.
    """
    reach = min(last, math.ceil(9 * h))
    placed = with_positions(bars, seconds)
    recent = placed.filter(F.col(POS) >= F.col("_total") - last)
    recent = recent.select("symbol", "ts", F.col(POS).alias("_p"), F.col(x).alias("_x"))
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("_k")
    weighed = recent.select("symbol", "_p", "_x", offsets).select(
        "symbol",
        (F.col("_p") + F.col("_k")).alias("_p"),
        F.exp(-F.pow(F.col("_k").cast("double"), F.lit(2.0)) / (2 * h * h)).alias("_w"),
        F.col("_x").alias("_n"),
    )
    centre = weighed.groupBy("symbol", "_p").agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_w")).alias("center"))
    lines = recent.join(centre, ["symbol", "_p"])
    error = lines.groupBy("symbol").agg((F.avg(F.abs(F.col("_x") - F.col("center"))) * mult).alias("_band"))
    lines = lines.join(error, "symbol").select(
        "symbol",
        "ts",
        "_p",
        "_x",
        "center",
        (F.col("center") + F.col("_band")).alias("upper"),
        (F.col("center") - F.col("_band")).alias("lower"),
    )
    before = lines.select(
        "symbol",
        (F.col("_p") + 1).alias("_p"),
        F.col("_x").alias("_px"),
        F.col("upper").alias("_pu"),
        F.col("lower").alias("_pl"),
    )
    joined = lines.join(before, ["symbol", "_p"], "left")
    up = (F.col("_px") < F.col("_pl")) & (F.col("_x") > F.col("lower"))
    down = (F.col("_px") > F.col("_pu")) & (F.col("_x") < F.col("upper"))
    return joined.select(
        "symbol",
        "ts",
        "center",
        "upper",
        "lower",
        F.coalesce(up, F.lit(False)).alias("cross_up"),
        F.coalesce(down, F.lit(False)).alias("cross_down"),
    )


# Retracement levels.
FIBONACCI_LEVELS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)


def fibonacci(high: Column, low: Column, trend: str = "up") -> Column:
    """Map from level in thousandths to price, rounded to cents."""
    span = F.abs(high - low)
    entries = []
    for level in FIBONACCI_LEVELS:
        price = high - span * level if trend == "up" else low + span * level
        entries += [F.lit(str(round(level * 1000))), F.floor(price * 100 + 0.5) / 100]
    return F.create_map(*entries)


def range_ladder(bars: DataFrame, seconds: float, timeframe: str | int, steps: int = 50) -> DataFrame:
    """Eighths of the previous larger bar, laddered from the running extreme of the current one.

    For every bar: the nearest rung above and below its close, or null beyond ``steps`` rungs. Upward ladders start
    at the low of a rising larger bar, downward ones at the high of a falling one.
    """
    from tapeline.operators.bars import floor_time, resample
    from tapeline.schema import tf_seconds

    larger = with_positions(resample(bars, timeframe), tf_seconds(timeframe)).drop("_total")
    prev = larger.select(
        "symbol", (F.col(POS) + 1).alias(POS), ((F.col("high") - F.col("low")) / 8).alias("leg")
    )
    current = larger.join(prev, ["symbol", POS]).select(
        "symbol",
        F.col("ts").alias("_start"),
        "leg",
        F.when(F.col("open") > F.col("close"), F.col("high")).otherwise(F.col("low")).alias("base"),
        F.when(F.col("open") > F.col("close"), F.lit(-1)).otherwise(F.lit(1)).alias("side"),
    )
    keyed = bars.withColumn("_start", floor_time("ts", timeframe)).join(current, ["symbol", "_start"])
    # the rungs themselves are compared: a quotient of distance and leg is off by one where a close lies on a rung
    signed = F.col("leg") * F.col("side")
    rungs = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.col("base") + signed * k)
    laddered = keyed.withColumn("_rungs", rungs)
    above = F.array_min(F.filter("_rungs", lambda r: r > F.col("close")))
    below = F.array_max(F.filter("_rungs", lambda r: r < F.col("close")))
    return laddered.select("symbol", "ts", "close", above.alias("above"), below.alias("below"))
