"""Moving averages over any column of a chunked series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tapeline.operators.fold import fold_step
from tapeline.operators.layout import CHUNK, CORE, POS, Laid, spread
from tapeline.operators.scans import affine_sum, decayed_sum, ewm_adjusted, ewm_columns, fade_rows, rolling, shift
from tapeline.operators.steps import Step, dropping
from tapeline.session import materialize

LONGEST_FADE = 700.0  # a weight of one forgets everything; exp(-700) is still a double


def span_decay(n: float) -> float:
    return 1.0 - 2.0 / (n + 1.0)


def sma(n: int, x: str = "close", out: str = "sma") -> Step:
    return Step(lambda laid: laid.add({out: rolling(laid, F.avg, x, n)}), n - 1)


def ema(n: int, x: str = "close", out: str = "ema", adjust: bool = False) -> Step:
    q = span_decay(n)

    def apply(laid: Laid) -> Laid:
        if adjust:
            return laid.add({out: ewm_adjusted(laid, F.col(x), q)})
        return ewm_columns(laid, {out: (F.col(x), q)})

    return Step(apply, fade_rows(q))


def rma(n: int, x: str = "close", out: str = "rma", warmup: bool = False) -> Step:
    """Wilder mean started by the first value; ``warmup`` hides the first ``n - 1`` known rows."""
    q = (n - 1.0) / n

    def apply(laid: Laid) -> Laid:
        laid = ewm_columns(laid, {out: (F.col(x), q)})
        if warmup:
            laid = laid.add({out: F.when(F.count(x).over(laid.prefix()) >= n, F.col(out))})
        return laid

    return Step(apply, fade_rows(q) + n)


def smma(n: int, x: str = "close", out: str = "smma") -> Step:
    """Smoothed mean started by the plain mean of the first ``n`` rows."""
    q = (n - 1.0) / n

    def apply(laid: Laid) -> Laid:
        first = F.avg(x).over(laid.frame(-(n - 1), 0))
        fed = F.when(F.col(POS) == n - 1, first).when(F.col(POS) >= n, F.col(x) / n)
        laid = laid.add({"_fed": fed})
        return laid.add({out: F.when(F.col(POS) >= n - 1, decayed_sum(laid, F.col("_fed"), q))}).drop("_fed")

    return Step(apply, fade_rows(q) + n)


def seeded_ema(n: int, x: str = "close", out: str = "ema", seen: str | None = None) -> Step:
    """EMA whose first value is the mean of the first ``n`` known rows; null before."""
    q = span_decay(n)

    def apply(laid: Laid) -> Laid:
        rank = F.count(x).over(laid.prefix())
        laid = laid.add({"_rank": rank, "_mean": F.avg(x).over(laid.frame(-(n - 1), 0))})
        fed = F.when(F.col("_rank") == n, F.col("_mean")).when(F.col("_rank") > n, F.col(x) * (1.0 - q))
        laid = laid.add({"_fed": fed})
        value = F.when(F.col("_rank") >= n, decayed_sum(laid, F.col("_fed"), q))
        return laid.add({out: value}).drop("_rank", "_mean", "_fed")

    return Step(apply, fade_rows(q) + n)


def _weighted(laid: Laid, x: str, n: int) -> Column:
    """Weights 1..n by two sums over one frame; the row number inside the chunk keeps the terms small."""
    frame = laid.frame(-(n - 1), 0)
    slot = F.col("_slot").cast("double")
    rising = F.sum(F.col(x) * slot).over(frame) - (slot - n) * F.sum(x).over(frame)
    return F.when(F.count(x).over(frame) == n, rising / (n * (n + 1) / 2.0))


def wma(n: int, x: str = "close", out: str = "wma") -> Step:
    return Step(lambda laid: laid.add({out: _weighted(laid, x, n)}), n - 1)


def dema(n: int, x: str = "close", out: str = "dema") -> Step:
    value = Step(lambda laid: laid.add({out: F.col("_e1") * 2 - F.col("_e2")}))
    return dropping(ema(n, x, "_e1") >> ema(n, "_e1", "_e2") >> value, "_e1", "_e2")


def tema(n: int, x: str = "close", out: str = "tema") -> Step:
    value = Step(lambda laid: laid.add({out: (F.col("_e1") - F.col("_e2")) * 3 + F.col("_e3")}))
    chain = ema(n, x, "_e1") >> ema(n, "_e1", "_e2") >> ema(n, "_e2", "_e3")
    return dropping(chain >> value, "_e1", "_e2", "_e3")


def hma(n: int, x: str = "close", out: str = "hma") -> Step:
    """Hull mean: weighted mean of twice the half-length mean less the full one."""

    def raw(laid: Laid) -> Laid:
        return laid.add({"_raw": _weighted(laid, x, n // 2) * 2 - _weighted(laid, x, n)})

    return dropping(Step(raw, n - 1) >> wma(int(math.sqrt(n)), "_raw", out), "_raw")


def hma_simple(n: int, x: str = "close", out: str = "hma") -> Step:
    def raw(laid: Laid) -> Laid:
        return laid.add({"_raw": rolling(laid, F.avg, x, n // 2) * 2 - rolling(laid, F.avg, x, n)})

    return dropping(Step(raw, n - 1) >> sma(int(math.sqrt(n)), "_raw", out), "_raw")


def ehma(n: int, x: str = "close", out: str = "ehma") -> Step:
    def raw(laid: Laid) -> Laid:
        laid = ewm_columns(
            laid, {"_half": (F.col(x), span_decay(n // 2)), "_full": (F.col(x), span_decay(n))}
        )
        return laid.add({"_raw": F.col("_half") * 2 - F.col("_full")}).drop("_half", "_full")

    return dropping(Step(raw, fade_rows(span_decay(n))) >> ema(int(math.sqrt(n)), "_raw", out), "_raw")


def thma(n: int, x: str = "close", out: str = "thma") -> Step:
    def raw(laid: Laid) -> Laid:
        third, half, double = (_weighted(laid, x, k) for k in (n // 3, n // 2, 2 * n))
        return laid.add({"_raw": third * 3 - half - double})

    return dropping(Step(raw, 2 * n - 1) >> wma(2 * n, "_raw", out), "_raw")


def zlema(n: int, x: str = "close", out: str = "zlema") -> Step:
    gap = (n - 1) // 2
    change = Step(lambda laid: laid.add({"_change": F.col(x) - shift(laid, x, gap)}), gap)
    total = Step(lambda laid: laid.add({out: F.col(x) + F.col("_smooth")}))
    return dropping(change >> ema(n, "_change", "_smooth") >> total, "_change", "_smooth")


def alma(n: int, sigma: float = 6.0, x: str = "close", out: str = "alma") -> Step:
    """Gaussian weights centred at ``floor((n - 1) / 2)`` rows back in time."""
    centre = math.floor(0.5 * (n - 1))
    bell = np.exp(-((np.arange(n) - centre) ** 2) / (2.0 * (n / sigma) ** 2))
    weights = [float(w) for w in bell / bell.sum()]

    def apply(laid: Laid) -> Laid:
        terms = [shift(laid, x, k) * w for k, w in enumerate(weights)]
        value = terms[0]
        for term in terms[1:]:
            value = value + term
        return laid.add({out: value})

    return Step(apply, n - 1)


def jma(n: int, phase: float = 3.0, power: float = 1.0, x: str = "close", out: str = "jma") -> Step:
    """Jurik-style mean.

    Its last two coupled recurrences have the characteristic polynomial ``(z - alpha)**2``, so they equal two
    exponential means of ``e0 + ratio * e1`` one after the other.
    """
    ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100.0 + 1.5
    beta = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    alpha = beta**power

    def apply(laid: Laid) -> Laid:
        laid = ewm_columns(laid, {"_e0": (F.col(x), alpha)})
        laid = laid.add({"_e1": decayed_sum(laid, (F.col(x) - F.col("_e0")) * (1 - beta), beta)})
        laid = laid.add({"_u": F.col("_e0") + F.col("_e1") * ratio})
        laid = ewm_columns(laid, {"_v": (F.col("_u"), alpha)})
        return ewm_columns(laid, {out: (F.col("_v"), alpha)}).drop("_e0", "_e1", "_u", "_v")

    return Step(apply, 3 * fade_rows(alpha) + fade_rows(beta))


def kalman(length: int, x: str = "close", out: str = "kalman", noise: float = 0.01, drift: float = 0.1) -> Step:
    """Kalman level. The gain depends on the row number only: the error recurrence is a Moebius map with a closed form."""
    m, q = noise * length, drift / length
    root = math.sqrt(q * q + 4 * q * m)
    high, low = (q + root) / 2, (q - root) / 2
    rate = (m + low) / (m + high)
    start = (1.0 - high) / (1.0 - low)
    steady = m / (high + m)

    def apply(laid: Laid) -> Laid:
        ratio = F.pow(F.lit(rate), (F.col(POS) - 1).cast("double")) * start
        error = (high - ratio * low) / (F.lit(1.0) - ratio)
        gain = F.when(F.col(POS) == 0, F.lit(1.0)).otherwise(error / (error + m))
        laid = laid.add({"_b": F.col(x) * gain, "_fade": F.when(F.col(POS) == 0, F.lit(0.0)).otherwise(-F.log1p(-gain))})
        return laid.on(affine_sum(laid.df, [*laid.keys, CHUNK], POS, "_b", "_fade", out)).drop("_b", "_fade")

    return Step(apply, fade_rows(steady))


def mcginley(n: int, x: str = "close", out: str = "mcginley") -> Step:
    def step(state, row):
        price = row[0]
        if price is None or price != price:
            return state, [np.nan]
        if not state:
            return [price], [price]
        prev = np.float64(state[0])
        with np.errstate(all="ignore"):
            value = float(prev + (price - prev) / (n * (price / prev) ** 4))
        return [value], [value]

    return fold_step(step, [x], [out], warmup=64 * n)


def vidya(n: int = 10, momentum: int = 20, x: str = "close", out: str = "vidya", smooth: int = 15, tail: int = 0) -> Step:
    """Exponential mean whose weight follows the absolute momentum ratio, then a plain mean."""
    alpha = 2.0 / (n + 1.0)

    def weight(laid: Laid) -> Laid:
        change = F.col(x) - shift(laid, x)
        laid = laid.add(
            {
                "_up": F.when(change >= 0, change).otherwise(F.lit(0.0)),
                "_down": F.when(change < 0, -change).otherwise(F.lit(0.0)),
            }
        )
        up, down = (rolling(laid, F.sum, c, momentum) for c in ("_up", "_down"))
        ratio = F.abs(F.try_divide(up - down, up + down))
        return laid.add({"_w": F.coalesce(ratio, F.lit(0.0)) * alpha}).drop("_up", "_down")

    def level(laid: Laid) -> Laid:
        """The weight may be zero for long, so no overlap is long enough: chunks start from zero and the level each
        chunk is entered with is added, faded by its own weights. Between chunks the same recurrence runs over one row each."""
        keys = [*laid.keys, CHUNK]
        first = F.col(POS) == 0
        core = laid.df.filter(CORE).withColumns(
            {
                "_b": F.when(first, F.col(x)).otherwise(F.col(x) * F.col("_w")),
                "_fade": F.when(first, F.lit(0.0)).otherwise(F.least(-F.log1p(-F.col("_w")), F.lit(LONGEST_FADE))),
            }
        )
        core = affine_sum(core, keys, POS, "_b", "_fade", "_local")
        tops = materialize(core.groupBy(*keys).agg(F.max_by("_local", POS).alias("_b"), F.sum("_fade").alias("_fade")))
        ends = affine_sum(tops, list(laid.keys), CHUNK, "_b", "_fade", "_end")
        entered = ends.select(*laid.keys, (F.col(CHUNK) + 1).alias(CHUNK), F.col("_end").alias("_entry"))
        age = F.sum("_fade").over(Window.partitionBy(*keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0))
        core = core.join(entered, keys, "left").withColumn("_age", age)
        core = core.withColumn("_level", F.col("_local") + F.coalesce(F.col("_entry") * F.exp(-F.col("_age")), F.lit(0.0)))
        return spread(core.drop("_b", "_fade", "_local", "_entry", "_age"), laid.rows, smooth + tail, 0, laid.keys)

    core = Step(weight, momentum + 1) >> Step(level)
    return dropping(core >> sma(smooth, "_level", out), "_w", "_level")
