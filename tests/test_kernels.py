"""Positions, chunks, scans, folds, as-of and first-touch joins against plain pandas and Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import moving_averages as ma
from tapeline.operators import oscillators as osc
from tapeline.operators import trend
from tapeline.operators.asof import asof_join
from tapeline.operators.features import build_features, feature_names
from tapeline.operators.fold import fold_columns
from tapeline.operators.layout import POS, TOTAL, lay_out, spread, with_positions
from tapeline.operators.scans import decayed_sum, fade_rows, prefix_carry
from tapeline.operators.steps import run
from tapeline.operators.touch import first_touch
from tests.conftest import MINUTE, collected


def series(df, symbol, column):
    return df.filter(F.col("symbol") == symbol).orderBy("ts").select(column).toPandas()[column]


def test_positions_count_rows_per_symbol(bars, frame):
    placed = with_positions(bars, 1.0).toPandas().sort_values(["symbol", "ts"])
    for symbol, g in placed.groupby("symbol"):
        assert g[POS].tolist() == list(range(len(frame[symbol])))
        assert set(g[TOTAL]) == {len(g)}


def test_chunks_hold_each_row_once_as_core(bars, small_chunks):
    laid = lay_out(bars, MINUTE, lookback=5, lookahead=2)
    assert laid.rows == small_chunks
    assert laid.core().count() == bars.count()
    assert laid.df.count() > bars.count()


@pytest.mark.parametrize("n", [1, 2, 5, 14, 60])
def test_ema_equals_pandas(bars, frame, small_chunks, n):
    got = run(bars, MINUTE, ma.ema(n, out="e"), ma.ema(n, out="a", adjust=True))
    for symbol, g in frame.items():
        want = g["close"].ewm(span=n, adjust=False).mean()
        np.testing.assert_allclose(series(got, symbol, "e"), want, rtol=1e-12)
        want = g["close"].ewm(span=n).mean()
        np.testing.assert_allclose(series(got, symbol, "a"), want, rtol=1e-12)


@pytest.mark.parametrize("q", [0.2, 0.6, 0.8, 0.95])
def test_every_form_of_the_decayed_sum(spark, q):
    """Long chunks take the list form or the two block grids, short ones the single running sum."""
    rng = random.Random(5)
    values = [rng.uniform(-1, 1) for _ in range(30000)]
    rows = spark.createDataFrame([("S", i, len(values), v) for i, v in enumerate(values)], "symbol string, _pos long, _total long, v double")
    want, x = [], 0.0
    for v in values:
        x = q * x + v
        want.append(x)
    for size in (40, 20000):
        laid = spread(rows, size, fade_rows(q), 0, ("symbol",))
        got = laid.add({"x": decayed_sum(laid, F.col("v"), q)}).core(keep=[POS]).orderBy(POS).toPandas()["x"]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
        assert got[0] == values[0]


def test_weighted_and_hull_means_equal_pandas(bars, frame, small_chunks):
    def wma(x, n):
        return x.rolling(n).apply(lambda v: np.dot(v, np.arange(1, n + 1)) / (n * (n + 1) / 2), raw=True)

    got = run(bars, MINUTE, ma.wma(10, out="w"), ma.hma(16, out="h"))
    for symbol, g in frame.items():
        np.testing.assert_allclose(series(got, symbol, "w"), wma(g["close"], 10), rtol=1e-10)
        want = wma(2 * wma(g["close"], 8) - wma(g["close"], 16), 4)
        np.testing.assert_allclose(series(got, symbol, "h"), want, rtol=1e-9)


def test_jma_equals_its_coupled_recurrences(bars, frame, small_chunks):
    got = run(bars, MINUTE, ma.jma(7, out="j"))
    beta = 0.45 * 6 / (0.45 * 6 + 2)
    for symbol, g in frame.items():
        x = g["close"].tolist()
        e0, e1, e2, j, want = x[0], 0.0, 0.0, x[0], [x[0]]
        for v in x[1:]:
            e0 = (1 - beta) * v + beta * e0
            e1 = (v - e0) * (1 - beta) + beta * e1
            e2 = (e0 + 1.53 * e1 - j) * (1 - beta) ** 2 + beta**2 * e2
            j += e2
            want.append(j)
        np.testing.assert_allclose(series(got, symbol, "j"), want, rtol=1e-10)


@pytest.mark.parametrize("kind,reverse", [("sum", False), ("max", False), ("min", True), ("last", False)])
def test_prefix_results_cross_chunks(bars, frame, small_chunks, kind, reverse):
    x = F.when(F.col("volume") % 5 == 0, F.col("close"))
    laid = prefix_carry(lay_out(bars, MINUTE, 3, 3), {"out": (kind, x)}, reverse=reverse)
    got = laid.core()
    for symbol, g in frame.items():
        s = g["close"].where(g["volume"] % 5 == 0)
        s = s[::-1] if reverse else s
        want = {"sum": lambda: s.fillna(0).cumsum(), "max": lambda: s.expanding().max(), "min": lambda: s.expanding().min(), "last": lambda: s.ffill()}[kind]()
        want = want[::-1] if reverse else want
        np.testing.assert_allclose(series(got, symbol, "out").fillna(-1), want.fillna(0 if kind == "sum" else -1).values, rtol=1e-12)


def test_fold_equals_one_pass_even_when_guesses_are_wrong(bars, frame, small_chunks):
    """A counter never forgets its start, so every guess from two warm-up rows is wrong and has to be repaired."""

    def step(state, row):
        total = (state[0] if state else 0.0) + row[0]
        return [total], [total]

    got = fold_columns(lay_out(bars, MINUTE, 2), step, ["volume"], ["total"]).core()
    for symbol, g in frame.items():
        np.testing.assert_allclose(series(got, symbol, "total"), g["volume"].cumsum())


def everything():
    return [
        ma.smma(7, out="s"), ma.kalman(50, out="k"), ma.vidya(out="v"), ma.zlema(9, out="z"), osc.adx(), osc.macd(), osc.rsi(), osc.cci(10), trend.sar(),
    ]


def test_results_do_not_depend_on_the_chunk_size(spark, bars):
    names = ["s", "k", "v", "z", "adx", "macd_hist", "rsi", "cci", "sar"]
    tables = []
    for rows in (40, 10000):
        df = run(bars, MINUTE, *[s for s in everything()[:2]], rows=rows)
        for step in everything()[2:]:
            extra = run(bars, MINUTE, step, rows=rows)
            new = [c for c in extra.columns if c in names]
            df = df.join(extra.select("symbol", "ts", *new), ["symbol", "ts"])
        tables.append(df.select("symbol", "ts", *names).toPandas().sort_values(["symbol", "ts"]))
    for n in names:
        np.testing.assert_allclose(tables[0][n].to_numpy(float), tables[1][n].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_causal_steps_ignore_later_rows(spark, bars):
    cut = bars.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    changed = bars.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    steps = [trend.supertrend(), trend.ut_bot(), osc.keltner(), osc.stoch_rsi(), trend.half_trend()]
    for step in steps:
        assert step.causal
        a, b = (collected(run(df, MINUTE, step).filter(F.col("ts") <= cut).drop("volume")) for df in (bars, changed))
        assert a == b
    a, b = (collected(build_features(df, MINUTE, False).filter(F.col("ts") <= cut).select("symbol", "ts", *feature_names())) for df in (bars, changed))
    assert a == b
    assert not osc.ichimoku().causal


def test_asof_join_equals_merge_asof(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    left = [(rng.choice("XY"), start + timedelta(seconds=rng.randrange(5000)), i) for i in range(300)]
    right = [(s, start + timedelta(seconds=t), float(t)) for s in "XY" for t in sorted(rng.sample(range(5000), 60))]
    lf = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, id int")
    rf = spark.createDataFrame(right, "symbol string, ts timestamp_ntz, v double")
    for strict in (False, True):
        got = asof_join(lf, rf, ["v"], seconds=1, rows=64, strict=strict).toPandas().set_index("id")["v"]
        want = pd.merge_asof(
            pd.DataFrame(left, columns=["symbol", "ts", "id"]).sort_values("ts"), pd.DataFrame(right, columns=["symbol", "ts", "v"]).sort_values("ts"),
            on="ts", by="symbol", allow_exact_matches=not strict,
        ).set_index("id")["v"]
        pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False, check_index_type=False)


@pytest.mark.parametrize("fan", [2, 3, 128])
def test_first_touch_equals_search(spark, fan):
    rng = random.Random(fan)
    prices = {s: [rng.gauss(0, 5) for _ in range(120)] for s in "PQ"}
    rows = spark.createDataFrame([(s, i, p) for s, ps in prices.items() for i, p in enumerate(ps)], "symbol string, _pos long, p double")
    asked = [(f"e{i}", rng.choice("PQ"), rng.randrange(-1, 119), rng.choice([None, rng.uniform(0, 14)]), rng.choice([None, -rng.uniform(0, 14)])) for i in range(150)]
    events = spark.createDataFrame(asked, "id string, symbol string, at long, up double, down double")
    got = {r.id: r.touch_pos for r in first_touch(events, rows, ["id"], "at", "up", "down", "p", "p", fan=fan).collect()}
    for name, s, at, up, down in asked:
        want = next((i for i in range(at + 1, 120) if (up is not None and prices[s][i] >= up) or (down is not None and prices[s][i] <= down)), None)
        assert got[name] == want


def test_first_touch_climbs_every_level_once(spark):
    """What a level finds is written, so the plan of the result holds one join of events with a level on the way up, not one for each use."""
    rows = spark.range(300).select(F.lit("P").alias("symbol"), F.col("id").alias("_pos"), (F.col("id") % 97).cast("double").alias("p"))
    events = rows.select(F.col("_pos").alias("id"), "symbol", F.col("_pos").alias("at"), (F.col("p") + 5).alias("up"), F.lit(-1.0).alias("down"))
    found = first_touch(events, rows, ["id"], "at", "up", "down", "p", "p", fan=3)  # five levels above the rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 5 + 1 + 2 * 5 + 1  # open events, the top, opening and children of each level, the events


def test_dense_ticks_narrow_the_buckets(spark, monkeypatch):
    """100,000 ticks in one hour, stated as five minutes apart: no ranking window is longer than the bound."""
    from tapeline.operators import layout

    widths = []
    fitted = layout.fitted_width
    monkeypatch.setattr(layout, "fitted_width", lambda *a: widths.append(fitted(*a)) or widths[-1])
    ticks = spark.range(100_000).select(
        F.lit("S").alias("symbol"), F.timestamp_seconds(F.col("id") * 0.036 + 1_700_000_000).cast("timestamp_ntz").alias("ts"), "id"
    )
    placed = layout.with_positions(ticks, 300, tie=("id",))
    longest = ticks.groupBy(F.floor(layout.epoch_seconds("ts") / widths[0])).count().agg(F.max("count")).first()[0]
    assert longest <= 4 * layout.BUCKET_ROWS
    assert placed.filter(F.col("_pos") != F.col("id")).isEmpty()
