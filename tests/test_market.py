"""Bars, structure, trades, fills and metrics on small hand-checked or brute-forced cases."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.operators import bars as bar_ops
from tapeline.operators import labels, ledger, metrics, structure, trades
from tests.conftest import DAY, MINUTE, SHAPE, collected

T0 = datetime(2024, 1, 1)


def make(spark, rows, symbol="S"):
    return spark.createDataFrame([(symbol, T0 + timedelta(minutes=i), *map(float, r), 1.0) for i, r in enumerate(rows)], SHAPE)


def test_six_minutes_give_two_bars(spark):
    rows = [(1, 2, 0, 1.5), (2, 4, 1, 3), (3, 3.5, 2, 2), (4, 5, 3, 4), (4, 4, 2, 2), (2, 3, 1, 1)]
    bars = make(spark, rows).withColumn("volume", F.lit(2.0))
    out = collected(bar_ops.resample(bars, "3m").select("ts", "open", "high", "low", "close", "volume"))
    assert out[0][1:] == (1.0, 4.0, 0.0, 2.0, 6.0)
    assert out[1][1:] == (4.0, 5.0, 1.0, 1.0, 6.0)


def test_path_follows_the_direction_of_the_bar(spark):
    path = bar_ops.bars_to_path(make(spark, [(100, 112, 98, 110), (110, 111, 90, 95)])).orderBy("ts", "leg")
    assert [r.price for r in path.collect()] == [100, 112, 98, 110, 110, 90, 111, 95]


def test_gap_is_mitigated_or_partly_filled(spark):
    rows = [(10, 11, 9, 10), (11, 14, 10, 13), (14, 16, 13, 15), (15, 17, 12, 16), (16, 18, 14, 17)]
    gap = structure.fair_value_gaps(make(spark, rows), MINUTE).filter("type = 'bullish'").orderBy("ts").first()
    assert (gap.top, gap.bottom, gap.is_mitigated) == (13.0, 11.0, False)
    assert gap.fill_percentage == pytest.approx(50.0)


def mirrored(bars):
    """Prices turned upside down around 1000."""
    return bars.select("symbol", "ts", *[(1000 - F.col(s)).alias(t) for t, s in (("open", "open"), ("high", "low"), ("low", "high"), ("close", "close"))], "volume")


def swap(rows):
    return sorted((r.symbol, str(r.ts), r.event, {"up": "down", "down": "up"}[r.direction], round(1000 - r.price, 6)) for r in rows)


def test_structure_is_symmetric_and_independent_of_chunks(spark, bars):
    """Up and down events swap when prices are negated, apart from the first undecided leg of a series."""
    kinds = ("BOS", "CHOCH", "IDM")
    plain = structure.structure_events(bars, MINUTE, forget=True).filter(F.col("event").isin(*kinds)).collect()
    turned = structure.structure_events(mirrored(bars), MINUTE, forget=True).filter(F.col("event").isin(*kinds)).collect()
    a = sorted((r.symbol, str(r.ts), r.event, r.direction, round(r.price, 6)) for r in plain)
    assert {r.event for r in plain} == set(kinds)
    same = set(a) & set(swap(turned))
    assert len(same) >= 0.9 * len(a)
    spark.conf.set("spark.tapeline.chunkRows", "48")
    try:
        cut = structure.structure_events(bars, MINUTE, forget=True, warmup=4).filter(F.col("event").isin(*kinds)).collect()
    finally:
        spark.conf.unset("spark.tapeline.chunkRows")
    assert a == sorted((r.symbol, str(r.ts), r.event, r.direction, round(r.price, 6)) for r in cut)


def test_first_close_beyond_the_start_is_a_change_then_breaks_follow(spark):
    """Rising bars with one pullback: a change of character, a taken inducement, then a break."""
    closes = [10, 11, 12, 13, 12, 14, 15, 14, 13, 11.5, 13, 15, 17]
    rows = [(c - 0.2, c + 0.5, c - 0.5, c) for c in closes]
    events = structure.structure_events(make(spark, rows), MINUTE, forget=True).orderBy("ts").collect()
    names = [(r.event, r.direction) for r in events if r.event in ("BOS", "CHOCH", "IDM")]
    assert names[0] == ("CHOCH", "up")
    assert ("IDM", "up") in names and ("BOS", "up") in names
    assert names.index(("IDM", "up")) < names.index(("BOS", "up"))
    bos = next(r for r in events if r.event == "BOS")
    assert bos.price == 15.5  # the highest high before the break


def test_zones_open_are_never_touched_later(spark, bars, frame):
    zones = structure.order_blocks(bars, MINUTE).collect()
    assert zones
    events = structure.zone_events(bars, MINUTE).toPandas()
    for z in zones:
        g = frame[z.symbol]
        born = events[(events.symbol == z.symbol) & (events.kind == z.kind) & (events.start_pos == z.start_pos)].pos.max()
        later = g.iloc[int(born) + 1 :]
        if z.kind == "supply":
            assert not (later.high >= z.top).any()
        else:
            assert not (later.low <= z.bottom).any()


def falling(n):
    """Falling bars with a rebound every seventh bar: supply zones that nothing reaches again, and a rise through half of them."""
    rng, price, rows = random.Random(n), 1000.0, []
    for i in range(n):
        price += 4.0 if i % 7 in (3, 4) else -2.5
        price += 1.1 * (n / 3) * (i == n - 20)
        c = price + rng.uniform(-0.3, 0.3)
        rows.append((c + 0.5, c + 1.5, c - 1.5, c - 0.5))
    return rows


def test_zones_settle_in_few_rounds_whatever_the_number_of_chunks(spark, monkeypatch):
    """Zones that outlive every chunk cost no more rounds over 40 chunks than over 10, and give the events of one pass."""
    from tapeline.operators import fold

    written, real = [], fold.materialize
    monkeypatch.setattr(fold, "materialize", lambda df: written.append(1) or real(df))
    counts = []
    for n in (640, 2560):
        df = make(spark, falling(n))
        whole = collected(structure.zone_events(df, MINUTE, warmup=8))
        assert len({r[5] for r in whole if "created" in r}) > n / 30 and any("removed" in r for r in whole)
        spark.conf.set("spark.tapeline.chunkRows", "64")
        written.clear()
        try:
            assert collected(structure.zone_events(df, MINUTE, warmup=8)) == whole
        finally:
            spark.conf.unset("spark.tapeline.chunkRows")
        counts.append(len(written))
    assert counts[1] <= counts[0] + 2 and counts[1] <= 11


def test_inducement_points(spark, bars, frame):
    rows = structure.inducements(bars, MINUTE, length=5).collect()
    assert rows
    for r in rows:
        g = frame[r.symbol]
        part = g.iloc[r.start_pos : r.end_pos + 1]
        head = part.high.idxmax() if r.direction == "up" else part.low.idxmin()
        assert r.head_pos == head
        after = g.iloc[r.end_pos + 1 :]
        hit = after[after.high >= r.head_price] if r.direction == "up" else after[after.low <= r.head_price]
        assert r.head_mitigated_pos == (hit.index[0] if len(hit) else None)


def test_target_before_stop_and_no_exit_on_the_entry_bar(spark):
    rows = [(10, 30, 1, 10), (10, 11, 9, 10), (10, 13, 7, 10), (10, 11, 9, 10)]
    bars = make(spark, rows).withColumn("signal", F.when(F.minute("ts") == 0, 1).otherwise(0))
    out = trades.bar_trades(bars, MINUTE, F.col("signal"), F.lit(2.0), F.lit(2.0)).collect()
    assert [(r.exit_pos, r.exit_reason, r.exit_price, r.profit) for r in out] == [(2, "TP", 12.0, 2.0)]


def test_opposite_signal_closes_and_reopens(spark):
    rows = [(10, 10, 10, 10), (12, 12, 12, 12), (11, 11, 11, 11), (8, 8, 8, 8)]
    bars = make(spark, rows).withColumn("signal", F.when(F.minute("ts") == 0, 1).when(F.minute("ts") == 1, -1).otherwise(0))
    out = trades.bar_trades(bars, MINUTE, F.col("signal"), F.lit(3.0), F.lit(4.0), close_opposite=True).orderBy("exit_pos").collect()
    assert [(r.side, r.exit_reason, r.profit) for r in out] == [("buy", "Manual Close", 2.0), ("sell", "TP", 4.0)]


def test_target_crossed_fills_at_the_crossing_price(spark):
    ticks = spark.createDataFrame([("S", T0 + timedelta(seconds=i), i, b, b) for i, b in enumerate([100.0, 101.0, 105.0, 90.0])], "symbol string, ts timestamp_ntz, seq long, bid double, ask double")
    orders = spark.createDataFrame([("a", "S", T0, "buy", 1.0, 100.0, 95.0, 104.0)], "trade_id string, symbol string, ts timestamp_ntz, side string, volume double, price double, sl double, tp double")
    fill = trades.fill_orders(orders, ticks, 1).first()
    assert (fill.exit_reason, fill.exit_price, fill.profit) == ("TP", 105.0, 5.0)


def test_costs_of_a_fill(spark):
    ticks = spark.createDataFrame([("S", T0, 0, 100.0, 100.0), ("S", T0 + timedelta(seconds=1), 1, 109.0, 111.0)], "symbol string, ts timestamp_ntz, seq long, bid double, ask double")
    orders = spark.createDataFrame([("a", "S", T0, "buy", 1.0, 100.0, 95.0, 110.0)], "trade_id string, symbol string, ts timestamp_ntz, side string, volume double, price double, sl double, tp double")
    fill = trades.fill_orders(orders, ticks, 1, commission_per_lot=2.0).first()
    assert (fill.gross, fill.profit) == (9.0, 5.0)


def test_profit_list(spark):
    done = spark.createDataFrame([("S", T0 + timedelta(days=i), p) for i, p in enumerate([100.0, -50.0, 25.0, -25.0])], "symbol string, exit_ts timestamp_ntz, profit double")
    m = metrics.trade_metrics(done, initial_balance=1000.0).first()
    assert m.profit_factor == pytest.approx(1.6667, abs=1e-4)
    assert m.net_profit == 50.0
    fall = metrics.max_drawdown(metrics.balance_curve(done, DAY, 1000.0), DAY, "balance", ts="exit_ts", initial=1000.0).first()
    assert fall.max_drawdown == 50.0


def test_equity_list(spark):
    curve = spark.createDataFrame([("S", T0 + timedelta(days=i), e) for i, e in enumerate([1000.0, 1100.0, 1040.0, 1200.0, 1150.0])], "symbol string, ts timestamp_ntz, equity double")
    fall = metrics.max_drawdown(curve, DAY, "equity").first()
    assert (fall.max_drawdown, fall.peak, fall.trough) == (60.0, 1100.0, 1040.0)


def test_split_sizes_use_the_largest_remainder(spark):
    for n in range(10, 60):
        got = spark.range(1).select(*labels.split_sizes(F.lit(n))).first()
        assert sum(got) == n
        exact = [n * r for r in labels.DEFAULT_RATIOS]
        assert all(abs(g - e) < 1 + 1e-9 for g, e in zip(got, exact))


def test_reconcile_matches_ids_inside_comments(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    states = spark.createDataFrame(
        [("t:1", "SENT", "S", "st", T0, 0), ("t:2", "SENT", "S", "st2", T0, 0), ("t:3", "ACCEPTED", "S", "other", T0, 5), ("t:4", "SENT", "S", "zz", T0 + timedelta(minutes=59), 0)],
        "trade_id string, state string, symbol string, strategy string, updated_at timestamp_ntz, ticket long",
    )
    shape = "symbol string, magic int, comment string, ticket long"
    orders = spark.createDataFrame([("S", 1, "x-t:1-y", 11)], shape)
    positions = spark.createDataFrame([("S", 1, "other:note", 12)], shape)
    got = {r.trade_id: (r.next_state, r.action, r.ticket) for r in ledger.reconcile(states, orders, positions, now, 120, 1).collect()}
    assert got == {"t:1": ("ACCEPTED", "recovered", 11), "t:2": ("REJECTED", "rejected", 0), "t:3": ("OPEN", "opened", 12), "t:4": ("SENT", "waiting", 0)}


def test_script_zones_do_not_depend_on_chunks_and_end_no_more_than_they_start(spark, bars):
    names = ("symbol", "ts", "kind", "event", "start_pos", "top", "bottom")
    whole = structure.script_zones(bars, MINUTE, 0.1, True).select(*names).collect()
    assert {"created", "mitigated", "swept"} <= {r.event for r in whole}
    # a zone that is broken back and forth starts again each time, so starts and ends are counted per zone
    starts, ends = Counter(), Counter()
    for r in whole:
        key = (r.symbol, r.kind, r.start_pos)
        starts[key] += r.event in ("created", "merged", "breaker")
        ends[key] += r.event in ("swept", "expired")
    assert all(ends[k] <= starts[k] for k in ends)
    spark.conf.set("spark.tapeline.chunkRows", "64")
    try:
        cut = structure.script_zones(bars, MINUTE, 0.1, True, warmup=8).select(*names).collect()
    finally:
        spark.conf.unset("spark.tapeline.chunkRows")
    assert sorted(map(str, whole)) == sorted(map(str, cut))


def test_structure_levels_enclose_the_close(spark, bars):
    levels = structure.structure_levels(bars, MINUTE).join(bars, ["symbol", "ts"])
    outside = levels.filter("high > structure_high OR low < structure_low OR abs(equilibrium - (structure_high + structure_low) / 2) > 1e-9")
    assert levels.count() == bars.count() and outside.count() == 0


def test_ladder_of_a_flat_day_and_closes_on_rungs(spark):
    """A larger bar after a flat one has one rung; a close that lies on a rung is neither above nor below it."""
    from tapeline.operators.oscillators import range_ladder

    rng = random.Random(3)
    days = [[(100, 100, 100, 100)] * 3, [(100, 103, 99, 101), (101, 104, 100, 100.5)]]
    for _ in range(60):
        low = round(rng.uniform(1, 50), 2)
        days.append([(low + 0.1, low + 0.8 * rng.randrange(1, 4), low, low + 0.1)] + [(low + 0.1 * k, low + 0.1 * k, low + 0.1 * k, low + 0.1 * k) for k in range(1, 9)])
    rows = [("S", T0 + timedelta(days=i, hours=j), *map(float, r), 1.0) for i, day in enumerate(days) for j, r in enumerate(day)]
    got = {r.ts: (r.above, r.below) for r in range_ladder(spark.createDataFrame(rows, SHAPE), 3600, "1d").collect()}
    want, leg = {}, None
    for i, day in enumerate(days):
        high, low = max(r[1] for r in day), min(r[2] for r in day)
        if leg is not None:
            down = day[0][0] > day[-1][3]
            rungs = [(high if down else low) + (-leg if down else leg) * k for k in range(51)]
            for j, r in enumerate(day):
                want[T0 + timedelta(days=i, hours=j)] = (min((x for x in rungs if x > r[3]), default=None), max((x for x in rungs if x < r[3]), default=None))
        leg = (high - low) / 8
    assert got == want


def test_lots_round_halves_away_from_zero():
    """A balance of 3,750 asks for 0.015 lots, one of 11,250 for 0.045; both doubles lie below the half."""
    step = trades.balance_step(2.0, 5000.0, 0.1, 1.0)
    lots = [step([balance], (0.0, 50000.0, 0.1, 1.0))[1][0] for balance in (3750.0, 6250.0, 8750.0, 11250.0, 100.0)]
    assert lots == [0.02, 0.03, 0.04, 0.05, 0.01]
