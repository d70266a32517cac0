"""Batched sweeps against one set at a time, skipped entries."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.sql import functions as F

from tapeline.operators import trades
from tapeline.plans import sweeps
from tests.conftest import MINUTE, collected

KEPT = ("symbol", "param_id", "side", "entry_ts", "entry_pos", "entry_price", "exit_ts", "exit_pos", "exit_price", "exit_reason", "by_signal", "lot", "profit")


def _signal(p):
    """A signal that depends on the set, with quiet stretches."""
    turn = F.xxhash64("ts", "symbol") % p["beat"]
    return F.when(turn == 0, 1).when(turn == 1, -1)


def _one_by_one(bars, params):
    rows = sweeps.with_params(bars, params)
    none = F.lit(None).cast("double")
    when = lambda switch, pips: F.when(F.col(switch), F.col(pips)).otherwise(none)
    turn = F.xxhash64("ts", "symbol") % F.col("beat")
    stop = when("use_sl", "sl_pips")
    lot = trades.fixed_risk_lot(5000.0, 2.0, F.coalesce(stop, F.lit(50.0)), 1.0, 10.0)
    return trades.bar_trades(
        rows, MINUTE, F.when(turn == 0, 1).when(turn == 1, -1), stop, when("use_tp", "tp_pips"), when("use_risk_free", "risk_free_distance_pips"),
        F.col("close_opposite_position"), lot, trades.money_per_point(lot, 1.0, 10.0), keys=("symbol", "param_id"),
    )


def test_all_sets_in_one_walk(spark, bars, small_chunks):
    grid = sweeps.risk_grid([0.5, 3.0], [1.5, 4.0], [2.0, 60.0])
    params = [{**{k: float(v) if k.endswith("pips") else v for k, v in p.items()}, "beat": beat} for p, beat in itertools.product(grid, (5, 40))]
    got = sweeps.sweep_trades(bars, MINUTE, params, _signal, 1.0, 10.0)
    want = collected(_one_by_one(bars, params).select(*KEPT))
    assert collected(got.select(*KEPT)) == want and len(want) > 2000
    assert {r[9] for r in want} == {"TP", "SL", "Manual Close"}
    assert sweeps.sweep_trades(bars.limit(0), MINUTE, params, _signal, 1.0, 10.0).count() == 0


def test_a_sweep_moves_each_bar_once(spark, bars):
    """No row is copied per set, and no exchange carries a signal of a set."""
    params = [{"beat": n, "sl_pips": 3.0, "tp_pips": 5.0} for n in range(2, 60)]
    done = sweeps.sweep_trades(bars, MINUTE, params, _signal, 1.0, 10.0)._jdf.queryExecution()
    logical, physical = done.optimizedPlan().toString(), done.executedPlan().toString()
    assert logical.count("Generate") == 1 and "Generate explode(sequence(" in logical  # copies of rows at the ends of chunks only
    # plans print from the result down: signals are made above every exchange
    assert "Exchange" not in physical[: physical.index("AS _signals")] and "Exchange" in physical


def test_constant_lots_equal_column_lots(spark):
    rng = random.Random(4)
    for _ in range(12):
        pips, pip, per_lot = rng.uniform(0.5, 900), rng.choice([0.01, 0.1, 1.0, 100.0]), rng.choice([0.1, 1.0, 10.0])
        told = sweeps.trade_setting({"sl_pips": pips}, pip, per_lot)
        lot = trades.fixed_risk_lot(5000.0, 2.0, F.lit(pips) * pip, pip, per_lot)
        row = spark.range(1).select(lot.alias("lot"), trades.money_per_point(lot, pip, per_lot).alias("worth")).first()
        assert math.isclose(told["lot"], row.lot) and math.isclose(told["worth"], row.worth)
    assert math.isnan(sweeps.trade_setting({"use_sl": False}, 1.0, 1.0)["stop"])


def test_signals_without_a_range_are_counted(spark, bars, small_chunks):
    """Every signal is skipped if no range is known; with a range from some bar on, only those before it."""
    turn = F.when(F.minute("ts") % 7 == 0, 1).when(F.minute("ts") % 7 == 3, -1)
    signals = {r.symbol: r.n for r in bars.groupBy("symbol").agg(F.count_if(turn.isNotNull()).alias("n")).collect()}
    nothing = F.lit(None).cast("double")
    lot = lambda stop: trades.fixed_risk_lot(5000.0, 2.0, stop, 1.0, 10.0)
    none = trades.skipped_entries(bars, MINUTE, turn, nothing, nothing, lot(nothing))
    assert {r.symbol: r.skipped_entries for r in none.collect()} == signals
    assert trades.bar_trades(bars, MINUTE, turn, nothing, nothing, lot=lot(nothing)).count() == 0
    late = F.when(F.col("ts") >= "2024-01-01 01:00:00", 2.0)
    early = {r.symbol: r.n for r in bars.filter("ts < '2024-01-01 01:00:00'").groupBy("symbol").agg(F.count_if(turn.isNotNull()).alias("n")).collect()}
    some = trades.skipped_entries(bars, MINUTE, turn, late, late * 1.5, lot(late))
    assert {r.symbol: r.skipped_entries for r in some.collect()} == early
