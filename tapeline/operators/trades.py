"""Signals to trades, order fills and marked equity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapeline.operators.asof import asof_join
from tapeline.operators.bars import at_seconds
from tapeline.operators.fold import fold_columns, fold_events
from tapeline.operators.layout import CHUNK, POS, epoch_seconds, lay_out, spread, with_positions
from tapeline.operators.scans import prefix_carry, shift
from tapeline.operators.touch import first_touch
from tapeline.session import chunk_rows, materialize

EXIT_REASONS = ("TP", "SL", "Manual Close", "SL")  # the last one: a losing close on the opposite signal
NAN = float("nan")
SKIPPED = -1.0


BALANCE_ROWS = 65536  # trades per task of the balance pass


def half_away(x: float, digits: int) -> float:
    """``x`` rounded to ``digits`` places, halves away from zero; Python's ``round`` looks at the binary digits beyond a half."""
    scale = 10.0**digits
    whole = math.floor(abs(x) * scale)
    whole += abs(x) * scale - whole >= 0.5
    return math.copysign(whole / scale, x)


def trade_step():
    """One bar of the one-position machine.

    Row: high, low, close, position, seconds, signal, stop and target distance, break-even distance, close on opposite,
    lot, money per price unit. Unused distances are nan; a signal without a lot is not taken.
    Emits ``(reason, side, entry seconds, entry position, entry price, exit price, lot, profit, stop, money per unit)``; the
    reason ``SKIPPED`` marks a signal that found no position open and had no lot.
    """

    def step(state, row):
        high, low, close, pos, now, signal, stop, target, free, opposite, lot, worth = row
        side, entry, since, at, sl, tp, freed, size, unit, width = state or [0.0, NAN, NAN, NAN, NAN, NAN, 0.0, NAN, NAN, NAN]
        out = []

        def leave(price, reason):
            profit = side * (price - entry) * unit
            if reason == 2 and profit < 0:
                reason = 3
            out.append((float(reason), side, since, at, entry, price, size, profit, width, unit))

        if side and opposite and signal and signal == -side:
            leave(close, 2)
            side = 0.0
        if not side:
            size, unit, width = lot, worth, stop
            if signal and size == size:
                side, entry, since, at, freed = signal, close, now, pos, 0.0
                sl, tp = close - signal * stop, close + signal * target
            elif signal:
                out.append((SKIPPED, signal, now, pos, close, close, size, 0.0, stop, worth))
        else:
            ahead, behind = (high, low) if side > 0 else (low, high)
            if free == free and not freed and side * (ahead - entry) >= free:
                sl, freed = entry, 1.0
            if tp == tp and side * (ahead - tp) >= 0:
                leave(tp, 0)
                side = 0.0
            elif sl == sl and side * (behind - sl) <= 0:
                leave(sl, 1)
                side = 0.0
        if not side:
            return [0.0, NAN, NAN, NAN, NAN, NAN, 0.0, NAN, NAN, NAN], out
        return [side, entry, since, at, sl, tp, freed, size, unit, width], out

    return step


def balance_step(risk: float, initial: float, per_lot: float, pip: float):
    """One trade: its lot from the balance so far, then the balance after it. Emits lot and profit."""

    def step(state, row):
        move, stop, lot, worth = row
        balance = state[0] if state else initial
        if stop == stop and stop > 0:
            lot = max(0.01, half_away(balance * risk / 100.0 / (stop / pip * per_lot), 2))
            worth = half_away(per_lot * lot, 3) / pip
        return [balance + move * worth], [lot, move * worth]

    return step


_TRADE_COLUMNS = StructType(
    [
        StructField(n, DoubleType())
        for n in ("_reason", "_side", "_since", "entry_pos", "entry_price", "exit_price", "lot", "profit", "_width", "_unit")
    ]
)


def _signal_events(bars, seconds, signal, stop, target, break_even, close_opposite, lot, money_per_point, keys, warmup) -> DataFrame:
    """Closed trades and skipped signals as ``trade_step`` emits them."""
    none = F.lit(None).cast("double")
    held = bars.withColumns(
        {
            "_sig": F.coalesce(signal.cast("double"), F.lit(0.0)),
            "_stop": none if stop is None else stop.cast("double"),
            "_target": none if target is None else target.cast("double"),
            "_free": none if break_even is None else break_even.cast("double"),
            "_opp": (F.lit(close_opposite) if isinstance(close_opposite, bool) else close_opposite).cast("double"),
            "_lot": (F.lit(lot) if isinstance(lot, (int, float)) else lot).cast("double"),
            "_worth": (F.lit(money_per_point) if isinstance(money_per_point, (int, float)) else money_per_point).cast("double"),
            "_now": epoch_seconds("ts").cast("double"),
        }
    )
    laid = lay_out(held, seconds, warmup, keys=keys).add({"_p": F.col(POS).cast("double")})
    inputs = ["high", "low", "close", "_p", "_now", "_sig", "_stop", "_target", "_free", "_opp", "_lot", "_worth"]
    return fold_events(laid, trade_step(), inputs, _TRADE_COLUMNS)


def bar_trades(
    bars: DataFrame,
    seconds: float,
    signal: Column,
    stop: Column | None = None,
    target: Column | None = None,
    break_even: Column | None = None,
    close_opposite: Column | bool = False,
    lot: Column | float = 0.01,
    money_per_point: Column | float = 1.0,
    risk_of_balance: float | None = None,
    initial_balance: float = 5000.0,
    per_lot: float = 10.0,
    pip: float = 1.0,
    keys: Sequence[str] = ("symbol",),
    warmup: int = 1024,
) -> DataFrame:
    """Trades of a signal column (1 buy, -1 sell, else none), one position per key at a time.

    Per bar: close on the opposite signal at the close, else enter at the close when flat, else move the stop to the
    entry, then target, then stop. Distances and sizes are columns, so one pass serves fixed, ATR and swept settings;
    with ``risk_of_balance`` the lot follows the running balance. A position open at the end yields no trade.

    Entries and exits do not depend on the balance, so the pass over the bars leaves it out: its state lives as long as a
    position. The balance then runs over the trades alone, ``BALANCE_ROWS`` of them per task.
    """
    rows = _signal_events(bars, seconds, signal, stop, target, break_even, close_opposite, lot, money_per_point, keys, warmup)
    rows = rows.filter(F.col("_reason") >= 0)
    if risk_of_balance is not None:
        trades = rows.withColumnRenamed(POS, "_exit_pos").withColumn("_move", F.col("_side") * (F.col("exit_price") - F.col("entry_price")))
        # a bar closes at most one trade, so times order the trades of a key
        spread_out = lay_out(materialize(trades), seconds, keys=keys, rows=BALANCE_ROWS)
        money = balance_step(risk_of_balance, initial_balance, per_lot, pip)
        done = fold_columns(spread_out, money, ["_move", "_width", "lot", "_unit"], ["_lot", "_profit"])
        rows = done.core().drop("lot", "profit").withColumnsRenamed({"_lot": "lot", "_profit": "profit", "_exit_pos": POS})
    return _trade_rows(rows, keys)


def skipped_entries(
    bars: DataFrame, seconds: float, signal: Column, stop: Column, target: Column, lot: Column, keys: Sequence[str] = ("symbol",), warmup: int = 1024
) -> DataFrame:
    """Per key how many signals found no position open and were not taken for want of a lot (a missing or zero distance)."""
    events = _signal_events(bars, seconds, signal, stop, target, None, False, lot, 1.0, keys, warmup)
    count = F.count_if(F.col("_reason") == SKIPPED)
    found = events.groupBy(*keys).agg(count.alias("skipped_entries"))
    return bars.select(*keys).distinct().join(found, list(keys), "left").fillna(0, ["skipped_entries"])


_SET_COLUMNS = StructType([StructField("_set", DoubleType()), *_TRADE_COLUMNS.fields[:-2]])


def set_step(settings: Sequence[dict]):
    """``trade_step`` for many settings at once: the sets are the second axis of the state, one bar is one round of array work.

    A setting has ``stop``, ``target``, ``break_even`` (distances, nan: none), ``close_opposite``, ``lot`` (nan: never taken) and
    ``worth`` (money per price unit). Row: high, low, close, position, seconds, signals of all sets.
    """
    stop, target, free, lot, worth = (np.array([p[n] for p in settings], float) for n in ("stop", "target", "break_even", "lot", "worth"))
    opposite, sized = np.array([p["close_opposite"] for p in settings], bool), lot == lot

    def step(state, row):
        high, low, close, pos, now, signals = row
        signals = np.asarray(signals)
        if state:
            side, entry, since, at, freed = np.array(state).reshape(5, -1)
        else:
            side, freed = np.zeros(len(settings)), np.zeros(len(settings))
            entry, since, at = np.full((3, len(settings)), NAN)
        held, wants = side != 0, (signals != 0) & sized
        if state and not held.any() and not wants.any():
            return state, []
        turned = held & opposite & (signals == -side)
        stay, long = held & ~turned, side > 0
        ahead, behind = np.where(long, high, low), np.where(long, low, high)
        freed = np.where(stay & (side * (ahead - entry) >= free), 1.0, freed)
        goal, guard = entry + side * target, np.where(freed > 0, entry, entry - side * stop)
        won = stay & (side * (ahead - goal) >= 0)
        lost = stay & ~won & (side * (behind - guard) <= 0)
        left = turned | won | lost
        out = []
        if left.any():
            price = np.where(turned, close, np.where(won, goal, guard))
            profit = side * (price - entry) * worth
            reason = np.where(turned, np.where(profit < 0, 3.0, 2.0), np.where(won, 0.0, 1.0))
            ids = np.flatnonzero(left)
            out = list(zip(ids.astype(float).tolist(), *(v[ids].tolist() for v in (reason, side, since, at, entry, price, lot, profit))))
        enters = (~held | turned) & wants
        gone = left & ~enters
        side = np.where(enters, signals, np.where(gone, 0.0, side))
        entry, since, at = (np.where(enters, v, np.where(gone, NAN, old)) for v, old in ((close, entry), (now, since), (pos, at)))
        freed = np.where(enters | gone, 0.0, freed)
        return np.concatenate([side, entry, since, at, freed]).tolist(), out

    return step


def set_trades(
    bars: DataFrame, seconds: float, signals: Column, settings: Sequence[dict], keys: Sequence[str] = ("symbol",), warmup: int = 1024
) -> DataFrame:
    """Trades of every setting of ``set_step`` with its number ``param_id``; ``signals`` is an array with one signal per setting.

    The bars are shuffled once and walked once per chunk, however many settings there are; signals are computed after the shuffle.
    """
    laid = lay_out(bars.withColumn("_now", epoch_seconds("ts").cast("double")), seconds, warmup, keys=keys)
    dealt = laid.on(laid.df.repartition(*keys, CHUNK))  # before the signals are there: the walk groups by the same columns
    laid = dealt.add({"_p": F.col(POS).cast("double"), "_signals": signals})
    rows = fold_events(laid, set_step(settings), ["high", "low", "close", "_p", "_now", "_signals"], _SET_COLUMNS)
    return _trade_rows(rows.withColumn("param_id", F.col("_set").cast("int")), (*keys, "param_id"))


def _trade_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(n) for n in EXIT_REASONS])
    return rows.select(
        *keys,
        F.when(F.col("_side") > 0, "buy").otherwise("sell").alias("side"),
        at_seconds(F.col("_since").cast("long")).alias("entry_ts"),
        F.col("entry_pos").cast("long").alias("entry_pos"),
        "entry_price",
        F.col("ts").alias("exit_ts"),
        F.col(POS).alias("exit_pos"),
        "exit_price",
        F.element_at(names, F.col("_reason").cast("int") + 1).alias("exit_reason"),
        (F.col("_reason") >= 2).alias("by_signal"),
        "lot",
        "profit",
    )


def fixed_risk_lot(balance: float, risk_percent: float, stop: Column, pip: float, per_lot: float) -> Column:
    """Lot for a share of a fixed balance, at least 0.01, rounded to two places; null without a stop."""
    pips = stop / pip
    raw = F.lit(balance * risk_percent / 100.0) / F.nullif(pips * per_lot, F.lit(0.0))
    return F.when(stop > 0, F.greatest(F.lit(0.01), F.round(raw, 2)))


def money_per_point(lot: Column, pip: float, per_lot: float) -> Column:
    """Money per price unit of a lot, from the pip value rounded to three places."""
    return F.round(lot * per_lot, 3) / pip


def lagged_trades(
    rows: DataFrame,
    seconds: float,
    long_signal: Column,
    lag: int = 1,
    horizon: int = 5,
    fraction: float = 0.1,
    cost: float = 0.3,
    equity: float = 100000.0,
    keys: Sequence[str] = ("symbol",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long trades entered ``lag`` rows after the signal at the open and left ``horizon`` rows later, overlapping.

    Compounding is a prefix product, so the equity is the exponential of a running sum of logarithms.
    """
    laid = lay_out(rows, seconds, 0, lag + horizon, keys=keys)
    laid = laid.add(
        {
            "entry_price": shift(laid, "open", -lag),
            "exit_price": shift(laid, "open", -(lag + horizon)),
            "entry_ts": shift(laid, "ts", -lag),
            "exit_ts": shift(laid, "ts", -(lag + horizon)),
        }
    )
    taken = long_signal & F.col("exit_price").isNotNull()
    gain = fraction * (F.col("exit_price") - F.col("entry_price") - cost) / F.col("entry_price")
    laid = laid.add({"_taken": F.coalesce(taken, F.lit(False))})
    laid = laid.add({"_gain": F.when(F.col("_taken"), gain).otherwise(F.lit(0.0))})
    laid = prefix_carry(laid, {"_log": ("sum", F.log1p("_gain"))})
    after = F.exp("_log") * equity
    before = F.exp(F.col("_log") - F.log1p("_gain")) * equity
    laid = laid.add({"equity": after, "units": F.when(F.col("_taken"), before * fraction / F.col("entry_price"))})
    laid = laid.add(
        {
            "gross": F.col("units") * (F.col("exit_price") - F.col("entry_price")),
            "cost": F.col("units") * cost,
        }
    )
    out = laid.add({"profit": F.col("gross") - F.col("cost")}).core(keep)
    return out.select(
        *keys, "ts", F.col("_taken").alias("traded"), "entry_ts", "exit_ts", "units", "entry_price", "exit_price", "gross",
        "cost", "profit", "equity", *keep,
    )


def unique_orders(orders: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """First order per ``trade_id``. Partial aggregation keeps many copies of one id from meeting in one task."""
    rest = [c for c in orders.columns if c != "trade_id"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_o")
    return orders.groupBy("trade_id").agg(first).select("trade_id", *[F.col(f"_o.{c}").alias(c) for c in rest])


def fill_orders(
    orders: DataFrame,
    ticks: DataFrame,
    seconds: float,
    slippage: float = 0.0,
    commission_per_lot: float = 0.0,
    entry_spread: float = 0.0,
) -> DataFrame:
    """Exit of every order at the first later tick whose price crosses its target or stop.

    ``orders``: trade_id, symbol, ts, side, volume, price, sl, tp (null or zero: unused). ``ticks``: symbol, ts, seq,
    bid, ask. Buys leave at the bid, sells at the ask, both worsened by the slippage. Orders are independent.
    """
    from tapeline.operators.bars import mid_price

    # the positioned ticks are read by every level of the touch search, so they are written once
    placed = with_positions(ticks.select("symbol", "ts", "seq", "bid", "ask"), seconds, tie=("seq",), total=False)
    placed = materialize(placed.withColumn("_price", mid_price()))
    known = placed.groupBy("symbol", "ts").agg(F.max(POS).alias("start_pos"))
    dated = asof_join(orders, known, ["start_pos"], seconds=seconds)
    buy = F.col("side") == "buy"
    tp, sl = F.nullif(F.col("tp"), F.lit(0.0)), F.nullif(F.col("sl"), F.lit(0.0))
    asked = dated.withColumns(
        {
            "start_pos": F.coalesce("start_pos", F.lit(-1)),
            "_up": F.when(buy, tp).otherwise(sl),
            "_down": F.when(buy, sl).otherwise(tp),
        }
    )
    asked = materialize(asked)
    touched = first_touch(asked, placed, ["trade_id"], "start_pos", "_up", "_down", "_price", "_price", out="exit_pos")
    exits = placed.select(
        "symbol", F.col(POS).alias("exit_pos"), F.col("ts").alias("exit_ts"), "_price", "bid", F.coalesce("ask", "bid").alias("_ask"),
        F.abs(F.coalesce(F.col("ask") - F.col("bid"), F.lit(0.0))).alias("exit_spread"),
    )
    joined = touched.join(exits, ["symbol", "exit_pos"], "left")
    target = F.when(buy, F.col("_price") >= tp).otherwise(F.col("_price") <= tp)
    price = F.when(buy, F.col("bid") - abs(slippage)).otherwise(F.col("_ask") + abs(slippage))
    reason = F.when(F.col("exit_ts").isNull(), None).when(F.coalesce(target, F.lit(False)), "TP").otherwise("SL")
    filled = joined.withColumns({"exit_price": price, "exit_reason": reason})
    costed = fill_profit(filled, commission_per_lot, entry_spread)
    return costed.drop("_up", "_down", "_price", "bid", "_ask")


def fill_profit(fills: DataFrame, commission_per_lot: float, entry_spread: float) -> DataFrame:
    """Gross, commission, spread cost and net profit of fills."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    gross = (F.col("exit_price") - F.col("price")) * F.col("volume") * sign
    spread_cost = (F.lit(abs(entry_spread)) + F.col("exit_spread")) * F.col("volume")
    with_costs = fills.withColumns(
        {"gross": gross, "commission": F.col("volume") * commission_per_lot, "spread_cost": spread_cost}
    )
    return with_costs.withColumn("profit", F.col("gross") - F.col("commission") - F.col("spread_cost"))


def marked_equity(
    fills: DataFrame, ticks: DataFrame, seconds: float, initial_balance: float, entry_spread: float = 0.0
) -> DataFrame:
    """Equity at every tick: balance, closed profit and open profit less open costs.

    Exposure, entry value and costs of the open positions are running sums of changes at entries and exits, so no
    interval is expanded.
    """
    from tapeline.operators.bars import mid_price

    placed = with_positions(ticks, seconds, tie=("seq",)).withColumn("_price", mid_price())
    fills = materialize(fills)
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    signed = F.col("volume") * sign
    costs = F.col("commission") + F.col("volume") * abs(entry_spread)
    zero = F.lit(0.0)
    opened = fills.select(
        "symbol", (F.col("start_pos") + 1).alias(POS), signed.alias("_v"), (signed * F.col("price")).alias("_k"),
        costs.alias("_c"), zero.alias("_r"),
    )
    closed = fills.filter("exit_pos IS NOT NULL").select(
        "symbol", F.col("exit_pos").alias(POS), (-signed).alias("_v"), (-signed * F.col("price")).alias("_k"),
        (-costs).alias("_c"), F.col("profit").alias("_r"),
    )
    moves = opened.unionByName(closed).groupBy("symbol", POS).agg(*[F.sum(c).alias(c) for c in ("_v", "_k", "_c", "_r")])
    joined = placed.join(moves, ["symbol", POS], "left")
    laid = spread(joined, chunk_rows(ticks.sparkSession), 0, 0, ("symbol",))
    laid = prefix_carry(laid, {f"{c}s": ("sum", F.coalesce(F.col(c), zero)) for c in ("_v", "_k", "_c", "_r")})
    equity = F.lit(initial_balance) + F.col("_rs") + F.col("_vs") * F.col("_price") - F.col("_ks") - F.col("_cs")
    return laid.core().select("symbol", "ts", "seq", equity.alias("equity"))


# -- position management ----------------------------------------------------------------------------------------


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """Newest tick per symbol."""
    newest = F.max_by(F.struct("ts", "bid", "ask"), F.struct("ts", "seq")).alias("_t")
    return ticks.groupBy("symbol").agg(newest).select("symbol", F.col("_t.ts").alias("tick_ts"), "_t.bid", "_t.ask")


def position_actions(positions: DataFrame, ticks: DataFrame, at_r: float = 1.0, move_stop: bool = True, halve: bool = True) -> DataFrame:
    """Move the stop to the entry and/or halve once price has gone ``at_r`` times the initial risk."""
    rows = positions.join(latest_ticks(ticks), "symbol", "left")
    buy = F.col("side") == "buy"
    goal = F.col("price") + (F.col("price") - F.col("sl")) * at_r
    price = F.when(buy, F.col("ask")).otherwise(F.col("bid"))
    reached = F.when(buy, price >= goal).otherwise(price <= goal) & (F.col("price") != F.col("sl"))
    moves = F.array_compact(
        F.array(
            F.when(F.lit(move_stop) & reached, "stop_to_entry"),
            F.when(F.lit(halve) & reached & (F.col("volume") != 0.01), "halve"),
        )
    )
    return rows.withColumns({"actions": moves, "new_sl": F.when(F.lit(move_stop) & reached, F.col("price")).otherwise(F.col("sl"))})


def exhaustion_exits(positions: DataFrame, context: DataFrame, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """Positions to close: overbought with a falling smoothed candle, or oversold with a rising one.

    ``context``: newest closed ``rsi`` and Heikin-Ashi ``color`` per symbol.
    """
    buy = F.col("side") == "buy"
    leave = F.when(buy, (F.col("rsi") > high) & (F.col("color") == "short")).otherwise(
        (F.col("rsi") < low) & (F.col("color") == "long")
    )
    return positions.join(context, "symbol", "left").withColumn("close", F.coalesce(leave, F.lit(False)))


# Hours a pending order lives, by the largest timeframe minutes they hold for; longer frames get six hours.
PENDING_HOURS = ((1, 0.5), (3, 1.0), (5, 2.0), (15, 4.0))


def pending_cancellations(orders: DataFrame, ticks: DataFrame, now: Column) -> DataFrame:
    """Reason to cancel pending orders: too old for their timeframe, or price beyond point C."""
    rows = orders.join(latest_ticks(ticks), "symbol", "left")
    hours = F.lit(6.0)
    for minutes, value in reversed(PENDING_HOURS):
        hours = F.when(F.col("tf_minutes") <= minutes, value).otherwise(hours)
    age = epoch_seconds(now) - epoch_seconds("ts")
    beyond = F.when(F.col("side") == "buy", F.col("bid") > F.col("c_price")).otherwise(F.col("ask") < F.col("c_price"))
    return rows.withColumn("cancel", F.when(age > hours * 3600, "expired").when(beyond, "beyond_c"))


def basket_exits(positions: DataFrame, target: float, levels: int, full_side: bool = True) -> DataFrame:
    """Baskets to close: net result at the target, or every level of one side open."""
    net = F.sum(F.col("profit") + F.coalesce("swap", F.lit(0.0)) + F.coalesce("commission", F.lit(0.0)))
    sums = positions.groupBy("basket").agg(
        net.alias("net"), F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells")
    )
    full = F.lit(full_side)
    reason = (
        F.when(F.col("net") >= target, "target")
        .when(full & (F.col("buys") >= levels), "all_buys")
        .when(full & (F.col("sells") >= levels), "all_sells")
    )
    return sums.withColumn("reason", reason).filter("reason IS NOT NULL")
