"""Registered queries: labels, splits, trades, fills, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import labels, metrics, trades
from tapeline.operators import moving_averages as ma
from tapeline.operators.features import build_features
from tapeline.operators.scans import shift
from tapeline.operators.steps import Step, run
from tapeline.plans.catalog.bars_and_features import _ALL_KNOWN, FEATURE_SQL
from tapeline.plans.catalog.common import (
    DAILY_SQL, DAY, daily, ewm_sql, price_ticks, register, rounded, table,
)

_H = (1, 3, 5, 10)
register(
    "labels_future_return",
    lambda s, d: run(daily(s, d), DAY, labels.label_step()).select(
        "symbol", "ts", *[F.round(f"future_return_{h}", 9).alias(f"future_return_{h}") for h in _H], *[f"label_{h}" for h in _H]
    ),
    f"WITH {DAILY_SQL}, r AS (SELECT *, "
    + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS f{h}" for h in _H)
    + " FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)) SELECT symbol, ts, "
    + ", ".join(f"round(f{h}, 9) AS future_return_{h}, CAST(CASE WHEN f{h} > 0 THEN 1 WHEN f{h} IS NOT NULL THEN 0 END AS DOUBLE) AS label_{h}" for h in _H)
    + " FROM r",
)
USABLE_SQL = f"u AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row, count(*) OVER (PARTITION BY symbol) AS rows FROM feats WHERE {_ALL_KNOWN})"


def _usable(s, d):
    return build_features(daily(s, d), DAY).select("symbol", "ts", "close")


_SIZES = """z AS (SELECT *, floor(rows * 0.7::DOUBLE)::BIGINT AS a0, floor(rows * 0.15::DOUBLE)::BIGINT AS a1, rows * 0.7::DOUBLE - floor(rows * 0.7::DOUBLE) AS r0, rows * 0.15::DOUBLE - floor(rows * 0.15::DOUBLE) AS r1 FROM u),
z2 AS (SELECT *, rows - a0 - 2 * a1 AS rest FROM z),
z3 AS (SELECT symbol, ts, row, rows, a0 + CASE WHEN rest >= 1 AND (r0 > r1 OR rest >= 3) THEN 1 ELSE 0 END AS n0,
  a1 + CASE WHEN rest >= CASE WHEN r0 > r1 THEN 3 ELSE 2 END THEN 1 ELSE 0 END AS n1, a1 + CASE WHEN rest >= CASE WHEN r0 > r1 THEN 2 ELSE 1 END THEN 1 ELSE 0 END AS n2 FROM z2)"""


def _split_sql(start: str) -> str:
    return f"""WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL}, {USABLE_SQL}, {_SIZES}, k AS (SELECT *, n0 - 5 AS cut, {start} AS vs FROM z3),
    p AS (SELECT symbol, ts, row, CASE WHEN row < cut THEN 'train' WHEN row >= vs AND row < vs + n1 THEN 'validation' WHEN row >= vs + n1 AND row < vs + n1 + n2 THEN 'test' END AS split FROM k)
    SELECT symbol, ts, row, split FROM p WHERE split IS NOT NULL"""


register(
    "split_time_series",
    lambda s, d: labels.split_time_series(_usable(s, d), DAY, horizon=5).select("symbol", "ts", "row", "split"),
    _split_sql("n0 - 5"),
)
register(
    "split_time_series_gapped",
    lambda s, d: labels.split_time_series(_usable(s, d), DAY, horizon=5, layout="gapped").select("symbol", "ts", "row", "split"),
    _split_sql("n0"),
)
register(
    "split_holdout",
    lambda s, d: labels.split_bounds(labels.holdout_split(_usable(s, d), DAY)),
    f"""WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL}, {USABLE_SQL}, p AS (SELECT *, CASE WHEN row < floor(rows * 0.7::DOUBLE) THEN 'train' WHEN row >= floor(rows * 0.7::DOUBLE) + 65 THEN 'holdout' END AS split FROM u)
    SELECT symbol, split, count(*) AS rows, min(ts) AS start, max(ts) AS "end", min(row) AS first_row, max(row) AS last_row FROM p WHERE split IS NOT NULL GROUP BY symbol, split""",
)
register(
    "split_two_way",
    lambda s, d: labels.split_bounds(labels.two_way_split(daily(s, d), DAY)),
    f"""WITH {DAILY_SQL}, p AS (SELECT symbol, ts, pos AS row, CASE WHEN pos < greatest(1, floor(total * 0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM b)
    SELECT symbol, split, count(*) AS rows, min(ts) AS start, max(ts) AS "end", min(row) AS first_row, max(row) AS last_row FROM p GROUP BY symbol, split""",
)
register(
    "split_walk_forward",
    lambda s, d: labels.walk_forward_folds(daily(s, d), DAY, 400, 100, 100, horizon=5, embargo=3).select("symbol", "ts", "fold", "split"),
    f"""WITH {DAILY_SQL}, f AS (SELECT symbol, unnest(range(0, CAST((any_value(total) - 608) // 100 AS BIGINT) + 1)) AS fold FROM b GROUP BY symbol HAVING any_value(total) >= 608),
    g AS (SELECT symbol, fold, fold * 100 AS s FROM f), j AS (SELECT b.symbol, b.ts, fold, CASE WHEN pos >= s AND pos < s + 395 THEN 'train' WHEN pos >= s + 398 AND pos < s + 498 THEN 'validation'
    WHEN pos >= s + 501 AND pos < s + 601 THEN 'test' END AS split FROM b JOIN g ON b.symbol = g.symbol AND pos >= s AND pos < s + 601)
    SELECT symbol, ts, fold, split FROM j WHERE split IS NOT NULL""",
)
register(
    "split_leakage_check",
    lambda s, d: labels.leakage_check(labels.holdout_split(_usable(s, d), DAY), horizon=5),
    f"WITH {DAILY_SQL} SELECT DISTINCT symbol, true AS in_order, true AS labels_clear FROM b",
)


# -- trades -----------------------------------------------------------------------------------------------------


def crossing(fast: int = 9, slow: int = 21) -> Step:
    """Signal 1 or -1 where EMA(fast) crosses EMA(slow)."""

    def apply(laid):
        laid = laid.add({"_up": F.col("_f") > F.col("_s")})
        prev = shift(laid, "_up")
        cross = F.when(F.col("_up") & ~prev, 1).when(~F.col("_up") & prev, -1).otherwise(0)
        return laid.add({"signal": F.coalesce(cross, F.lit(0))}).drop("_f", "_s", "_up")

    return (ma.ema(fast, out="_f") >> ma.ema(slow, out="_s")) >> Step(apply, 1)


def cross_trades(s, d):
    bars = run(daily(s, d), DAY, crossing())
    return trades.bar_trades(
        bars, DAY, F.col("signal"), F.lit(50000.0), F.lit(100000.0), F.lit(40000.0), close_opposite=True, lot=0.1, money_per_point=0.01
    )


SIGNAL_SQL = f"""{ewm_sql('cf', 'b', 'close', '1 - 2.0 / 10')}, {ewm_sql('cs', 'b', 'close', '1 - 2.0 / 22')},
cu AS (SELECT symbol, pos, cf.v > cs.v AS up FROM cf JOIN cs USING (symbol, pos)),
cl AS (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY pos) AS pu FROM cu),
sg AS MATERIALIZED (SELECT b.*, CASE WHEN up AND NOT pu THEN 1 WHEN NOT up AND pu THEN -1 ELSE 0 END AS sig FROM b JOIN cl USING (symbol, pos))"""


def trades_sql(name: str, source: str, stop: str, target: str, free: str, opposite: str, worth: str) -> str:
    """CTE ``name``: one row per bar with the state after it and, on exits, ``reason`` and trade columns."""
    return f"""
{name} AS (SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS pos, 0 AS side, 0::DOUBLE AS entry, CAST(-1 AS BIGINT) AS opened, 0::DOUBLE AS sl, 0::DOUBLE AS tp, 0 AS freed,
    NULL::INTEGER AS reason, 0 AS t_side, 0::DOUBLE AS t_entry, CAST(-1 AS BIGINT) AS t_at, 0::DOUBLE AS t_exit FROM {source}
  UNION ALL SELECT symbol, pos, CASE WHEN enters THEN sig WHEN opp OR hit IS NOT NULL THEN 0 ELSE side END, CASE WHEN enters THEN close ELSE entry END, CASE WHEN enters THEN pos ELSE opened END,
    CASE WHEN enters THEN close - sig * {stop} ELSE sl2 END, CASE WHEN enters THEN close + sig * {target} ELSE tp END, CASE WHEN enters THEN 0 ELSE freed2 END,
    CASE WHEN opp THEN CASE WHEN side * (close - entry) * {worth} < 0 THEN 3 ELSE 2 END ELSE hit END, side, entry, opened, CASE WHEN opp THEN close WHEN hit = 0 THEN tp ELSE sl2 END
  FROM (SELECT *, CASE WHEN side = 0 OR opp THEN NULL WHEN side * (ahead - tp) >= 0 THEN 0 WHEN side * (behind - sl2) <= 0 THEN 1 END AS hit FROM (
  SELECT *, CASE WHEN side <> 0 AND NOT opp AND freed = 0 AND side * (ahead - entry) >= {free} THEN entry ELSE sl END AS sl2,
    CASE WHEN side <> 0 AND NOT opp AND freed = 0 AND side * (ahead - entry) >= {free} THEN 1 ELSE freed END AS freed2, (side = 0 OR opp) AND sig <> 0 AS enters FROM (
  SELECT s.symbol, s.pos, s.close, s.sig, t.side, t.entry, t.opened, t.sl, t.tp, t.freed, CASE WHEN t.side > 0 THEN s.high ELSE s.low END AS ahead, CASE WHEN t.side > 0 THEN s.low ELSE s.high END AS behind,
    t.side <> 0 AND {opposite} AND s.sig = -t.side AS opp FROM {name} t JOIN {source} s ON s.symbol = t.symbol AND s.pos = t.pos + 1) q) q2) q3),
{name}_t AS MATERIALIZED (SELECT x.symbol, CASE WHEN t_side > 0 THEN 'buy' ELSE 'sell' END AS side, e.ts AS entry_ts, t_at AS entry_pos, t_entry AS entry_price, b.ts AS exit_ts, x.pos AS exit_pos, t_exit AS exit_price,
    CASE reason WHEN 0 THEN 'TP' WHEN 2 THEN 'Manual Close' ELSE 'SL' END AS exit_reason, reason >= 2 AS by_signal, t_side * (t_exit - t_entry) * {worth} AS profit
  FROM {name} x JOIN b ON b.symbol = x.symbol AND b.pos = x.pos JOIN b e ON e.symbol = x.symbol AND e.pos = x.t_at WHERE reason IS NOT NULL)"""


CROSS_TRADES_SQL = f"WITH RECURSIVE {DAILY_SQL}, {SIGNAL_SQL}, {trades_sql('bt', 'sg', '50000', '100000', '40000', 'true', '0.01')}"
register(
    "trades_bar",
    lambda s, d: rounded(
        cross_trades(s, d), 4, "entry_price", "exit_price", "profit",
        plain=("symbol", "side", "entry_ts", "entry_pos", "exit_ts", "exit_pos", "exit_reason", "by_signal", "lot"),
    ),
    f"""{CROSS_TRADES_SQL} SELECT symbol, side, entry_ts, entry_pos, exit_ts, exit_pos, exit_reason, by_signal, 0.1::DOUBLE AS lot, round(entry_price, 4) AS entry_price,
    round(exit_price, 4) AS exit_price, round(profit, 4) AS profit FROM bt_t""",
)


def _atr_trades(s, d):
    from tapeline.operators.oscillators import true_range

    mean = true_range("_tr") >> ma.sma(14, "_tr", "atr")
    bars = run(daily(s, d), DAY, mean, crossing())
    stop = F.col("atr") * 2
    lot = trades.fixed_risk_lot(5000.0, 2.0, stop, 1.0, 0.1)
    return trades.bar_trades(
        bars, DAY, F.col("signal"), stop, F.col("atr") * 3, lot=lot, money_per_point=trades.money_per_point(lot, 1.0, 0.1)
    )


def sized_trades_sql(stop: str, target: str, lot: str) -> str:
    """Trades from ``sg`` without break-even or opposite closes; ``stop``, ``target`` and ``lot`` are taken at the entry."""
    return f"""
rr AS (SELECT DISTINCT symbol, CAST(-1 AS BIGINT) AS pos, 0 AS side, 0::DOUBLE AS entry, CAST(-1 AS BIGINT) AS opened, 0::DOUBLE AS sl, 0::DOUBLE AS tp, 0::DOUBLE AS lot, 5000::DOUBLE AS bal,
    NULL::INTEGER AS reason, 0 AS t_side, 0::DOUBLE AS t_entry, CAST(-1 AS BIGINT) AS t_at, 0::DOUBLE AS t_exit, 0::DOUBLE AS t_lot, 0::DOUBLE AS profit FROM sg
  UNION ALL SELECT symbol, pos, CASE WHEN enters THEN sig WHEN hit IS NOT NULL THEN 0 ELSE side END, CASE WHEN enters THEN close ELSE entry END, CASE WHEN enters THEN pos ELSE opened END,
    CASE WHEN enters THEN close - sig * stp ELSE sl END, CASE WHEN enters THEN close + sig * tgt ELSE tp END, CASE WHEN enters THEN nlot ELSE lot END, bal + coalesce(gain, 0), hit, side, entry, opened, CASE hit WHEN 0 THEN tp ELSE sl END, lot, coalesce(gain, 0)
  FROM (SELECT *, CASE WHEN hit IS NOT NULL THEN side * (CASE hit WHEN 0 THEN tp ELSE sl END - entry) * round(lot * 0.1::DOUBLE, 3) END AS gain FROM (
  SELECT *, side = 0 AND sig <> 0 AND nlot IS NOT NULL AS enters, CASE WHEN side = 0 THEN NULL WHEN side * (ahead - tp) >= 0 THEN 0 WHEN side * (behind - sl) <= 0 THEN 1 END AS hit FROM (
  SELECT s.symbol, s.pos, s.close, s.sig, {stop} AS stp, {target} AS tgt, {lot} AS nlot, t.side, t.entry, t.opened, t.sl, t.tp, t.lot, t.bal, CASE WHEN t.side > 0 THEN s.high ELSE s.low END AS ahead, CASE WHEN t.side > 0 THEN s.low ELSE s.high END AS behind
  FROM rr t JOIN sg s ON s.symbol = t.symbol AND s.pos = t.pos + 1) q) q2) q3)
SELECT x.symbol, CASE WHEN t_side > 0 THEN 'buy' ELSE 'sell' END AS side, t_at AS entry_pos, x.pos AS exit_pos, CASE reason WHEN 0 THEN 'TP' ELSE 'SL' END AS exit_reason, round(t_lot, 4) AS lot, round(t_exit, 4) AS exit_price, round(profit, 4) AS profit FROM rr x WHERE reason IS NOT NULL"""


def _sized(done):
    return rounded(done, 4, "lot", "exit_price", "profit", plain=("symbol", "side", "entry_pos", "exit_pos", "exit_reason"))


_ATR_SQL = SIGNAL_SQL.replace(
    "sg AS MATERIALIZED (SELECT b.*,",
    "ap AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS pc FROM b), at14 AS (SELECT symbol, pos, CASE WHEN pos >= 13 THEN avg(CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END) "
    "OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM ap),\nsg AS MATERIALIZED (SELECT b.*, at14.atr,",
).replace("FROM b JOIN cl USING (symbol, pos)", "FROM b JOIN cl USING (symbol, pos) JOIN at14 USING (symbol, pos)")
register(
    "trades_bar_atr",
    lambda s, d: _sized(_atr_trades(s, d)),
    f"WITH RECURSIVE {DAILY_SQL}, {_ATR_SQL}, {sized_trades_sql('2 * s.atr', '3 * s.atr', 'CASE WHEN s.atr > 0 THEN greatest(0.01, round(100 / (2 * s.atr * 0.1::DOUBLE), 2)) END')}",
)


def _skipped(s, d):
    """Signals before the mean range of 200 days is known find no lot."""
    from tapeline.operators.oscillators import true_range

    bars = run(daily(s, d), DAY, true_range("_tr") >> ma.sma(200, "_tr", "atr"), crossing())
    lot = trades.fixed_risk_lot(5000.0, 2.0, F.col("atr") * 2, 1.0, 0.1)
    return trades.skipped_entries(bars, DAY, F.col("signal"), F.col("atr") * 2, F.col("atr") * 3, lot)


register(
    "trades_skipped_entries",
    _skipped,
    f"WITH RECURSIVE {DAILY_SQL}, {SIGNAL_SQL} SELECT symbol, count(*) FILTER (sig <> 0 AND pos < 199) AS skipped_entries FROM sg GROUP BY 1",
)
register(
    "trades_bar_running_risk",
    lambda s, d: _sized(
        trades.bar_trades(
            run(daily(s, d), DAY, crossing()), DAY, F.col("signal"), F.lit(50000.0), F.lit(100000.0), risk_of_balance=2.0, per_lot=0.1
        )
    ),
    f"WITH RECURSIVE {DAILY_SQL}, {SIGNAL_SQL}, {sized_trades_sql('50000', '100000', 'greatest(0.01, round(t.bal * 2.0::DOUBLE / 100 / (50000 * 0.1::DOUBLE), 2))')}",
)


def lagged(s, d):
    bars = run(daily(s, d), DAY, ma.sma(10))
    return trades.lagged_trades(bars, DAY, F.col("close") > F.col("sma"), fraction=0.002, cost=30.0)


LAGGED_SQL = f"""WITH {DAILY_SQL}, a AS (SELECT *, CASE WHEN pos >= 9 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS m FROM b),
l AS (SELECT *, lead(open, 1) OVER w AS ep, lead(open, 6) OVER w AS xp, lead(ts, 1) OVER w AS et, lead(ts, 6) OVER w AS xt FROM a WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
g AS (SELECT *, coalesce(close > m AND xp IS NOT NULL, false) AS traded, CASE WHEN close > m AND xp IS NOT NULL THEN ln(1 + 0.002 * (xp - ep - 30) / ep) ELSE 0 END AS lg FROM l),
e AS (SELECT *, 100000 * exp(sum(lg) OVER (PARTITION BY symbol ORDER BY pos)) AS equity FROM g),
lt AS MATERIALIZED (SELECT *, CASE WHEN traded THEN equity / exp(lg) * 0.002 / ep END AS units FROM e)"""
register(
    "trades_lagged",
    lambda s, d: rounded(lagged(s, d), 3, "profit", "equity", plain=("symbol", "ts", "traded", "entry_ts", "exit_ts", "entry_price", "exit_price")),
    f"""{LAGGED_SQL} SELECT symbol, ts, traded, et AS entry_ts, xt AS exit_ts, ep AS entry_price, xp AS exit_price, round(units * (xp - ep) - units * 30, 3) AS profit, round(equity, 3) AS equity FROM lt""",
)


# -- fills: every tick of the events table is also an order with barriers around its price -----------------------


def example_orders(s, d):
    """Each tick as an order at its price, 60 below and 90 above in its direction."""
    ticks = price_ticks(s, d)
    side = F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell")
    sign = F.when(F.col("seq") % 2 == 0, 1.0).otherwise(-1.0)
    return ticks.select(
        F.concat(F.lit("t"), F.col("seq")).alias("trade_id"), "symbol", "ts", side.alias("side"), F.lit(0.5).alias("volume"), "price",
        (F.col("price") - sign * 60).alias("sl"), (F.col("price") + sign * 90).alias("tp"), F.lit("band").alias("strategy"), F.lit(7).cast("long").alias("magic"),
    )


def quoted_ticks(s, d):
    ticks = price_ticks(s, d)
    return ticks.select("symbol", "ts", "seq", (F.col("price") - 0.05).alias("bid"), (F.col("price") + 0.05).alias("ask"))


FILL_SQL = """
tk AS MATERIALIZED (SELECT event_type AS symbol, ts, event_id AS seq, value - 0.05 AS bid, value + 0.05 AS ask, (value - 0.05 + (value + 0.05)) / 2 AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events WHERE value > 0),
od AS MATERIALIZED (SELECT 't' || event_id AS trade_id, event_type AS symbol, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sign, value AS price, 0.5 AS volume FROM events WHERE value > 0),
of AS (SELECT o.*, t.pos AS start_pos FROM od o JOIN tk t ON o.symbol = t.symbol AND o.ts = t.ts),
tx AS (SELECT o.trade_id, min(t.pos) AS exit_pos FROM of o JOIN tk t ON t.symbol = o.symbol AND t.pos > o.start_pos AND (sign * (t.price - (o.price + sign * 90)) >= 0 OR sign * (t.price - (o.price - sign * 60)) <= 0) GROUP BY 1),
fl AS MATERIALIZED (SELECT o.*, x.exit_pos, t.ts AS exit_ts, CASE WHEN t.ts IS NULL THEN NULL WHEN sign * (t.price - (o.price + sign * 90)) >= 0 THEN 'TP' ELSE 'SL' END AS exit_reason,
  CASE WHEN sign > 0 THEN t.bid - 0.02 ELSE t.ask + 0.02 END AS exit_price, abs(t.ask - t.bid) AS exit_spread FROM of o LEFT JOIN tx x USING (trade_id) LEFT JOIN tk t ON t.symbol = o.symbol AND t.pos = x.exit_pos),
fp AS MATERIALIZED (SELECT *, (exit_price - price) * volume * sign AS gross, volume * 0.7 AS commission, (0.1 + exit_spread) * volume AS spread_cost,
  (exit_price - price) * volume * sign - volume * 0.7 - (0.1 + exit_spread) * volume AS profit FROM fl)"""


def fills(s, d):
    return trades.fill_orders(example_orders(s, d), quoted_ticks(s, d), 300, slippage=0.02, commission_per_lot=0.7, entry_spread=0.1)


register(
    "fills_first_touch",
    lambda s, d: rounded(
        fills(s, d), 6, "exit_price", "gross", "commission", "spread_cost", "profit",
        plain=("trade_id", "symbol", "side", "start_pos", "exit_pos", "exit_ts", "exit_reason"),
    ),
    f"""WITH {FILL_SQL} SELECT trade_id, symbol, CASE WHEN sign > 0 THEN 'buy' ELSE 'sell' END AS side, start_pos, exit_pos, exit_ts, exit_reason, round(exit_price, 6) AS exit_price,
    round(gross, 6) AS gross, round(commission, 6) AS commission, round(spread_cost, 6) AS spread_cost, round(profit, 6) AS profit FROM fp""",
)
register(
    "fills_marked_equity",
    lambda s, d: rounded(
        trades.marked_equity(fills(s, d), quoted_ticks(s, d), 300, 10000.0, 0.1), 5, "equity", plain=("symbol", "ts", "seq")
    ),
    f"""WITH {FILL_SQL}, mv AS (SELECT symbol, start_pos + 1 AS pos, sign * volume AS v, sign * volume * price AS k, commission + volume * 0.1 AS c, 0 AS r FROM fp
    UNION ALL SELECT symbol, exit_pos, -sign * volume, -sign * volume * price, -(commission + volume * 0.1), profit FROM fp WHERE exit_pos IS NOT NULL),
    ma AS (SELECT symbol, pos, sum(v) AS v, sum(k) AS k, sum(c) AS c, sum(r) AS r FROM mv GROUP BY 1, 2), j AS (SELECT t.symbol, t.ts, t.seq, t.pos, t.price, v, k, c, r FROM tk t LEFT JOIN ma USING (symbol, pos))
    SELECT symbol, ts, seq, round(10000 + coalesce(sum(r) OVER w, 0) + coalesce(sum(v) OVER w, 0) * price - coalesce(sum(k) OVER w, 0) - coalesce(sum(c) OVER w, 0), 5) AS equity FROM j WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
)


def _copied_orders(s, d):
    """Orders keyed by customer, so that an id occurs many times."""
    o = table(s, d, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("trade_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"),
    )


register(
    "orders_idempotent",
    lambda s, d: trades.unique_orders(_copied_orders(s, d), ("ts", "seq")),
    """SELECT CAST(o_custkey AS VARCHAR) AS trade_id, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS symbol, min(o_orderdate) AS ts,
    arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS price, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS seq FROM orders GROUP BY o_custkey""",
)


def _positions(s, d):
    """Orders still open at the end of the ticks."""
    return fills(s, d).filter("exit_pos IS NULL")


_LAST_TICK = "lt AS (SELECT symbol, arg_max(bid, pos) AS bid, arg_max(ask, pos) AS ask FROM tk GROUP BY 1)"
register(
    "position_actions",
    lambda s, d: trades.position_actions(_positions(s, d), quoted_ticks(s, d), at_r=0.5).select(
        "trade_id", F.array_join("actions", ",").alias("actions"), F.round("new_sl", 6).alias("new_sl")
    ),
    f"""WITH {FILL_SQL}, {_LAST_TICK}, q AS (SELECT f.*, CASE WHEN sign > 0 THEN ask >= price + sign * 60 * 0.5 ELSE bid <= price + sign * 60 * 0.5 END AS hit FROM fp f JOIN lt USING (symbol) WHERE exit_pos IS NULL)
    SELECT trade_id, CASE WHEN hit THEN 'stop_to_entry,halve' ELSE '' END AS actions, round(CASE WHEN hit THEN price ELSE price - sign * 60 END, 6) AS new_sl FROM q""",
)
register(
    "pending_cancellations",
    lambda s, d: trades.pending_cancellations(
        example_orders(s, d).withColumns({"tf_minutes": F.lit(15), "c_price": F.col("price") + F.when(F.col("side") == "buy", 40).otherwise(-40)}),
        quoted_ticks(s, d),
        F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")),
    ).select("trade_id", "cancel"),
    f"""WITH {FILL_SQL}, {_LAST_TICK} SELECT trade_id, CASE WHEN epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) > 14400 THEN 'expired'
    WHEN sign > 0 AND bid > price + 40 THEN 'beyond_c' WHEN sign < 0 AND ask < price - 40 THEN 'beyond_c' END AS cancel FROM od JOIN lt USING (symbol)""",
)
register(
    "basket_exits",
    lambda s, d: trades.basket_exits(
        table(s, d, "lineitem").select(
            F.col("l_suppkey").alias("basket"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("profit"), F.col("l_tax").alias("swap"),
            F.lit(0.0).alias("commission"), F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"),
        ), 5000.0, 300,
    ).select("basket", F.round("net", 3).alias("net"), "buys", "sells", "reason"),
    """WITH s AS (SELECT l_suppkey AS basket, sum(l_extendedprice * (l_discount - 0.05::DOUBLE) + l_tax) AS net, count(*) FILTER (l_linenumber % 2 = 0) AS buys, count(*) FILTER (l_linenumber % 2 <> 0) AS sells FROM lineitem GROUP BY 1),
    r AS (SELECT *, CASE WHEN net >= 5000 THEN 'target' WHEN buys >= 300 THEN 'all_buys' WHEN sells >= 300 THEN 'all_sells' END AS reason FROM s)
    SELECT basket, round(net, 3) AS net, buys, sells, reason FROM r WHERE reason IS NOT NULL""",
)

# -- metrics ----------------------------------------------------------------------------------------------------

_METRICS = ["gross_profit", "gross_loss", "net_profit", "expectancy", "average_win", "average_loss", "win_rate", "profit_factor", "sharpe", "sortino"]
METRIC_SQL = """count(*) AS trades, count(*) FILTER (profit > 0) AS wins, count(*) FILTER (profit < 0) AS losses, round(coalesce(sum(profit) FILTER (profit > 0), 0), 4) AS gross_profit,
round(coalesce(-sum(profit) FILTER (profit < 0), 0), 4) AS gross_loss, round(sum(profit), 4) AS net_profit, round(avg(profit), 4) AS expectancy, round(coalesce(avg(profit) FILTER (profit > 0), 0), 4) AS average_win,
round(coalesce(avg(profit) FILTER (profit < 0), 0), 4) AS average_loss, round(count(*) FILTER (profit > 0) * 100.0 / count(*), 4) AS win_rate,
round(CASE WHEN coalesce(-sum(profit) FILTER (profit < 0), 0) > 0 THEN coalesce(sum(profit) FILTER (profit > 0), 0) / -sum(profit) FILTER (profit < 0) ELSE 0 END, 4) AS profit_factor,
round(coalesce(avg(profit) / nullif(stddev_samp(profit), 0) * sqrt(252), 0), 4) AS sharpe, round(coalesce(avg(profit) / nullif(sqrt(avg(least(profit, 0) ** 2)), 0) * sqrt(252), 0), 4) AS sortino"""
register(
    "metrics_trades",
    lambda s, d: rounded(metrics.trade_metrics(cross_trades(s, d)), 4, *_METRICS, plain=("symbol", "trades", "wins", "losses")),
    f"{CROSS_TRADES_SQL} SELECT symbol, {METRIC_SQL} FROM bt_t GROUP BY symbol",
)


def deals_as_trades(s, d):
    """Line items as closed deals: symbol is the return flag, closed at the ship date."""
    return table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("exit_ts"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("entry_ts"),
        F.col("l_orderkey").alias("position_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("profit"),
    )


DEALS_SQL = "dl AS MATERIALIZED (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_orderkey AS position_id, l_linenumber AS line, l_partkey AS part, l_extendedprice * (l_discount - 0.05::DOUBLE) AS profit FROM lineitem)"
register(
    "metrics_deals",
    lambda s, d: rounded(metrics.trade_metrics(deals_as_trades(s, d)), 4, *_METRICS, plain=("symbol", "trades", "wins", "losses")),
    f"WITH {DEALS_SQL} SELECT symbol, {METRIC_SQL} FROM dl GROUP BY symbol",
)
BALANCE_SQL = "bc AS MATERIALIZED (SELECT symbol, exit_ts, exit_pos, profit, 5000 + sum(profit) OVER (PARTITION BY symbol ORDER BY exit_pos) AS balance FROM bt_t)"
register(
    "metrics_balance_curve",
    lambda s, d: rounded(metrics.balance_curve(cross_trades(s, d), DAY, 5000.0), 4, "balance", plain=("symbol", "exit_ts")),
    f"{CROSS_TRADES_SQL}, {BALANCE_SQL} SELECT symbol, exit_ts, round(balance, 4) AS balance FROM bc",
)
_DD = ["max_drawdown", "max_drawdown_percent", "peak", "trough", "percent_of_final_peak", "max_percent"]


def _drawdown_sql(source: str, value: str, order: str, initial: float) -> str:
    return f"""d1 AS (SELECT *, greatest({initial}, max({value}) OVER (PARTITION BY symbol ORDER BY {order})) AS pk FROM {source}), d2 AS (SELECT *, pk - {value} AS fall FROM d1),
    d3 AS (SELECT symbol, max(fall) AS mx, max(pk) AS fin, max(fall / pk) * 100 AS mp FROM d2 GROUP BY 1), d4 AS (SELECT symbol, arg_min(pk, {order}) AS pk, arg_min({value}, {order}) AS v FROM d2 JOIN d3 USING (symbol) WHERE fall = mx GROUP BY 1)
    SELECT symbol, round(mx, 4) AS max_drawdown, round(mx / pk * 100, 4) AS max_drawdown_percent, round(pk, 4) AS peak, round(CASE WHEN mx > 0 THEN v ELSE pk END, 4) AS trough,
    round(mx / fin * 100, 4) AS percent_of_final_peak, round(mp, 4) AS max_percent FROM d3 JOIN d4 USING (symbol)"""


register(
    "metrics_max_drawdown",
    lambda s, d: rounded(
        metrics.max_drawdown(metrics.balance_curve(cross_trades(s, d), DAY, 5000.0), DAY, "balance", ts="exit_ts", initial=5000.0), 4, *_DD, plain=("symbol",)
    ),
    f"{CROSS_TRADES_SQL}, {BALANCE_SQL}, {_drawdown_sql('bc', 'balance', 'exit_pos', 5000.0)}",
)
register(
    "metrics_equity_drawdown",
    lambda s, d: rounded(metrics.max_drawdown(lagged(s, d), DAY, "equity", initial=100000.0), 3, *_DD, plain=("symbol",)),
    f"{LAGGED_SQL}, {_drawdown_sql('lt', 'equity', 'pos', 100000.0)}".replace(", 4) AS", ", 3) AS"),
)
register(
    "metrics_daily_drawdown",
    lambda s, d: rounded(
        metrics.worst_daily_drawdown(daily(s, d), cross_trades(s, d), DAY, 5000.0, 0.01), 4, "max_daily_drawdown", "max_daily_drawdown_percent", plain=("symbol",)
    ),
    f"""{CROSS_TRADES_SQL}, {BALANCE_SQL}, m AS (SELECT b.symbol, b.ts, b.pos, 5000 + coalesce(sum(t.profit) FILTER (t.exit_pos < b.pos), 0) AS bal FROM b LEFT JOIN bt_t t ON t.symbol = b.symbol AND t.exit_pos < b.pos GROUP BY 1, 2, 3),
    q AS (SELECT m.*, bal + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (b.close - entry_price) * 0.01 AS eq FROM m JOIN b USING (symbol, pos) LEFT JOIN bt_t t ON t.symbol = m.symbol AND t.entry_pos < m.pos AND (m.pos < t.exit_pos OR (m.pos = t.exit_pos AND NOT by_signal))),
    f AS (SELECT symbol, pos, bal, greatest(coalesce(bal - eq, 0), 0) AS fall FROM q), w AS (SELECT symbol, max(fall) AS mx FROM f GROUP BY 1)
    SELECT symbol, round(mx, 4) AS max_daily_drawdown, round(arg_min(CASE WHEN fall = mx THEN fall / bal * 100 END, CASE WHEN fall = mx THEN pos END), 4) AS max_daily_drawdown_percent FROM f JOIN w USING (symbol) GROUP BY symbol, mx""",
)
register(
    "metrics_streaks",
    lambda s, d: metrics.streaks(cross_trades(s, d), DAY),
    f"""{CROSS_TRADES_SQL}, k AS (SELECT symbol, exit_pos, CASE WHEN exit_reason = 'SL' AND profit < 0 THEN 'sl' WHEN exit_reason = 'TP' THEN 'tp' WHEN exit_reason = 'Manual Close' THEN 'm' END AS kind FROM bt_t),
    n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_pos) - row_number() OVER (PARTITION BY symbol, kind ORDER BY exit_pos) AS isl FROM k WHERE kind IS NOT NULL),
    r AS (SELECT symbol, kind, count(*) AS c FROM n GROUP BY symbol, kind, isl)
    SELECT symbol, coalesce(max(c) FILTER (kind = 'sl'), 0) AS max_consecutive_sl, coalesce(max(c) FILTER (kind = 'tp'), 0) AS max_consecutive_tp FROM r GROUP BY symbol""",
)
_REPORT = ["win_rate_no_breakeven", "average_lot", "roi", "final_balance", "sharpe_pop"]
register(
    "metrics_backtest_report",
    lambda s, d: rounded(metrics.backtest_report(cross_trades(s, d), 5000.0), 4, *_REPORT, plain=("symbol", "trades", "breakeven", "tp", "sl", "manual")),
    f"""{CROSS_TRADES_SQL} SELECT symbol, count(*) AS trades, count(*) FILTER (profit = 0) AS breakeven, count(*) FILTER (exit_reason = 'TP') AS tp, count(*) FILTER (exit_reason = 'SL' AND profit < 0) AS sl,
    count(*) FILTER (exit_reason = 'Manual Close') AS manual, round(count(*) FILTER (profit > 0) * 100.0 / count(*) FILTER (profit <> 0), 4) AS win_rate_no_breakeven, 0.1::DOUBLE AS average_lot,
    round(sum(profit) / 5000 * 100, 4) AS roi, round(sum(profit) + 5000, 4) AS final_balance, round(avg(profit) / stddev_pop(profit) * sqrt(252), 4) AS sharpe_pop FROM bt_t GROUP BY symbol""",
)
register(
    "metrics_by_weekday",
    lambda s, d: rounded(metrics.profit_by_weekday(deals_as_trades(s, d)), 4, "profit", plain=("symbol", "weekday", "trades")),
    f"""WITH {DEALS_SQL}, d AS (SELECT DISTINCT symbol, unnest(range(0, 7)) AS weekday FROM dl), g AS (SELECT symbol, isodow(ts) - 1 AS weekday, sum(profit) AS p, count(*) AS n FROM dl GROUP BY 1, 2)
    SELECT symbol, CAST(weekday AS INTEGER) AS weekday, coalesce(n, 0) AS trades, round(coalesce(p, 0), 4) AS profit FROM d LEFT JOIN g USING (symbol, weekday)""",
)


def _tick_trades(s, d):
    """Each tick as a closed trade whose profit is its distance from 50."""
    return price_ticks(s, d).select("symbol", F.col("ts").alias("entry_ts"), (F.col("price") - 50).alias("profit"))


register(
    "metrics_by_session",
    lambda s, d: rounded(metrics.profit_by_session(_tick_trades(s, d), 4.0), 4, "profit", plain=("symbol", "session", "trades", "is_best", "is_worst")),
    """WITH st AS (SELECT h * 60 + m AS s FROM (SELECT unnest(range(0, 24)) AS h) a, (SELECT unnest([0, 30]) AS m) b WHERE (m = 0 OR h < 23) AND h * 60 + m + 240 <= 1440),
    t AS (SELECT event_type AS symbol, hour(ts) * 60 + minute(ts) AS m, value - 50 AS profit FROM events WHERE value > 0), y AS (SELECT DISTINCT symbol FROM t),
    g AS (SELECT y.symbol, s, coalesce(sum(profit), 0) AS p, count(profit) AS n FROM y JOIN st ON true LEFT JOIN t ON t.symbol = y.symbol AND t.m >= s AND t.m < s + 240 GROUP BY 1, 2)
    SELECT symbol, printf('%02d:%02d-%02d:%02d', s // 60, s % 60, (s + 240) // 60, (s + 240) % 60) AS session, n AS trades, round(p, 4) AS profit,
    row_number() OVER (PARTITION BY symbol ORDER BY p DESC, s) = 1 AS is_best, row_number() OVER (PARTITION BY symbol ORDER BY p, s) = 1 AS is_worst FROM g""",
)
