"""Registered queries: dataset quality, deals, risk gate, lifecycle, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import sizing
from tapeline.operators import ledger, quality
from tapeline.operators import moving_averages as ma
from tapeline.operators.features import build_features, feature_names
from tapeline.operators.labels import label_step
from tapeline.operators.steps import run
from tapeline.plans.catalog.common import DAILY_SQL, DAY, HOURLY_SQL, daily, hourly, order_ticks, price_ticks, register, rounded, table
from tapeline.plans.catalog.trading import FILL_SQL, example_orders, fills, quoted_ticks

# -- quality ----------------------------------------------------------------------------------------------------


def _raw_bars(s, d):
    """Events as bars with defects: zero prices and highs below the open occur in the data."""
    v = F.col("value")
    return table(s, d, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), v.alias("open"), (v * 1.01).alias("high"),
        (v - 0.02).alias("low"), F.when(F.col("event_id") % 97 == 0, v * 1.02).otherwise(v).alias("close"),
    )


register(
    "quality_violations",
    lambda s, d: quality.validate_bars(_raw_bars(s, d))[1].select("symbol", "ts", F.array_join("violations", ", ").alias("violations")),
    """WITH r AS (SELECT event_type AS symbol, ts, value AS o, value * 1.01::DOUBLE AS h, value - 0.02::DOUBLE AS l, CASE WHEN event_id % 97 = 0 THEN value * 1.02::DOUBLE ELSE value END AS c FROM events),
    v AS (SELECT symbol, ts, concat_ws(', ', CASE WHEN o <= 0 THEN 'open not positive' END, CASE WHEN h <= 0 THEN 'high not positive' END, CASE WHEN l <= 0 THEN 'low not positive' END, CASE WHEN c <= 0 THEN 'close not positive' END,
    CASE WHEN h < greatest(o, c, l) THEN 'high too low' END, CASE WHEN l > least(o, c, h) THEN 'low too high' END) AS violations FROM r) SELECT * FROM v WHERE violations <> ''""",
)
register(
    "quality_valid_rows",
    lambda s, d: quality.validate_bars(_raw_bars(s, d))[0].groupBy("symbol").agg(F.count("*").alias("rows")),
    """WITH r AS (SELECT event_type AS symbol, value AS o, value * 1.01::DOUBLE AS h, value - 0.02::DOUBLE AS l, CASE WHEN event_id % 97 = 0 THEN value * 1.02::DOUBLE ELSE value END AS c FROM events)
    SELECT symbol, count(*) AS rows FROM r WHERE l > 0 AND h >= greatest(o, c, l) GROUP BY 1""",
)
for _policy, _arg in (("first", "arg_min"), ("last", "arg_max")):
    register(
        f"quality_dedupe_{_policy}",
        lambda s, d, p=_policy: quality.dedupe(order_ticks(s, d), p),
        f"""SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, {_arg}(o_totalprice, o_orderkey) AS price, {_arg}(o_orderkey, o_orderkey) AS seq FROM orders GROUP BY 1, 2""",
    )
register(
    "quality_duplicates",
    lambda s, d: quality.duplicates(order_ticks(s, d)),
    "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, count(*) AS copies FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
)
register(
    "quality_summary",
    lambda s, d: quality.dataset_summary(daily(s, d), "1d", "orders"),
    f"""WITH {DAILY_SQL} SELECT symbol, min(ts) AS start, max(ts) AS "end", count(*) AS row_count, '1d' AS timeframe, 'orders' AS source, 'UTC' AS timezone, '1' AS version, 'volume' AS volume_type, 'reject' AS duplicate_policy FROM b GROUP BY 1""",
)
register("quality_content_hash", lambda s, d: quality.content_hash(daily(s, d), "daily"))
register(
    "quality_order_violations",
    lambda s, d: quality.order_violations(order_ticks(s, d)).select("symbol", "seq", "ts", "previous_ts"),
    """WITH l AS (SELECT o_orderpriority AS symbol, o_orderkey AS seq, CAST(o_orderdate AS TIMESTAMP) AS ts, lag(CAST(o_orderdate AS TIMESTAMP)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS previous_ts FROM orders)
    SELECT symbol, seq, ts, previous_ts FROM l WHERE previous_ts >= ts""",
)
register(
    "quality_align",
    lambda s, d: quality.align(
        run(daily(s, d), DAY, ma.sma(10)).select("symbol", "ts", F.round("sma", 4).alias("sma")),
        run(daily(s, d), DAY, label_step((5,))).select("symbol", "ts", "label_5"),
    ),
    f"""WITH {DAILY_SQL} SELECT symbol, ts, round(CASE WHEN pos >= 9 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 4) AS sma,
    CAST(CASE WHEN lead(close, 5) OVER w > close THEN 1 WHEN lead(close, 5) OVER w IS NOT NULL THEN 0 END AS DOUBLE) AS label_5 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
)
register(
    "quality_output_checks",
    lambda s, d: quality.output_checks(build_features(daily(s, d), DAY), feature_names()),
    "SELECT 0::BIGINT AS infinite_values, count(*) FILTER (n > 1) AS duplicate_times, 0 AS not_numeric FROM (SELECT o_orderpriority, o_orderdate::DATE AS d, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1, 2)",
)
register(
    "quality_mixed_timestamps",
    lambda s, d: quality.normalize_ts(
        table(s, d, "events").select(
            "event_id",
            F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy.MM.dd HH:mm:ss"))
            .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("ts"),
        )
    ),
    "SELECT event_id, date_trunc('second', ts) AS ts, CAST(NULL AS VARCHAR) AS ts_problem FROM events",
)

# -- deals ------------------------------------------------------------------------------------------------------


def deals(s, d):
    """Line items as deals: position is the order, comment the return flag, costs from the tax."""
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("position_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_returnflag").alias("comment"),
        F.col("l_linestatus").alias("type"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("profit"), F.col("l_tax").alias("commission"), F.lit(0.0).alias("swap"), F.lit(0.0).alias("fee"),
    )


DEAL_SQL = """d AS MATERIALIZED (SELECT l_orderkey AS position_id, CAST(l_shipdate AS TIMESTAMP) AS ts, l_returnflag AS comment, l_linestatus AS type, l_linenumber AS line, l_partkey AS part,
  l_extendedprice * (l_discount - 0.05::DOUBLE) AS profit, l_tax AS commission FROM lineitem)"""
_DAY0, _DAY1 = "1998-01-01", "1999-01-01"


def _stamp(text):
    return F.lit(text).cast("timestamp_ntz")


register(
    "deals_in_range",
    lambda s, d: rounded(ledger.result_counts(ledger.in_range(deals(s, d), _stamp(_DAY0), _stamp(_DAY1)), ["comment"]), 4, "profit", plain=("comment", "losses", "wins")),
    f"""WITH {DEAL_SQL} SELECT comment, count(*) FILTER (profit < 0) AS losses, count(*) FILTER (profit > 0) AS wins, round(sum(profit), 4) AS profit FROM d WHERE ts >= '{_DAY0}' AND ts < '{_DAY1}' GROUP BY 1""",
)
register(
    "deals_of_comment",
    lambda s, d: rounded(ledger.result_counts(ledger.of_positions(deals(s, d), "R", types=["F", "O"])), 4, "profit", plain=("losses", "wins")),
    f"""WITH {DEAL_SQL} SELECT count(*) FILTER (profit < 0) AS losses, count(*) FILTER (profit > 0) AS wins, round(sum(profit), 4) AS profit FROM d
    WHERE position_id IN (SELECT position_id FROM d WHERE comment = 'R' AND type IN ('F', 'O'))""",
)
register(
    "deals_barrier_exits",
    lambda s, d: ledger.barrier_exits(deals(s, d), "R", "a", fold_case=True),
    f"WITH {DEAL_SQL} SELECT count(*) FILTER (lower(comment) LIKE '%a%') AS exits FROM d WHERE position_id IN (SELECT position_id FROM d WHERE comment = 'R')",
)
register(
    "deals_in_session",
    lambda s, d: ledger.in_session(price_ticks(s, d), "London", "2024-01-10").groupBy("symbol").agg(F.count("*").alias("ticks")),
    "SELECT event_type AS symbol, count(*) AS ticks FROM events WHERE value > 0 AND ts BETWEEN TIMESTAMP '2024-01-10 08:00:00' AND TIMESTAMP '2024-01-10 17:00:00' GROUP BY 1",
)
register(
    "deals_losses_between_hours",
    lambda s, d: ledger.losses_between_hours(deals(s, d), "A", "1998-03-02", 0, 23),
    f"""WITH {DEAL_SQL}, h AS (SELECT * FROM d WHERE ts BETWEEN TIMESTAMP '1998-03-02 00:00:00' AND TIMESTAMP '1998-03-02 23:00:00')
    SELECT count(*) FILTER (profit < 0) AS losses FROM h WHERE position_id IN (SELECT position_id FROM h WHERE comment = 'A')""",
)
register(
    "deals_loss_streak",
    lambda s, d: ledger.loss_streak(deals(s, d), ["part"], ("ts", "position_id", "line")),
    f"""WITH {DEAL_SQL}, w AS (SELECT part, max((ts, position_id, line)) FILTER (profit > 0) AS lw FROM d GROUP BY 1)
    SELECT part, count(*) FILTER (profit < 0 AND (lw IS NULL OR (ts, position_id, line) > lw)) AS streak FROM d JOIN w USING (part) GROUP BY 1""",
)


def _open_positions(s, d):
    return fills(s, d).filter("exit_pos IS NULL").withColumns({"profit": F.col("price") * 0 + 1.5, "swap": F.lit(0.25)})


register(
    "deals_profit_and_loss",
    lambda s, d: ledger.profit_and_loss(ledger.in_range(deals(s, d), _stamp(_DAY0), _stamp(_DAY1)), _open_positions(s, d)),
    f"""WITH {DEAL_SQL}, {FILL_SQL} SELECT round((SELECT sum(profit + commission) FROM d WHERE ts >= '{_DAY0}' AND ts < '{_DAY1}') + 1.75 * (SELECT count(*) FROM fp WHERE exit_pos IS NULL), 2) AS pnl,
    (SELECT count(*) FROM fp WHERE exit_pos IS NULL) AS open_positions""",
)
register(
    "risk_drawdown_flags",
    lambda s, d: ledger.drawdown_flags(
        table(s, d, "customer").select(
            "c_custkey", F.lit(5000.0).alias("start_balance"), (F.col("c_acctbal") - 400).alias("pnl"), F.lit(5000.0).alias("balance"), F.col("c_acctbal").alias("equity")
        ), 5.0, 12.0,
    ).select("c_custkey", "daily_breach", "total_breach", F.round("drawdown_percent", 6).alias("drawdown_percent")),
    """SELECT c_custkey, c_acctbal - 400 < 0 AND -(c_acctbal - 400) >= 250 AS daily_breach, c_acctbal < 5000 AND 5000 - c_acctbal >= 600 AS total_breach,
    round(greatest(0, (5000 - c_acctbal) / 5000 * 100), 6) AS drawdown_percent FROM customer""",
)
register(
    "risk_open_positions",
    lambda s, d: rounded(
        ledger.open_position_counts(_open_positions(s, d), quoted_ticks(s, d), _stamp("2024-01-31 00:00:00"), ["symbol"]), 6, "floating_profit",
        plain=("symbol", "buys", "sells", "minutes_since_open"),
    ),
    f"""WITH {FILL_SQL}, lt AS (SELECT symbol, arg_max(bid, pos) AS bid, arg_max(ask, pos) AS ask FROM tk GROUP BY 1)
    SELECT symbol, count(*) FILTER (sign > 0) AS buys, count(*) FILTER (sign < 0) AS sells, CAST(floor((epoch(TIMESTAMP '2024-01-31') - max(floor(epoch(ts)))) / 60) AS BIGINT) AS minutes_since_open,
    round(sum(CASE WHEN sign > 0 THEN bid - price ELSE price - ask END * volume), 6) AS floating_profit FROM fp JOIN lt USING (symbol) WHERE exit_pos IS NULL GROUP BY 1""",
)


def _requests(s, d):
    """Orders as requests with a spread of barrier errors, sizes and account states."""
    k = F.col("o_orderkey")
    p = F.col("o_totalprice")
    return table(s, d, "orders").select(
        k.alias("trade_id"), F.when(k % 101 != 0, F.col("o_orderpriority")).alias("symbol"), ((k % 13) / 10).alias("volume"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), p.alias("price"), (p + F.when(k % 3 == 0, 10).otherwise(-10)).alias("sl"),
        (p + F.when(k % 5 == 0, -20).otherwise(20)).alias("tp"), (k % 7 / 10).alias("spread"), F.when(k % 11 == 0, "modify").otherwise("deal").alias("action"),
        (k % 17 == 0).alias("risk_exempt"), F.lit(False).alias("existing"), (-(k % 600).cast("double")).alias("daily_profit"),
        (k % 6).alias("open_positions"), (k % 23).cast("double").alias("drawdown_pct"),
    )


register(
    "risk_validate_orders",
    lambda s, d: ledger.validate_orders(_requests(s, d), 1.0, 500.0, 0.5, 5, 20.0).select("trade_id", "approved", F.array_join("reasons", "; ").alias("reasons")),
    """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderpriority END AS symbol, (o_orderkey % 13) / 10::DOUBLE AS v, o_totalprice AS p,
    o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE -10 END AS sl, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN -20 ELSE 20 END AS tp FROM orders),
    q AS (SELECT k, CASE WHEN k % 17 = 0 AND k % 11 = 0 THEN '' WHEN k % 17 = 0 THEN 'risk_exempt is only valid for non-opening actions' ELSE concat_ws('; ', CASE WHEN symbol IS NULL THEN 'symbol is required' END,
    CASE WHEN v <= 0 THEN 'volume must be positive' END, CASE WHEN v > 1 THEN 'volume exceeds max_volume' END, CASE WHEN k % 6 >= 5 THEN 'max_open_positions reached' END, CASE WHEN k % 600 >= 500 THEN 'daily loss limit reached' END,
    CASE WHEN k % 23 >= 20 THEN 'max drawdown limit reached' END, CASE WHEN k % 7 > 5 THEN 'spread exceeds max_spread' END, CASE WHEN k % 2 = 0 AND NOT (sl < p AND p < tp) THEN 'buy requires sl < price < tp' END,
    CASE WHEN k % 2 = 1 AND NOT (tp < p AND p < sl) THEN 'sell requires tp < price < sl' END) END AS reasons FROM r) SELECT k AS trade_id, reasons = '' AS approved, reasons FROM q""",
)

# -- lifecycle --------------------------------------------------------------------------------------------------

_ROLES = {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def _turns(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("trade_id"), F.col("turn").alias("seq"), F.col("role").alias("state"))


register(
    "lifecycle_transition_audit",
    lambda s, d: ledger.transition_audit(_turns(s, d), _ROLES, "system").select("trade_id", "seq", "state", "previous_state", "problem"),
    """WITH l AS (SELECT conv_id AS trade_id, turn AS seq, role AS state, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_state FROM conversations),
    p AS (SELECT *, CASE WHEN previous_state IS NULL AND state <> 'system' THEN 'does not start with system' WHEN previous_state IS NOT NULL AND state = 'system' THEN 'duplicate trade_id'
    WHEN previous_state IS NOT NULL AND NOT ((previous_state = 'system' AND state = 'user') OR (previous_state = 'user' AND state = 'assistant') OR (previous_state = 'assistant' AND state = 'user')) THEN 'transition not allowed' END AS problem FROM l)
    SELECT * FROM p WHERE problem IS NOT NULL""",
)
register(
    "lifecycle_current_state",
    lambda s, d: ledger.current_states(_turns(s, d)),
    "SELECT conv_id AS trade_id, arg_max(role, turn) AS state FROM conversations GROUP BY 1",
)
register(
    "lifecycle_state_counts",
    lambda s, d: ledger.state_counts(_turns(s, d)),
    "WITH c AS (SELECT conv_id, arg_max(role, turn) AS state FROM conversations GROUP BY 1) SELECT state, count(*) AS trades FROM c GROUP BY 1",
)


def _in_flight(s, d):
    """Orders as trades in four states; at the broker, status O is an order, P a position, F nothing."""
    k = F.col("o_orderkey")
    states = table(s, d, "orders").select(
        F.concat(F.lit("T"), F.lpad(k.cast("string"), 12, "0")).alias("trade_id"), F.element_at(F.array(F.lit("SENT"), F.lit("ACCEPTED"), F.lit("OPEN"), F.lit("CLOSED")), (k % 4 + 1).cast("int")).alias("state"),
        F.col("o_orderpriority").alias("symbol"), F.concat(F.lit("S"), k % 50000 + 7).alias("strategy"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"), F.lit(0).cast("long").alias("ticket"),
    )
    broker = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.lit(9).alias("magic"), F.concat(F.lit("T"), F.lpad(k.cast("string"), 12, "0"), F.lit(":x")).alias("comment"), (k + 1000).alias("ticket"), F.col("o_orderstatus").alias("_at")
    )
    return states, broker.filter("_at = 'O'").drop("_at"), broker.filter("_at = 'P'").drop("_at")


register(
    "lifecycle_reconcile",
    lambda s, d: ledger.reconcile(*_in_flight(s, d), _stamp("2000-01-01 00:00:00"), 120, 9),
    """WITH r AS (SELECT 'T' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS trade_id, o_orderkey AS k, o_orderpriority AS symbol, ['SENT', 'ACCEPTED', 'OPEN', 'CLOSED'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS state, o_orderstatus = 'O' AS o, o_orderstatus = 'P' AS p,
    o_orderdate <= TIMESTAMP '2000-01-01' - INTERVAL 120 SECOND AS late FROM orders),
    n AS (SELECT *, CASE WHEN state = 'SENT' AND (o OR p) THEN 'ACCEPTED' WHEN state = 'ACCEPTED' AND p THEN 'OPEN' WHEN state = 'OPEN' AND NOT p THEN 'CLOSED' WHEN state = 'OPEN' OR (state = 'ACCEPTED' AND o) THEN state WHEN late THEN 'REJECTED' ELSE state END AS next_state FROM r WHERE state <> 'CLOSED')
    SELECT trade_id, symbol, state, next_state, CASE WHEN next_state = 'REJECTED' THEN 'rejected' WHEN state = 'SENT' AND next_state = 'ACCEPTED' THEN 'recovered' WHEN state = 'ACCEPTED' AND next_state = 'OPEN' THEN 'opened' WHEN next_state = 'CLOSED' THEN 'closed'
    WHEN state = 'OPEN' THEN 'unchanged' ELSE 'waiting' END AS action, CAST(CASE WHEN next_state <> state AND (o OR p) THEN k + 1000 ELSE 0 END AS BIGINT) AS ticket FROM n""",
)
register(
    "lifecycle_ledger_counts",
    lambda s, d: ledger.ledger_counts(
        example_orders(s, d), fills(s, d).select("trade_id", F.when(F.col("exit_pos").isNull(), "OPEN").otherwise("CLOSED").alias("status"))
    ),
    f"WITH {FILL_SQL} SELECT (SELECT count(*) FROM od) AS orders, count(*) FILTER (exit_pos IS NULL) AS open, count(*) FILTER (exit_pos IS NOT NULL) AS closed, 0::BIGINT AS without_order FROM fp",
)


def _changes(s, d):
    bars = daily(s, d)
    from tapeline.operators.scans import shift
    from tapeline.operators.steps import Step

    step = Step(lambda laid: laid.add({"old_volume": F.coalesce(shift(laid, "volume"), F.lit(1.0))}), 1)
    rows = run(bars, DAY, step)
    action = F.when(F.col("volume") < F.col("old_volume") - 1, "ROLLBACK").otherwise("CHANGE")
    return rows.select("symbol", "ts", "old_volume", F.col("volume").alias("new_volume"), action.alias("action"))


register(
    "lifecycle_volume_audit",
    lambda s, d: ledger.volume_audit(_changes(s, d), DAY, 3.0, 2).select("symbol", "ts", F.array_join("problems", "; ").alias("problems")),
    f"""WITH {DAILY_SQL}, c AS (SELECT *, coalesce(lag(volume) OVER w, 1) AS old, lag(ts) OVER w AS pt FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)), k AS (SELECT *, volume < old - 1 AS rb FROM c),
    p AS (SELECT symbol, ts, concat_ws('; ', CASE WHEN NOT rb AND volume < old THEN 'decrease without rollback' END, CASE WHEN rb AND volume >= old THEN 'rollback does not decrease' END, CASE WHEN volume > 3 THEN 'above the cap' END,
    CASE WHEN NOT rb AND epoch(ts) - epoch(pt) < 172800 THEN 'observation period too short' END) AS problems FROM k) SELECT * FROM p WHERE problems <> ''""",
)


def _log(s, d):
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    event = F.when(F.col("user_id") % 40 == 0, "trade_rejected").otherwise(F.col("event_type"))
    return table(s, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), level.alias("level"), event.alias("event"), F.col("props").alias("message")
    )


register(
    "lifecycle_alert_rows",
    lambda s, d: ledger.alert_rows(_log(s, d)).select("event_id", "level", "event"),
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN user_id % 40 = 0 THEN 'trade_rejected' ELSE event_type END AS event FROM events
    WHERE event_type = 'error' OR user_id % 40 = 0""",
)
register(
    "lifecycle_daily_report",
    lambda s, d: ledger.daily_report(_turns(s, d), deals(s, d), _log(s, d), "2024-01-05", 5, 5000.0)["warning"],
    """SELECT count(*) >= 5 AS warning, count(*) AS alerts, 0::BIGINT AS rejected FROM events WHERE (event_type = 'error' OR user_id % 40 = 0) AND CAST(ts AS DATE) = DATE '2024-01-05'""",
)


def _report(name):
    return lambda s, d: ledger.daily_report(_turns(s, d), deals(s, d), _log(s, d), "2024-01-05", 5, 5000.0)[name]


register(
    "lifecycle_daily_states",
    _report("states"),
    "SELECT state, count(*) AS trades FROM (SELECT conv_id, arg_max(role, turn) AS state FROM conversations GROUP BY 1) GROUP BY 1",
)
register(
    "lifecycle_daily_alerts",
    lambda s, d: _report("alerts")(s, d).select("event_id", "level", "event"),
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN user_id % 40 = 0 THEN 'trade_rejected' ELSE event_type END AS event FROM events
    WHERE (event_type = 'error' OR user_id % 40 = 0) AND CAST(ts AS DATE) = DATE '2024-01-05'""",
)
register(
    "documents_ranked",
    lambda s, d: ledger.rank_documents(table(s, d, "documents"), "the and ation est"),
    "WITH s AS (SELECT doc_id, "
    + " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in ("the", "and", "ation", "est"))
    + " AS score FROM documents) SELECT doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0",
)

# -- sizing -----------------------------------------------------------------------------------------------------


def _sized(s, d):
    bars = hourly(s, d)
    bal, entry, stop = F.lit(5000.0), F.col("close"), F.col("low") - 0.5
    family = F.element_at(F.array(*[F.lit(x) for x in ("XAUUSD", "USDJPY", "BTCUSD", "USDCAD", "EURUSD")]), (F.floor("volume") % 5 + 1).cast("int"))
    return bars.select(
        "symbol", "ts", F.round(sizing.lot_by_tick_value(bal, 1.0, entry, stop, F.lit(0.01), F.lit(0.05)), 4).alias("by_tick"),
        F.round(sizing.lot_by_family(family, bal, 1.0, entry, stop), 4).alias("by_family"),
        F.round(sizing.capped_volume(bal, 1.0, entry, stop, F.lit(0.01), F.lit(0.05), target=0.5), 4).alias("capped"),
        F.round(sizing.recovery_risk_percent(1.0, 5000.0, 2.0, F.lit(3), entry, 2.0), 4).alias("recovery"),
        sizing.bounded_risk_percent(F.col("volume")).alias("bounded"),
        F.round(sizing.atr_stop_distance(F.col("high") - F.col("low"), 5.0, 60.0), 4).alias("stop_distance"),
    )


register(
    "sizing_lots",
    _sized,
    f"""WITH {HOURLY_SQL}, x AS (SELECT *, abs(close - (low - 0.5)) AS gap, ['XAUUSD', 'USDJPY', 'BTCUSD', 'USDCAD', 'EURUSD'][CAST(floor(volume) % 5 + 1 AS INTEGER)] AS fam FROM b),
    y AS (SELECT *, 50 / (gap / 0.01::DOUBLE * 0.05::DOUBLE) AS raw, CASE fam WHEN 'XAUUSD' THEN 50 / (gap * 100) WHEN 'USDJPY' THEN 50 / (gap / 0.01::DOUBLE) * (low - 0.5) / 1000 WHEN 'BTCUSD' THEN 50 / gap
    WHEN 'USDCAD' THEN 50 / (gap / 0.0001::DOUBLE) * (low - 0.5) / 10 ELSE 50 / (gap / 0.0001::DOUBLE) / 10 END AS fr FROM x)
    SELECT symbol, ts, round(greatest(0.01, round(greatest(0.01, least(100, floor(raw / 0.01::DOUBLE) * 0.01::DOUBLE)), 2)), 4) AS by_tick, round(greatest(0.01, floor(fr * 100) / 100), 4) AS by_family,
    round(least(CASE WHEN floor(least(raw, 0.5::DOUBLE) / 0.01::DOUBLE) * 0.01::DOUBLE < 0.01 AND raw >= 0.01 THEN 0.01 ELSE floor(least(raw, 0.5::DOUBLE) / 0.01::DOUBLE) * 0.01::DOUBLE END, 0.5), 4) AS capped,
    round(CASE WHEN 300 - close <= 0 THEN 1.0 ELSE least(greatest(round((300 - close) / 2 / 5000 * 100, 2), 1.0), 2.0) END, 4) AS recovery, CAST(greatest(0, least(volume, 2)) AS DOUBLE) AS bounded,
    round(CASE WHEN 2 * (high - low) > 60 THEN 60 WHEN 2 * (high - low) < 5 THEN 5 ELSE 2 * (high - low) END, 4) AS stop_distance FROM y""",
)


def _pip_values(s, d):
    """Suppliers as symbols: the nation names the profit currency, the region its rate."""
    names = F.concat(F.lit("C"), F.col("s_nationkey"))
    currency = F.when(F.col("s_nationkey") % 3 == 0, "USD").otherwise(names)
    symbols = table(s, d, "supplier").select(
        F.col("s_name").alias("symbol"), F.lit(3).alias("digits"), F.lit(0.001).alias("tick_size"), (F.lit(0.1) + F.col("s_suppkey") % 7).alias("tick_value"), currency.alias("profit_currency")
    )
    nation = table(s, d, "nation")
    rates = nation.select(
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("C"), "n_nationkey", F.lit("USD"))).otherwise(F.concat(F.lit("USDC"), "n_nationkey")).alias("symbol"),
        (F.col("n_regionkey") + 1.5).alias("rate"),
    )
    rows = table(s, d, "supplier").select(F.col("s_name").alias("symbol"))
    return sizing.pip_values(rows, symbols, rates, F.lit(0.5)).select("symbol", F.round("pip_value", 3).alias("pip_value"))


register(
    "sizing_pip_values",
    _pip_values,
    """SELECT s_name AS symbol, round(round(CASE WHEN s_nationkey % 3 = 0 THEN q WHEN s_nationkey % 2 = 0 THEN q * rate ELSE q / rate END * 0.5, 3), 3) AS pip_value
    FROM (SELECT *, 0.01::DOUBLE / 0.001::DOUBLE * (0.1 + s_suppkey % 7) AS q, n_regionkey + 1.5 AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey) x""",
)
