"""Deals, risk gates, trade lifecycle, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.bars import SESSIONS
from tapeline.operators.layout import epoch_seconds, lay_out
from tapeline.operators.metrics import trade_metrics
from tapeline.operators.scans import shift
from tapeline.operators.trades import latest_ticks

# -- deals ------------------------------------------------------------------------------------------------------


def in_range(deals: DataFrame, start: Column, end: Column) -> DataFrame:
    """Deals with ``start <= ts < end``; the filter reaches the scan."""
    return deals.filter((F.col("ts") >= start) & (F.col("ts") < end))


def result_counts(deals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of losing and winning deals and their total profit."""
    p = F.col("profit")
    return deals.groupBy(*keys).agg(
        F.count_if(p < 0).alias("losses"), F.count_if(p > 0).alias("wins"), F.coalesce(F.sum(p), F.lit(0.0)).alias("profit")
    )


def of_positions(deals: DataFrame, comment: str, contains: bool = False, types: Sequence[str] | None = None) -> DataFrame:
    """Deals of the positions that some deal with this comment opened."""
    named = F.col("comment").contains(comment) if contains else F.col("comment") == comment
    opening = deals.filter(named)
    if types:
        opening = opening.filter(F.col("type").isin(*types))
    return deals.join(opening.select("position_id").distinct(), "position_id", "left_semi")


def barrier_exits(deals: DataFrame, comment: str, mark: str, fold_case: bool = False) -> DataFrame:
    """Number of deals whose comment holds a mark (``tp``, ``sl``) among the positions of a comment."""
    text = F.lower("comment") if fold_case else F.col("comment")
    return of_positions(deals, comment).agg(F.count_if(text.contains(mark)).alias("exits"))


def in_session(deals: DataFrame, name: str, day: str, offset_hours: int = 0) -> DataFrame:
    """Deals within a market session of a local day; ``offset_hours`` shifts broker time against UTC."""
    zones = {label: (zone, opens, closes) for label, zone, opens, closes in SESSIONS}
    if name not in zones:
        raise ValueError(f"unknown session {name!r}")
    zone, opens, closes = zones[name]

    def utc(hour: int) -> Column:
        local = F.lit(f"{day} {hour:02d}:00:00").cast("timestamp_ntz")
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local) + F.make_interval(hours=F.lit(offset_hours))

    return deals.filter(F.col("ts").between(utc(opens), utc(closes)))


def losses_between_hours(deals: DataFrame, comment: str, day: str, first: int, last: int, types: Sequence[str] | None = None) -> DataFrame:
    """Losing deals of a comment's positions between two hours of a day, both ends included."""
    start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    held = deals.filter(F.col("ts").between(start + F.make_interval(hours=F.lit(first)), start + F.make_interval(hours=F.lit(last))))
    return of_positions(held, comment, types=types).agg(F.count_if(F.col("profit") < 0).alias("losses"))


def loss_streak(deals: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Losing deals after the last winning one, per key: two aggregates, no ordering of the whole key."""
    keys = list(keys)
    place = F.struct(*order)
    wins = deals.groupBy(*keys).agg(F.max(F.when(F.col("profit") > 0, place)).alias("_win"))
    joined = deals.join(wins, keys) if keys else deals.join(wins, F.lit(True))
    after = F.col("_win").isNull() | (place > F.col("_win"))
    return joined.groupBy(*keys).agg(F.count_if((F.col("profit") < 0) & after).alias("streak"))


def profit_and_loss(deals: DataFrame, positions: DataFrame) -> DataFrame:
    """Closed result with costs plus the open one, as one row rounded to cents."""
    zero = F.lit(0.0)
    closed = deals.select(
        (F.col("profit") + F.coalesce("commission", zero) + F.coalesce("swap", zero) + F.coalesce("fee", zero)).alias("_v"), F.lit(0).alias("_o")
    )
    floating = positions.select((F.col("profit") + F.coalesce("swap", zero)).alias("_v"), F.lit(1).alias("_o"))
    return closed.unionByName(floating).agg(
        F.round(F.coalesce(F.sum("_v"), zero), 2).alias("pnl"), F.sum("_o").alias("open_positions")
    )


def drawdown_flags(account: DataFrame, daily_percent: float, total_percent: float) -> DataFrame:
    """Breach flags and drawdown share from ``start_balance, pnl, balance, equity``."""
    start = F.col("start_balance")
    fall = F.greatest(F.lit(0.0), F.try_divide(F.col("balance") - F.col("equity"), F.col("balance")) * 100)
    return account.withColumns(
        {
            "daily_breach": (F.col("pnl") < 0) & (-F.col("pnl") >= start * daily_percent / 100),
            "total_breach": (F.col("equity") < start) & (start - F.col("equity") >= start * total_percent / 100),
            "drawdown_percent": F.coalesce(F.when(F.col("balance") > 0, fall), F.lit(0.0)),
        }
    )


def open_position_counts(positions: DataFrame, ticks: DataFrame, now: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Open positions per side, minutes since the last opening, floating profit at the newest tick."""
    rows = positions.join(latest_ticks(ticks), "symbol", "left")
    buy = F.col("side") == "buy"
    floating = F.when(buy, F.col("bid") - F.col("price")).otherwise(F.col("price") - F.col("ask")) * F.col("volume")
    minutes = (epoch_seconds(now) - F.max(epoch_seconds("ts"))) / 60
    return rows.groupBy(*keys).agg(
        F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), F.floor(minutes).alias("minutes_since_open"),
        F.sum(floating).alias("floating_profit"),
    )


# -- risk gate --------------------------------------------------------------------------------------------------


def validate_orders(
    orders: DataFrame,
    max_volume: float = 1.0,
    max_daily_loss: float = 0.0,
    max_spread: float = 0.0,
    max_open_positions: int = 0,
    max_drawdown_pct: float = 0.0,
) -> DataFrame:
    """``approved`` and ``reasons`` of order requests; a limit of zero is off.

    Columns read: symbol, volume, side, price, sl, tp, spread, action, risk_exempt, daily_profit, open_positions,
    drawdown_pct, existing (whether the request names an existing order or position). An exempt request passes when
    it does not open anything and is refused otherwise.
    """
    price, sl, tp = F.col("price"), F.col("sl"), F.col("tp")
    volume = F.coalesce("volume", F.lit(0.0))
    priced = price.isNotNull() & sl.isNotNull() & tp.isNotNull()
    rules = [
        F.when(F.coalesce("symbol", F.lit("")) == "", "symbol is required"),
        F.when(volume <= 0, "volume must be positive"),
        F.when(F.lit(max_volume > 0) & (volume > max_volume), "volume exceeds max_volume"),
        F.when(F.lit(max_open_positions > 0) & (F.col("open_positions") >= max_open_positions), "max_open_positions reached"),
        F.when(F.lit(max_daily_loss > 0) & (F.col("daily_profit") <= -abs(max_daily_loss)), "daily loss limit reached"),
        F.when(F.lit(max_drawdown_pct > 0) & (F.col("drawdown_pct") >= max_drawdown_pct), "max drawdown limit reached"),
        F.when(F.lit(max_spread > 0) & (F.col("spread") > max_spread), "spread exceeds max_spread"),
        F.when(priced & (F.lower("side") == "buy") & ~((sl < price) & (price < tp)), "buy requires sl < price < tp"),
        F.when(priced & (F.lower("side") == "sell") & ~((tp < price) & (price < sl)), "sell requires tp < price < sl"),
    ]
    exempt = F.coalesce("risk_exempt", F.lit(False))
    harmless = F.coalesce("existing", F.lit(False)) | F.coalesce(F.lower("action").isin("sltp", "modify", "remove", "close"), F.lit(False))
    refused = F.array(F.lit("risk_exempt is only valid for non-opening actions"))
    none = F.array().cast("array<string>")
    reasons = F.when(exempt & harmless, none).when(exempt, refused).otherwise(F.array_compact(F.array(*rules)))
    return orders.withColumn("reasons", reasons).withColumn("approved", F.size("reasons") == 0)


# -- lifecycle --------------------------------------------------------------------------------------------------

# States a trade may enter from each state.
TRANSITIONS = {
    "SIGNAL": ("VALIDATED", "REJECTED"),
    "VALIDATED": ("APPROVED", "REJECTED"),
    "APPROVED": ("SENT", "REJECTED"),
    "SENT": ("ACCEPTED", "REJECTED"),
    "ACCEPTED": ("OPEN", "REJECTED"),
    "OPEN": ("MANAGED", "CLOSED"),
    "MANAGED": ("MANAGED", "CLOSED"),
    "CLOSED": (),
    "REJECTED": (),
}


def transition_audit(
    events: DataFrame, transitions: dict[str, Sequence[str]] | None = None, initial: str = "SIGNAL", order: str = "seq", rows: int = 4096
) -> DataFrame:
    """Events that do not follow from the state before them, and repeated creations.

    ``events``: trade_id, seq, state. Events of one trade are compared inside ranges of ``seq``, each of which knows
    the last state before it, so that one very long trade does not fill a task.
    """
    allowed = TRANSITIONS if transitions is None else transitions
    pairs = [f"{a}>{b}" for a, targets in allowed.items() for b in targets]
    ranged = events.withColumn("_range", F.floor(F.col(order) / rows))
    inside = Window.partitionBy("trade_id", "_range").orderBy(order)
    tops = ranged.groupBy("trade_id", "_range").agg(F.max_by("state", order).alias("_last"))
    carry = tops.withColumn("_before", F.lag("_last").over(Window.partitionBy("trade_id").orderBy("_range"))).drop("_last")
    joined = ranged.withColumn("_prev", F.lag("state").over(inside)).join(carry, ["trade_id", "_range"])
    prev = F.coalesce("_prev", "_before")
    step = F.concat_ws(">", prev, "state")
    problem = (
        F.when(prev.isNull() & (F.col("state") != initial), "does not start with " + initial)
        .when(prev.isNotNull() & (F.col("state") == initial), "duplicate trade_id")
        .when(prev.isNotNull() & ~step.isin(*pairs), "transition not allowed")
    )
    return joined.withColumns({"previous_state": prev, "problem": problem}).filter("problem IS NOT NULL").drop("_range", "_prev", "_before")


def current_states(events: DataFrame, order: str = "seq") -> DataFrame:
    return events.groupBy("trade_id").agg(F.max_by("state", order).alias("state"))


def state_counts(events: DataFrame, order: str = "seq") -> DataFrame:
    return current_states(events, order).groupBy("state").agg(F.count("*").alias("trades"))


def reconcile(states: DataFrame, orders: DataFrame, positions: DataFrame, now: Column, timeout: int = 120, magic: int = 0) -> DataFrame:
    """What to do with trades that were in flight: accept, open, reject, wait or close.

    ``states``: trade_id, state, symbol, strategy, updated_at, ticket. ``orders`` and ``positions``: symbol, magic,
    comment, ticket. A broker row belongs to a trade of the same symbol when its comment is the strategy, starts with
    it and a colon, or holds the trade id. A comment is first turned into the keys it can match (itself, its head, its
    substrings as long as a trade id), so both joins are on equal keys instead of a text condition over every pair.
    """

    sizes = states.agg(F.collect_set(F.length("trade_id")).alias("_sizes"))  # one short row

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        text = F.coalesce("comment", F.lit(""))
        held = rows.filter(F.col("magic") == magic) if magic else rows

        def parts(n: Column) -> Column:
            starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1))
            return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda at: F.substr(text, at, n))

        inside = F.flatten(F.transform("_sizes", parts))
        every = F.array_distinct(F.concat(F.array(text, F.substring_index(text, ":", 1)), inside))
        keys = held.join(sizes, F.lit(True)).select("symbol", F.explode(every).alias("_key"), F.col("ticket").alias(f"_{name}"))
        return keys.groupBy("symbol", "_key").agg(F.min(f"_{name}").alias(f"_{name}"))

    flying = states.filter(F.col("state").isin("SENT", "ACCEPTED", "OPEN"))
    asked = flying.select("trade_id", "symbol", F.explode(F.array_distinct(F.array("trade_id", "strategy"))).alias("_key"))
    found = asked.join(keyed(orders, "order"), ["symbol", "_key"], "left").join(keyed(positions, "position"), ["symbol", "_key"], "left")
    found = found.groupBy("trade_id").agg(F.min("_order").alias("_order"), F.min("_position").alias("_position"))
    rows = flying.join(found, "trade_id")
    order, position = F.col("_order").isNotNull(), F.col("_position").isNotNull()
    late = F.greatest(F.lit(0), epoch_seconds(now) - epoch_seconds("updated_at")) >= timeout
    state = F.col("state")
    nxt = (
        F.when((state == "SENT") & (order | position), "ACCEPTED")
        .when((state == "ACCEPTED") & position, "OPEN")
        .when((state == "OPEN") & ~position, "CLOSED")
        .when((state == "OPEN") | ((state == "ACCEPTED") & order), state)
        .when(late, "REJECTED")
        .otherwise(state)
    )
    action = (
        F.when(nxt == "REJECTED", "rejected")
        .when((state == "SENT") & (nxt == "ACCEPTED"), "recovered")
        .when((state == "ACCEPTED") & (nxt == "OPEN"), "opened")
        .when(nxt == "CLOSED", "closed")
        .when(state == "OPEN", "unchanged")
        .otherwise("waiting")
    )
    ticket = F.when(nxt != state, F.coalesce("_position", "_order", "ticket")).otherwise(F.col("ticket"))
    return rows.select("trade_id", "symbol", "state", nxt.alias("next_state"), action.alias("action"), ticket.alias("ticket"))


def reconcile_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("trades"))


def ledger_counts(orders: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: orders, open and closed positions, and closed positions without an order."""
    a = orders.agg(F.count("*").alias("orders"))
    b = positions.agg(F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.col("status") == "CLOSED").alias("closed"))
    lost = positions.join(orders, "trade_id", "left_anti").agg(F.count("*").alias("without_order"))
    return a.join(b, F.lit(True)).join(lost, F.lit(True))


def volume_audit(changes: DataFrame, seconds: float, cap: float, min_days: int) -> DataFrame:
    """Changes of traded volume that break a rule: decrease without rollback, above the cap, too soon after the last.

    ``changes``: symbol, ts, old_volume, new_volume, action (CHANGE or ROLLBACK).
    """
    laid = lay_out(changes, seconds, 1)
    laid = laid.add({"_prev": shift(laid, "ts"), "_was": shift(laid, "new_volume")})
    old, new = F.col("old_volume"), F.col("new_volume")
    rollback = F.col("action") == "ROLLBACK"
    rules = [
        F.when(new <= 0, "volume must be positive"),
        F.when(~rollback & (new < old), "decrease without rollback"),
        F.when(rollback & (new >= old), "rollback does not decrease"),
        F.when(new > cap, "above the cap"),
        F.when(F.col("_was").isNotNull() & (F.col("_was") != old), "does not continue the last volume"),
        F.when(~rollback & (epoch_seconds("ts") - epoch_seconds("_prev") < min_days * 86400), "observation period too short"),
    ]
    audited = laid.add({"problems": F.array_compact(F.array(*rules))}).drop("_prev", "_was").core()
    return audited.filter(F.size("problems") > 0)


# Log rows that count as alerts.
ALERT_LEVELS = ("ERROR", "CRITICAL")
ALERT_EVENTS = ("recovery_timeout", "recovery_error", "run_once_error", "trade_rejected")


def alert_rows(log: DataFrame) -> DataFrame:
    level, event = F.upper(F.coalesce("level", F.lit(""))), F.lower(F.coalesce("event", F.lit("")))
    return log.filter(level.isin(*ALERT_LEVELS) | event.isin(*ALERT_EVENTS))


def daily_report(events: DataFrame, trades: DataFrame, log: DataFrame, day: str, threshold: int, initial_balance: float) -> dict[str, DataFrame]:
    """Tables of a day's report: state counts, metrics of closed trades, alerts, and the warning flag."""
    states = state_counts(events)
    alerts = alert_rows(log).filter(F.col("timestamp").contains(day))
    rejected = states.agg(F.coalesce(F.sum(F.when(F.col("state") == "REJECTED", F.col("trades"))), F.lit(0)).alias("_r"))
    flagged = alerts.agg(F.count("*").alias("_a")).join(rejected, F.lit(True))
    warning = flagged.select((F.col("_r") + F.col("_a") >= threshold).alias("warning"), F.col("_a").alias("alerts"), F.col("_r").alias("rejected"))
    return {"states": states, "metrics": trade_metrics(trades, (), initial_balance), "alerts": alerts, "warning": warning}


def rank_documents(documents: DataFrame, query: str, text: str = "text", name: str = "doc_id") -> DataFrame:
    """Documents by total count of the query's words of three letters or more, case ignored; ties by name.

    Plain substring counts, as in the whole text; documents without a hit are left out.
    """
    import re

    terms = sorted({t.casefold() for t in re.findall(r"[\w-]+", query) if len(t) > 2})
    if not terms:
        return documents.select(name).limit(0).withColumn("score", F.lit(0))
    folded = F.lower(text)
    count = lambda t: F.length(folded) - F.length(F.replace(folded, F.lit(t), F.lit("")))
    score = sum((F.floor(count(t) / len(t)) for t in terms[1:]), F.floor(count(terms[0]) / len(terms[0])))
    return documents.select(name, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), name)

