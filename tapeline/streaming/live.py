"""Live paths: ticks to bars, indicator states, order fills, alerts, idempotent and ordered ingestion."""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from tapeline.operators.ledger import alert_rows
from tapeline.operators.quality import order_violations
from tapeline.operators.trend import supertrend_voting_step
from tapeline.schema import tf_minutes
from tapeline.session import ensure_checkpoint_dir


def live_bars(ticks: DataFrame, timeframe: str | int, delay: str = "10 minutes", price: str = "price", seq: str = "seq") -> DataFrame:
    """Bars of a tick stream; a bar is emitted once the watermark has passed its end. ``ts`` must be a TIMESTAMP."""
    order = F.struct("ts", seq)
    window = F.window("ts", f"{tf_minutes(timeframe)} minutes")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", window)
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def _microseconds(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype(np.int64)


# -- indicator state --------------------------------------------------------------------------------------------

_STATE = StructType([StructField("values", StringType())])


def live_fold(
    rows: DataFrame, step: Callable, inputs: list[str], outputs: list[str], key: str = "symbol"
) -> DataFrame:
    """Run a fold step over a stream of rows per key; the state is the fold's list of numbers.

    The same step functions drive the batch folds, so both give the same values. Rows of a key must arrive in order
    from batch to batch; inside a batch they are sorted.
    """
    shape = StructType(
        [StructField(key, StringType()), StructField("ts", TimestampType())] + [StructField(o, DoubleType()) for o in outputs]
    )

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values = json.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts")
        out = []
        for row in zip(*[pdf[c].tolist() for c in inputs]):
            values, emitted = step(values, row)
            out.append(emitted)
        state.update((json.dumps(values),))
        result = pd.DataFrame(out, columns=outputs, dtype=float)
        result.insert(0, "ts", pdf["ts"].to_numpy())
        result.insert(0, key, k[0])
        yield result

    narrow = rows.select(key, "ts", *inputs)
    return narrow.groupBy(key).applyInPandasWithState(update, shape, _STATE, "append", GroupStateTimeout.NoTimeout)


def supertrend_bar_step(n: int = 10, mult: float = 3.0) -> Callable:
    """Voting Supertrend from plain bars: true range and its Wilder mean go into the state as well."""
    core = supertrend_voting_step()

    def step(state, row):
        high, low, close = row
        prev, mean, rest = (state[0], state[1], state[2:]) if state else (None, None, [])
        reach = high - low if prev is None else max(high - low, abs(high - prev), abs(low - prev))
        mean = reach if mean is None else mean + (reach - mean) / n
        middle = (high + low) / 2
        rest, emitted = core(rest, (middle - mult * mean, middle + mult * mean, close))
        return [close, mean, *rest], emitted

    return step


def live_supertrend(bars: DataFrame, n: int = 10, mult: float = 3.0) -> DataFrame:
    states = live_fold(bars, supertrend_bar_step(n, mult), ["high", "low", "close"], ["line", "side", "turn"])
    turn = F.when(F.col("turn") > 0, "buy").when(F.col("turn") < 0, "sell").otherwise("hold")
    return states.select(
        "symbol", "ts", "line", F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"), turn.alias("signal")
    )


# -- order fills ------------------------------------------------------------------------------------------------


_LATEST = np.iinfo(np.int64).max  # rows without a time come last
_OUT_ROWS = 10_000


def _known(times: np.ndarray) -> np.ndarray:
    return np.where(times == np.iinfo(np.int64).min, _LATEST, times)


def _first_exits(orders: list[list], starts: np.ndarray, mids: np.ndarray, rows: int = 10_000) -> tuple[list[int], list[int], list[str]]:
    """Order, tick and reason of every exit; ``orders``: name, sign, goal and stop times sign.

    Open levels lie in two heaps, so a tick looks only at the levels it reaches.
    """
    over: list[tuple[float, int]] = []
    under: list[tuple[float, int]] = []
    done = np.zeros(len(orders), bool)
    ended, at, reasons = [], [], []
    entering = np.argsort(starts, kind="stable")
    due, n = starts[entering].tolist() + [len(mids)], 0
    for low in range(0, len(mids), rows):
        for tick, mid in enumerate(mids[low : low + rows].tolist(), low):
            while due[n] <= tick and n < len(orders):
                i = int(entering[n])
                _, sign, goal, stop = orders[i]
                for level, up in ((goal, sign > 0), (stop, sign < 0)):
                    if level is not None:
                        heapq.heappush(over if up else under, (level * sign if up else -level * sign, i))
                n += 1
            for heap, reach in ((over, mid), (under, -mid)):
                while heap and heap[0][0] <= reach:
                    i = heapq.heappop(heap)[1]
                    if not done[i]:
                        done[i] = True
                        _, sign, goal, _ = orders[i]
                        ended.append(i)
                        at.append(tick)
                        reasons.append("TP" if goal is not None and mid * sign >= goal else "SL")
    return ended, at, reasons


def live_fills(orders: DataFrame, ticks: DataFrame, slippage: float = 0.0, buckets: int = 8) -> DataFrame:
    """Exits of open orders as ticks arrive; open orders are the state.

    Orders of a symbol are spread over ``buckets`` states and every tick visits each of them, so that a busy symbol
    is not one task. ``orders``: trade_id, symbol, ts, seq, side, price, sl, tp; ``ticks``: symbol, ts, seq, bid, ask.
    An order is live after its own time stamp. Of a micro-batch's ticks a task holds times, numbers and prices, 32 bytes a
    tick; how many that are is set by how the streams are fed, in order of time (``time_slices``).
    """
    none = F.lit(None)
    left = orders.select(
        "symbol", (F.abs(F.hash("trade_id")) % buckets).alias("bucket"), "ts", "seq", F.lit(1).alias("kind"), "trade_id", "side", "sl", "tp",
        none.cast("double").alias("bid"), none.cast("double").alias("ask"),
    )
    right = ticks.select(
        "symbol", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "ts", "seq", F.lit(0).alias("kind"),
        none.cast("string").alias("trade_id"), none.cast("string").alias("side"), none.cast("double").alias("sl"), none.cast("double").alias("tp"), "bid", "ask",
    )
    shape = StructType(
        [StructField(n, StringType()) for n in ("trade_id", "symbol", "exit_reason")]
        + [StructField("exit_ts", TimestampType()), StructField("exit_price", DoubleType())]
    )

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders = json.loads(state.get[0]) if state.exists else []
        first, parts, asked = len(orders), [], []
        for pdf in batches:
            is_tick = pdf["kind"].to_numpy() == 0
            times = _known(_microseconds(pdf["ts"]))
            seqs = pdf["seq"].fillna(_LATEST).to_numpy(np.int64)
            parts.append((times[is_tick], seqs[is_tick], *(pdf[c].to_numpy(float)[is_tick] for c in ("bid", "ask"))))
            new = pdf[~is_tick]
            for trade_id, side, sl, tp in zip(*[new[c].tolist() for c in ("trade_id", "side", "sl", "tp")]):
                sign = 1.0 if side == "buy" else -1.0
                orders.append([trade_id, sign, None if not tp or tp != tp else tp * sign, None if not sl or sl != sl else sl * sign])
            asked.append((times[~is_tick], seqs[~is_tick]))
        times, seqs, bid, ask = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((seqs, times))
        times, bid, ask = times[order], bid[order], ask[order]
        del parts, seqs, order
        # an order is live from the first tick after its time; those of earlier batches from the first tick on
        starts = np.concatenate([np.zeros(first, np.int64), np.searchsorted(times, np.concatenate([t for t, _ in asked]), "right")])
        ended, at, reason = _first_exits(orders, starts, np.where(np.isnan(ask), bid, (bid + ask) / 2))
        gone = set(ended)
        state.update((json.dumps([o for i, o in enumerate(orders) if i not in gone]),))
        for k in range(0, max(len(ended), 1), _OUT_ROWS):
            which, tick = ended[k : k + _OUT_ROWS], np.array(at[k : k + _OUT_ROWS], np.int64)
            long = np.array([orders[i][1] > 0 for i in which], bool)
            asks = np.where(np.isnan(ask[tick]), bid[tick], ask[tick])
            exit_ts = pd.Series(times[tick]).where(times[tick] != _LATEST)
            yield pd.DataFrame(
                {
                    "trade_id": [orders[i][0] for i in which], "symbol": key[0], "exit_reason": reason[k : k + _OUT_ROWS],
                    "exit_ts": pd.to_datetime(exit_ts.astype("Int64"), unit="us"),
                    "exit_price": np.where(long, bid[tick] - abs(slippage), asks + abs(slippage)),
                }
            )

    both = left.unionByName(right)
    return both.groupBy("symbol", "bucket").applyInPandasWithState(update, shape, _STATE, "append", GroupStateTimeout.NoTimeout)


# -- alerts -----------------------------------------------------------------------------------------------------


def live_alerts(log: DataFrame, cooldown: float = 300.0, delay: str = "1 hour") -> DataFrame:
    """Alert rows, at most one per level, event and message within ``cooldown`` seconds of event time.

    ``log``: ts (TIMESTAMP), level, event, message. Only rows of equal time are thinned before the shuffle: any other row may
    be the first one after a cooldown. Of a message's rows in a micro-batch a task holds the times alone, eight bytes each. A
    state is forgotten when the watermark passes its cooldown.
    """
    keys = ["level", "event", "message"]
    shape = StructType([StructField(k, StringType()) for k in keys] + [StructField("ts", TimestampType())])
    store = StructType([StructField("sent", LongType())])
    wait = math.ceil(cooldown * 1_000_000)

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop_duplicates([*keys, "ts"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([_microseconds(pdf["ts"]) for pdf in batches]))
        sent = state.get[0] if state.exists else None
        at = 0 if sent is None else int(np.searchsorted(times, sent + wait))
        out = []
        while at < len(times):
            sent = int(times[at])
            out.append(sent)
            at = max(at + 1, int(np.searchsorted(times, sent + wait)))
        state.update((sent,))
        # never set a timeout before the current watermark
        due = sent // 1000 + int(cooldown * 1000)
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        alerts = pd.DataFrame({"ts": pd.to_datetime(np.array(out, np.int64), unit="us")})
        yield alerts.assign(**dict(zip(keys, key)))[[*keys, "ts"]]

    rows = alert_rows(log).select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], "ts").withWatermark("ts", delay)
    thinned = rows.mapInPandas(thin, rows.schema)
    return thinned.groupBy(*keys).applyInPandasWithState(update, shape, store, "append", GroupStateTimeout.EventTimeTimeout)


# -- ingestion --------------------------------------------------------------------------------------------------


def unique_stream(orders: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per ``trade_id`` within the watermark."""
    return orders.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trade_id"])


def watched(ticks: DataFrame, name: str = "ticks") -> DataFrame:
    """The stream with counters for its progress reports: rows, newest time, rows without a price."""
    return ticks.observe(name, F.count("*").alias("rows"), F.max("ts").alias("newest"), F.count_if(F.col("price").isNull()).alias("unpriced"))


def strict_order(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that refuses a batch whose time stamps do not increase, then hands it on.

    The last time of every symbol is kept from batch to batch on the driver: one value per symbol.
    """
    last: dict = {}

    def check(batch: DataFrame, epoch: int) -> None:
        if not order_violations(batch).isEmpty():
            raise ValueError(f"batch {epoch}: time stamps do not increase")
        ends = batch.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).collect()
        for r in ends:
            if r.symbol in last and r["first"] <= last[r.symbol]:
                raise ValueError(f"batch {epoch}: time stamps of {r.symbol} do not follow the batch before")
        write(batch, epoch)
        last.update({r.symbol: r["last"] for r in ends})

    return check


def time_slices(df: DataFrame, ts: str = "ts", rows: int = 2_000_000) -> list:
    """Times that cut a table into slices of about ``rows`` rows; rows of one time are not split."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    n = -(-df.count() // rows)
    if n < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 100 * n)).first()[0] or []))


def slice_of(bounds: Sequence[int], ts: str = "ts") -> Column:
    """Number of the slice of a row: the bounds at or before its time; rows without a time are in the last slice."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    if not bounds:
        return F.lit(0)
    passed = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= at))
    return F.when(at.isNull(), len(bounds)).otherwise(passed)


def drain(stream: DataFrame, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything that is available into a parquet table and return it; a checkpoint allows going on later."""
    spark: SparkSession = stream.sparkSession
    if folder is None or checkpoint is None:
        ensure_checkpoint_dir(spark)
        base = f"{spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4().hex}"
        folder, checkpoint = folder or f"{base}/out", checkpoint or f"{base}/checkpoint"
    query = (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
