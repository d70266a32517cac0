"""Live alerts and their cooldown against a plain loop over all rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.session import materialize
from tapeline.streaming import live

T0 = datetime(2024, 1, 1)


def stream_of(spark, df):
    path = materialize(df).inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(df.schema).parquet(path)


@pytest.mark.parametrize("cooldown", [2.0, 2.25, 0.5])
def test_alerts_with_many_rows_in_a_second(spark, cooldown):
    """The row after a cooldown may share its second with a row before the cooldown ends."""
    rng = random.Random(5)
    rows = [(T0 + timedelta(microseconds=rng.randrange(90_000_000)), "ERROR", rng.choice("ab"), "m") for _ in range(900)]
    rows += rows[:50]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, level string, event string, message string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = live.drain(live.live_alerts(stream_of(spark, log.repartition(3)), cooldown)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = []
    for event in "ab":
        sent = None
        for ts in sorted(r[0] for r in rows if r[2] == event):
            if sent is None or ts - sent >= timedelta(seconds=cooldown):
                sent = ts
                want.append((event, ts))
    assert sorted((r.event, r.ts) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rows", [90, 1000])
def test_fills_in_slices_of_time(spark, tmp_path, rows):
    """Slices are bounded, and open orders pass from one to the next; levels may be missing, zero or reached both at once."""
    rng = random.Random(7)
    ticks, orders = [], []
    for i in range(400):
        at, price = T0 + timedelta(seconds=rng.randrange(300)), 100 + rng.gauss(0, 3)
        ticks.append((rng.choice("ab"), at, i, price, rng.choice([None, price + 0.5])))
    for i in range(120):
        side = rng.choice(["buy", "sell"])
        levels = [rng.choice([None, 0.0, 100 + rng.gauss(0, 5)]) for _ in range(2)]
        orders.append((f"o{i}", rng.choice("ab"), T0 + timedelta(seconds=rng.randrange(300)), i, side, 100.0, *levels))
    feeds = {
        "ticks": spark.createDataFrame(ticks, "symbol string, ts timestamp_ntz, seq long, bid double, ask double"),
        "orders": spark.createDataFrame(orders, "trade_id string, symbol string, ts timestamp_ntz, seq long, side string, price double, sl double, tp double"),
    }
    bounds = live.time_slices(feeds["ticks"], rows=rows)
    sizes = [r["count"] for r in feeds["ticks"].groupBy(live.slice_of(bounds).alias("s")).count().collect()]
    assert len(sizes) == len(bounds) + 1 and max(sizes) <= 1.2 * rows
    base, got = str(tmp_path), None
    for i in range(len(bounds) + 1):
        streams = {}
        for name, feed in feeds.items():
            feed.filter(live.slice_of(bounds) == i).write.mode("append").parquet(f"{base}/{name}")
            streams[name] = spark.readStream.schema(feed.schema).parquet(f"{base}/{name}").withColumn("ts", F.col("ts").cast("timestamp"))
        got = live.drain(live.live_fills(streams["orders"], streams["ticks"], 0.25, buckets=3), f"{base}/out", f"{base}/checkpoint")
    got = got.withColumn("exit_ts", F.col("exit_ts").cast("timestamp_ntz"))
    want = []
    for name, symbol, placed, _, side, _, sl, tp in orders:
        sign = 1 if side == "buy" else -1
        for s, at, _, bid, ask in sorted(ticks, key=lambda t: (t[1], t[2])):
            mid = bid if ask is None else (bid + ask) / 2
            reason = "TP" if tp and sign * mid >= sign * tp else "SL" if sl and sign * mid <= sign * sl else None
            if s == symbol and at > placed and reason:
                want.append((name, symbol, reason, at, bid - 0.25 if sign > 0 else (bid if ask is None else ask) + 0.25))
                break
    assert sorted(tuple(r) for r in got.select("trade_id", "symbol", "exit_reason", "exit_ts", "exit_price").collect()) == sorted(want)
    assert len(want) > 40
