"""Sources, sinks, quality, models, sweeps, streams and the registered queries."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

import __spark_entry__ as entry
from tapeline.operators import quality, trend
from tapeline.operators.steps import run
from tapeline.plans import learning, research, sweeps
from tapeline.sources import files, sinks
from tapeline.streaming import live
from tests.conftest import MINUTE, collected

T0 = datetime(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    return path


def test_bars_csv(spark, folder):
    path = put(folder, "b.csv", "Timestamp,Open,High,Low,Close,Volume\n2026-01-01T00:03:00Z,2,3,1,2,5\n2026-01-01T00:00:00Z,100,112,98,110,10\n")
    rows = files.read_bars_csv(spark, path, "X").orderBy("ts").collect()
    assert [(r.symbol, r.open, r.volume) for r in rows] == [("X", 100.0, 10.0), ("X", 2.0, 5.0)]
    assert rows[0].ts == datetime(2026, 1, 1)


@pytest.mark.parametrize("line", ["2026-01-01T00:00:00Z,,112,98,110,1", "2026-01-01T00:00:00Z,100,90,98,110,1", "2026-01-01T00:00:00Z,0,112,0,110,1", "2026-01-01T00:00:00Z,1,inf,1,1,1"])
def test_bad_bars_are_refused(spark, folder, line):
    path = put(folder, "b.csv", "timestamp,open,high,low,close,volume\n" + line + "\n")
    with pytest.raises(ValueError):
        files.read_bars_csv(spark, path, "X")


def test_duplicates_and_policies(spark, folder):
    path = put(folder, "b.csv", "time,open,high,low,close,tick_volume\n" + "2026-01-01 00:00:00,1,2,1,1.5,1\n2026-01-01 00:00:00,1,3,1,2.5,2\n")
    with pytest.raises(ValueError):
        files.load_dataset(spark, path, "X", "1m")
    first, summary = files.load_dataset(spark, path, "X", "1m", policy="first")
    last, _ = files.load_dataset(spark, path, "X", "1m", policy="last")
    assert (first.first().close, last.first().close) == (1.5, 2.5)
    assert summary.first().row_count == 1 and len(summary.first().content_hash) == 64


def test_terminal_files(spark, folder):
    bars = put(folder, "b.tsv", "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\n2024.01.02\t03:04:05\t1\t3\t1\t2\t9\n")
    row = files.read_terminal_bars(spark, bars, "X").first()
    assert (row.ts, row.high, row.volume) == (datetime(2024, 1, 2, 3, 4, 5), 3.0, 9.0)
    ticks = put(folder, "t.tsv", "<DATE>\t<TIME>\t<BID>\t<ASK>\n2024.01.02\t03:04:05.250\t1\t1.2\n2024.01.02\t03:04:06\t\t1.3\n")
    got = files.read_terminal_ticks(spark, ticks, "X").collect()
    assert len(got) == 1 and got[0].ts.microsecond == 250000
    plain = put(folder, "t.csv", "timestamp,bid,ask\n2024-01-01T00:00:01Z,100,101\n2024-01-01T00:00:00Z,99,100\n")
    assert files.read_ticks_csv(spark, plain, "X").count() == 2


def test_logs_states_and_registries(spark, folder):
    log = put(folder, "l.jsonl", '{"timestamp":"2024-01-01","level":"ERROR","event":"x","message":"m","metadata":{"a":"1"}}\nnot json\n{"timestamp":"2024-01-02","level":"INFO","event":"y","message":"n"}\n')
    assert files.read_log(spark, log).count() == 2
    assert files.read_log(spark, log, newest=1).first().timestamp == "2024-01-02"
    states = put(folder, "s.json", json.dumps({"a": {"state": "OPEN"}, "b": {"state": "SENT"}}))
    rows = files.read_state_map(spark, states, StructType([StructField("state", StringType())]))
    assert collected(rows) == [("a", "OPEN"), ("b", "SENT")]
    store = f"{folder}/registry"
    for name in ("one", "two"):
        sinks.append_table(sinks.memory_event(spark, name, "text", {"k": 1}, "2024-01-01"), store)
    assert sinks.read_table(spark, store).count() == 2


def test_csv_and_manifest(spark, folder, bars):
    out = f"{folder}/out"
    sinks.write_csv(bars.select("symbol", (F.col("close") / 3).alias("x")).limit(1).union(spark.sql("select 'n', cast(null as double)")), out)
    text = sorted(r.value for r in spark.read.text(out).collect())
    assert any(line.endswith(",") or line.endswith(',""') for line in text) and any(len(line.split(".")[-1]) == 10 for line in text)
    row = json.loads(sinks.manifest(spark, {"b": 1, "a": "x"}, {"bars": bars}).first().manifest)
    assert list(row) == sorted(row) and len(row["artifacts"]["bars"]) == 64


def test_content_hash_ignores_order_and_sees_changes(bars):
    one = quality.content_hash(bars, "m").first()[0]
    assert one == quality.content_hash(bars.repartition(7).orderBy("close"), "m").first()[0]
    assert one != quality.content_hash(bars, "other").first()[0]
    assert one != quality.content_hash(bars.withColumn("volume", F.col("volume") + 1), "m").first()[0]
    assert one != quality.content_hash(bars.union(bars.limit(1)), "m").first()[0]


def test_order_violations(spark):
    rows = [("S", T0 + timedelta(minutes=m), i) for i, m in enumerate([0, 1, 3, 2, 4, 4])]
    bad = quality.order_violations(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long"), rows=2)
    assert sorted(r.seq for r in bad.collect()) == [3, 5]


def test_scaler_and_logistic(spark):
    rows = [(i, "S", T0 + timedelta(minutes=i), float(i), 1.0, float(i > 20)) for i in range(40)]
    train = spark.createDataFrame(rows, "id int, symbol string, ts timestamp_ntz, x double, flat double, y double")
    scaler = learning.fit_scaler(train, ["x", "flat"])
    assert scaler.deviations["flat"] == 1.0
    fitted = learning.fit_logistic(train, ["x", "flat"], "y", c=100.0)
    score = learning.accuracy(fitted.predict(train).withColumn("split", F.lit("train")), "y").first()
    assert score.accuracy == 1.0
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    learning.save(fitted, spark, path)
    again = learning.load(spark, path).predict(train)
    assert collected(again.select("id", "probability")) == collected(fitted.predict(train).select("id", "probability"))
    one = learning.fit_logistic(train.withColumn("y", F.lit(1.0)), ["x"], "y")
    assert one.constant == 1.0


def test_models_work_after_an_observation(spark):
    """A session that has observed a table can still fit, score and check a model; nulls score null."""
    rows = [(i, float(i % 7), float((i * 5) % 11), float((i * 3) % 10 > 4)) for i in range(200)]
    train = spark.createDataFrame(rows, "id int, a double, b double, y double")
    seen = Observation()
    train.observe(seen, F.max("a").alias("most")).write.format("noop").mode("overwrite").save()
    assert seen.get["most"] == 6.0
    fitted = learning.fit_logistic(train, ["a", "b"], "y")
    scored = fitted.predict(train)
    assert scored.count() == 200 and "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    assert all(abs(r.slope) < 1e-6 for r in learning.gradient(fitted, train).collect())
    a, b, y = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    z = np.stack([(a - a.mean()) / a.std(ddof=1), (b - b.mean()) / b.std(ddof=1)], 1)
    p = 1 / (1 + np.exp(-(z @ np.array(fitted.weights) + fitted.intercept)))
    got = [r.probability for r in scored.orderBy("id").collect()]
    assert np.allclose(got, p)
    c = learning.confusion(scored.withColumn("split", F.lit("all")), "y").first()
    assert (c.hits, c.false_alarms) == (int(((p > 0.5) & (y == 1)).sum()), int(((p > 0.5) & (y == 0)).sum()))
    hole = spark.createDataFrame([(1, None, 2.0, 1.0)], train.schema)
    assert fitted.predict(hole).first().probability is None


def test_research_run_is_deterministic(spark, bars):
    long = bars.filter("symbol <> 'CCC'")
    a, b = (research.research_run(long, MINUTE, research.Settings(iterations=30)) for _ in range(2))
    assert collected(a["metrics"]) == collected(b["metrics"])
    assert {r.split for r in a["split"].collect()} == {"train", "holdout"}


def test_grid_cap_is_deterministic(spark):
    grid = sweeps.param_grid(spark, {"a": list(range(20)), "b": list(range(10))})
    assert grid.count() == 200
    one, two = (collected(sweeps.cap_by_hash(g, "seed", 50)) for g in (grid, grid.orderBy(F.rand(3))))
    assert one == two and len(one) == 50
    assert sweeps.cap_by_hash(sweeps.param_grid(spark, {"a": [1, 2], "b": [3, 4]}), "seed", 50).count() == 4
    assert sweeps.cap_by_hash(grid, "seed").count() == 200


def test_hit_rate_of_seven_states(spark):
    states = ["hold", "buy", "buy", "hold", "hold", "hold", "sell"]
    closes = [10.0, 10.0, 11.0, 12.0, 12.0, 12.0, 11.0]
    rows = spark.createDataFrame([("S", T0 + timedelta(minutes=i), c, s) for i, (s, c) in enumerate(zip(states, closes))], "symbol string, ts timestamp_ntz, close double, state string")
    r = sweeps.hit_rates(sweeps.hit_rate_events(rows, MINUTE, [1])).first()
    assert (r.events, r.hits, r.excluded) == (1, 1, 1)


def test_stream_restart_equals_one_run(spark, folder, bars):
    """The query stops after half of the files and goes on from its checkpoint; the batch fold gives the same rows."""
    rows = bars.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close")
    cut = rows.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    source, out, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    for part in (F.col("ts") <= cut, F.col("ts") > cut):
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        done = live.drain(live.live_supertrend(stream), out, mark)
    batch = run(bars, MINUTE, trend.supertrend_voting())
    want = batch.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.round("stv_line", 6).alias("line"), "stv_direction", "stv_signal")
    assert collected(done.withColumn("line", F.round("line", 6))) == collected(want)


def test_strict_order_refuses_a_batch(spark):
    rows = spark.createDataFrame([("S", T0, 0), ("S", T0, 1)], "symbol string, ts timestamp_ntz, seq long")
    with pytest.raises(ValueError):
        live.strict_order(lambda df, epoch: None)(rows, 3)
    check = live.strict_order(lambda df, epoch: None)
    check(rows.limit(1), 0)
    with pytest.raises(ValueError):
        check(rows.limit(1), 1)


CHECKED = [
    "bars_hourly", "features_26", "ma_kalman", "osc_adx", "trend_supertrend", "structure_zigzag", "trades_bar", "metrics_max_drawdown", "fills_first_touch",
    "lifecycle_reconcile", "hit_rate_pooled", "stream_bars", "research_rule_run",
]


@pytest.mark.parametrize("name", CHECKED)
def test_registered_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    head = [d[0] for d in cur.description]
    assert sorted(head) == names
    text = lambda v: "" if v is None or v != v else repr(v + 0.0) if isinstance(v, float) else str(v)
    want = sorted(tuple(text(r[head.index(n)]) for n in names) for r in cur.fetchall())
    assert sorted(tuple(text(v) for v in r) for r in df.select(*names).collect()) == want


def test_every_query_has_a_name_and_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
