"""Registered queries: models, research runs, streams, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators.features import feature_names
from tapeline.plans import learning, research
from tapeline.plans.catalog.common import DAILY_SQL, DAY, HOURLY_SQL, TR_SQL, daily, hourly, price_ticks, register, rounded, table
from tapeline.plans.catalog.bars_and_features import FEATURE_SQL
from tapeline.plans.catalog.sources_and_sinks import scratch
from tapeline.plans.catalog.trading import FILL_SQL, METRIC_SQL, _drawdown_sql, _METRICS, example_orders, quoted_ticks
from tapeline.plans.catalog.trends import STV_SQL
from tapeline.session import materialize
from tapeline.sources import sinks
from tapeline.streaming import live

_RULE_SQL = f"""WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL},
l AS (SELECT *, lead(open, 1) OVER w AS ep, lead(open, 6) OVER w AS xp, lead(close, 5) OVER w / close - 1 AS f5 FROM feats WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
g AS (SELECT *, coalesce(close > sma_10 AND xp IS NOT NULL, false) AS traded, CASE WHEN close > sma_10 AND xp IS NOT NULL THEN ln(1 + 0.002 * (xp - ep - 30) / ep) ELSE 0 END AS lg FROM l),
eqy AS (SELECT *, 100000 * exp(sum(lg) OVER (PARTITION BY symbol ORDER BY pos)) AS equity FROM g),
lt AS MATERIALIZED (SELECT *, CASE WHEN traded THEN equity / exp(lg) * 0.002 / ep * (xp - ep - 30) END AS profit FROM eqy),
m AS (SELECT symbol, {METRIC_SQL}, round(avg(CASE WHEN f5 > 0 THEN 1 ELSE 0 END), 6) AS label_rate FROM lt WHERE traded GROUP BY symbol),
dd AS ({_drawdown_sql('lt', 'equity', 'pos', 100000.0).replace('d1 AS', 'WITH d1 AS', 1)})
SELECT symbol, trades, wins, losses, label_rate, {", ".join(f"round({n}, 2) AS {n}" for n in _METRICS)}, round(max_drawdown, 2) AS max_drawdown, round(max_drawdown_percent, 2) AS max_drawdown_percent FROM m JOIN dd USING (symbol)"""


def rule_run(s, d):
    out = research.rule_run(daily(s, d), DAY).withColumn("label_rate", F.round("label_rate", 6))
    return rounded(out, 2, *_METRICS, "max_drawdown", "max_drawdown_percent", plain=("symbol", "trades", "wins", "losses", "label_rate"))


register("research_rule_run", rule_run, _RULE_SQL.replace(", 4) AS", ", 6) AS"))


def _model_run(s, d, name):
    tables = research.research_run(daily(s, d), DAY, research.Settings())
    return tables[name]


register("research_model_metrics", lambda s, d: _model_run(s, d, "metrics"))
register("research_model_signals", lambda s, d: _model_run(s, d, "signals"))


def _scaled(s, d):
    usable = research.usable_rows(daily(s, d), DAY, research.Settings())
    names = ["return_1", "atr_14", "rsi_14", "relative_volume_10"]
    scaler = learning.fit_scaler(usable, names)
    cols = [F.round(f"_z_{n}", 8).alias(f"z_{n}") for n in names]
    return scaler.apply(usable).select("symbol", "ts", *cols)


_ALL = " AND ".join(f"{n} IS NOT NULL" for n in feature_names())
register(
    "model_scaler",
    _scaled,
    f"""WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL}, u AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) AS nx FROM feats), v AS (SELECT * FROM u WHERE nx IS NOT NULL AND {_ALL})
    SELECT symbol, ts, """
    + ", ".join(f"round(({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER (), 8) AS z_{n}" for n in ("return_1", "atr_14", "rsi_14", "relative_volume_10"))
    + " FROM v",
)


_USABLE = f"""{DAILY_SQL}, {FEATURE_SQL},
u AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY pos) AS nx FROM feats),
v AS MATERIALIZED (SELECT *, CASE WHEN nx / close - 1 > 0 THEN 1.0 ELSE 0.0 END AS y FROM u WHERE nx IS NOT NULL AND {_ALL})"""

# ridge on two scaled features: the normal equations of the centred values, by Cramer's rule
_RIDGE_SQL = f"""WITH RECURSIVE {_USABLE},
z AS (SELECT symbol, ts, nx / close - 1 AS t, (return_1 - avg(return_1) OVER ()) / stddev_samp(return_1) OVER () AS a, (rsi_14 - avg(rsi_14) OVER ()) / stddev_samp(rsi_14) OVER () AS b FROM v),
k AS (SELECT avg(t) AS m, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * t) AS va, sum(b * t) AS vb FROM z)
SELECT symbol, ts, round(m + (bb * va - ab * vb) / (aa * bb - ab * ab) * a + (aa * vb - ab * va) / (aa * bb - ab * ab) * b, 6) AS prediction FROM z, k"""

# logistic regression on one scaled feature: thirty Newton steps, each one aggregate over the rows
_LOGISTIC_SQL = f"""WITH RECURSIVE {_USABLE},
z AS MATERIALIZED (SELECT symbol, ts, y, (rsi_14 - avg(rsi_14) OVER ()) / stddev_samp(rsi_14) OVER () AS x FROM v),
n AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS c UNION ALL
  SELECT i + 1, w - (hcc * gw - hwc * gc) / (hww * hcc - hwc * hwc), c - (hww * gc - hwc * gw) / (hww * hcc - hwc * hwc)
  FROM (SELECT i, w, c, sum((p - y) * x) + w AS gw, sum(p - y) AS gc, sum(p * (1 - p) * x * x) + 1 AS hww, sum(p * (1 - p) * x) AS hwc, sum(p * (1 - p)) AS hcc
        FROM (SELECT i, w, c, x, y, 1 / (1 + exp(-(c + w * x))) AS p FROM n, z WHERE i < 30) GROUP BY i, w, c)),
f AS (SELECT symbol, ts, y, 1 / (1 + exp(-(c + w * x))) AS p FROM z, n WHERE i = 30)"""


def _usable(s, d):
    return materialize(research.usable_rows(daily(s, d), DAY, research.Settings()))


def _ridge(s, d):
    usable = _usable(s, d)
    fitted = learning.fit_ridge(usable, ["return_1", "rsi_14"], "future_return_5")
    return fitted.predict(usable).select("symbol", "ts", F.round("prediction", 6).alias("prediction"))


def _logistic(s, d):
    usable = _usable(s, d)
    return learning.fit_logistic(usable, ["rsi_14"], "label").predict(usable)


def _gradient(s, d):
    """At the optimum every slope is near 0: six digits of it."""
    usable, names = _usable(s, d), list(feature_names())
    fitted = learning.fit_logistic(usable, names, "label", population=True)
    return learning.gradient(fitted, usable).select("feature", (F.abs("slope") < 1e-5).alias("settled"))


def _saved_model(s, d):
    """The model of model_logistic after a round trip through its table."""
    usable = _usable(s, d)
    path = f"{scratch(s)}/model"
    learning.save(learning.fit_logistic(usable, ["rsi_14"], "label"), s, path)
    scored = learning.load(s, path).predict(usable)
    return scored.groupBy("symbol").agg(F.count("*").alias("rows"), F.round(F.avg("probability"), 4).alias("mean_probability"))


def _majority(s, d):
    """Training labels of one class: that class is the constant prediction."""
    usable = _usable(s, d)
    fitted = learning.fit_logistic(usable.filter("label = 1"), ["rsi_14"], "label")
    return learning.accuracy(fitted.predict(usable), "label", ("symbol",)).withColumn("accuracy", F.round("accuracy", 8))


register("model_ridge", _ridge, _RIDGE_SQL)
register(
    "model_logistic", lambda s, d: _logistic(s, d).select("symbol", "ts", F.round("probability", 4).alias("probability")),
    _LOGISTIC_SQL + " SELECT symbol, ts, round(p, 4) AS probability FROM f",
)
register(
    "model_confusion", lambda s, d: learning.confusion(_logistic(s, d), "label", ("symbol",)),
    _LOGISTIC_SQL + """ SELECT symbol, count(*) FILTER (p > 0.5 AND y = 1) AS hits, count(*) FILTER (p > 0.5 AND y = 0) AS false_alarms,
    count(*) FILTER (p <= 0.5 AND y = 1) AS misses, count(*) FILTER (p <= 0.5 AND y = 0) AS right_rejections FROM f GROUP BY 1""",
)
register(
    "model_gradient", _gradient,
    " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) > 0 AS settled FROM orders" for n in ("intercept", *feature_names())),
)
register("model_saved", _saved_model, _LOGISTIC_SQL + " SELECT symbol, count(*) AS rows, round(avg(p), 4) AS mean_probability FROM f GROUP BY 1")
register("model_majority", _majority, f"WITH RECURSIVE {_USABLE} SELECT symbol, count(*) AS rows, round(avg(y), 8) AS accuracy FROM v GROUP BY 1")
register(
    "sink_csv_columns",
    lambda s, d: sinks.csv_columns(hourly(s, d).select("symbol", "ts", (F.col("close") / 3).alias("third"))),
    f"WITH {HOURLY_SQL} SELECT symbol, ts, printf('%.10f', round(close / 3, 10)) AS third FROM b",
)
register("sink_manifest", lambda s, d: sinks.manifest(s, {"run": "hourly", "version": "1"}, {"bars": hourly(s, d)}))

# -- streams ----------------------------------------------------------------------------------------------------


def _stream(s, df):
    """A stream over the files of a table."""
    path = materialize(df).inputFiles()[0].rsplit("/", 1)[0]
    return s.readStream.schema(df.schema).parquet(path)


def _zoned(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_ts(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


register(
    "stream_bars",
    lambda s, d: _plain_ts(live.drain(live.live_bars(_zoned(_stream(s, price_ticks(s, d))), "1h")), "ts"),
    f"""WITH {HOURLY_SQL} SELECT symbol, ts, open, high, low, close, volume FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE value > 0)""",
)
register(
    "stream_supertrend",
    lambda s, d: _plain_ts(live.drain(live.live_supertrend(_zoned(_stream(s, daily(s, d))))), "ts").select(
        "symbol", "ts", F.round("line", 3).alias("line"), "direction", "signal"
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {STV_SQL} SELECT symbol, ts, round(CASE WHEN side = 1 THEN dn ELSE up END, 3) AS line,
    CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS direction, CASE WHEN side > before THEN 'buy' WHEN side < before THEN 'sell' ELSE 'hold' END AS signal FROM sv JOIN b USING (symbol, pos)""",
)


def _stream_fills(s, d, rows=2_000_000):
    """Ticks and orders arrive in slices of time, so what a micro-batch holds does not grow with the tables."""
    ticks = quoted_ticks(s, d)
    orders = example_orders(s, d).withColumn("seq", F.substring("trade_id", 2, 20).cast("long"))
    bounds = live.time_slices(ticks, rows=rows)
    feeds = [df.withColumn("_slice", live.slice_of(bounds)) for df in (ticks, orders)]
    if bounds:
        feeds = [materialize(feed.repartitionByRange("_slice", "ts")) for feed in feeds]
    base = scratch(s)
    streams = []
    for i in range(len(bounds) + 1):
        for name, feed in zip(("ticks", "orders"), feeds):
            part = feed.filter(F.col("_slice") == i).drop("_slice")
            part.write.mode("append").parquet(f"{base}/{name}")
            if not i:
                streams.append(_zoned(s.readStream.schema(part.schema).parquet(f"{base}/{name}")))
        out = live.drain(live.live_fills(streams[1], streams[0], slippage=0.02), f"{base}/fills", f"{base}/checkpoint")
    return _plain_ts(out, "exit_ts").select("trade_id", "symbol", "exit_reason", "exit_ts", F.round("exit_price", 6).alias("exit_price"))


register(
    "stream_fills",
    _stream_fills,
    f"WITH {FILL_SQL} SELECT trade_id, symbol, exit_reason, exit_ts, round(exit_price, 6) AS exit_price FROM fp WHERE exit_pos IS NOT NULL",
)


def _stream_alerts(s, d):
    log = table(s, d, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(F.col("user_id") % 40 == 0, "trade_rejected").otherwise(F.col("event_type")).alias("event"), F.col("event_type").alias("message"),
    )
    return _plain_ts(live.drain(live.live_alerts(_zoned(_stream(s, log)), 7200.0)), "ts").select("level", "event", "message", "ts")


register(
    "stream_alerts",
    _stream_alerts,
    """WITH RECURSIVE a AS MATERIALIZED (SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN user_id % 40 = 0 THEN 'trade_rejected' ELSE event_type END AS event, event_type AS message, ts FROM events
    WHERE event_type = 'error' OR user_id % 40 = 0), r AS (SELECT level, event, message, min(ts) AS ts FROM a GROUP BY 1, 2, 3
    UNION ALL SELECT r.level, r.event, r.message, min(a.ts) FROM r JOIN a ON a.level = r.level AND a.event = r.event AND a.message = r.message AND a.ts >= r.ts + INTERVAL 2 HOUR GROUP BY 1, 2, 3)
    SELECT level, event, message, ts FROM r""",
)


def _stream_orders(s, d):
    from tapeline.plans.catalog.trading import _copied_orders

    rows = _copied_orders(s, d).select("trade_id", "symbol", "ts")
    return live.drain(live.unique_stream(_zoned(_stream(s, rows)), "40000 days")).select("trade_id")


register("stream_unique_orders", _stream_orders, "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS trade_id FROM orders")
