"""Registered queries: bars, sessions, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import bars as ops
from tapeline.operators import features
from tapeline.plans.catalog.common import (
    DAILY_SQL, DAY, HA_SQL, HOUR, HOURLY_SQL, daily, ewm_sql, hourly, order_ticks, price_ticks, register, rounded,
)

register("bars_daily", daily, f"WITH {DAILY_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars")
register("bars_hourly", hourly, f"WITH {HOURLY_SQL} SELECT symbol, ts, open, high, low, close, volume FROM bars")

register(
    "bars_resample_4h",
    lambda s, d: ops.resample(hourly(s, d), "4h"),
    f"""WITH {HOURLY_SQL} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
    arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume
    FROM b GROUP BY 1, 2""",
)
register(
    "bars_resample_weekly",
    lambda s, d: ops.resample(daily(s, d), "1w"),
    f"""WITH {DAILY_SQL}, o AS (SELECT symbol, date_trunc('day', min(ts)) AS origin FROM b GROUP BY 1)
    SELECT symbol, CAST(origin + to_days(CAST(floor(date_diff('day', origin, ts) / 7) * 7 AS INTEGER)) AS TIMESTAMP) AS ts,
    arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume
    FROM b JOIN o USING (symbol) GROUP BY 1, 2""",
)
register(
    "bars_resample_tail",
    lambda s, d: ops.resample(hourly(s, d), "1d", limit=10),
    f"""WITH {HOURLY_SQL}, r AS (SELECT symbol, date_trunc('day', b.ts) AS ts, arg_min(open, b.ts) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2)
    SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, open, high, low, close, volume FROM r
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10""",
)
register(
    "bars_heikin_ashi",
    lambda s, d: rounded(ops.heikin_ashi(daily(s, d), DAY), 6, "open", "high", "low", "close"),
    f"""WITH RECURSIVE {DAILY_SQL}, {HA_SQL} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high,
    round(low, 6) AS low, round(close, 6) AS close FROM ha""",
)
register(
    "bars_to_path",
    lambda s, d: ops.bars_to_path(hourly(s, d)),
    f"""WITH {HOURLY_SQL}, legs AS (SELECT symbol, ts, unnest([0, 1, 2, 3]) AS leg,
    unnest(CASE WHEN close >= open THEN [open, high, low, close] ELSE [open, low, high, close] END) AS price FROM b)
    SELECT symbol, ts, leg, price, strftime(ts, '%Y-%m-%d %H:%M:%S') || '#' || leg AS tick_id FROM legs""",
)
register(
    "bars_last_50",
    lambda s, d: ops.last_n(daily(s, d), 50, DAY),
    f"WITH {DAILY_SQL} SELECT symbol, ts, open, high, low, close, volume FROM b WHERE pos >= total - 50",
)
register(
    "calendar_windows_base",
    lambda s, d: ops.calendar_windows(daily(s, d), DAY, 250).select("symbol", "ts", "close", "window_id"),
    f"WITH {DAILY_SQL} SELECT symbol, ts, close, pos // 250 AS window_id FROM b",
)
register(
    "calendar_windows_higher",
    lambda s, d: ops.calendar_windows(hourly(s, d), HOUR, 100, ops.resample(hourly(s, d), "4h")).select(
        "symbol", "ts", "close", "window_id"
    ),
    f"""WITH {HOURLY_SQL}, w AS (SELECT symbol, pos // 100 AS window_id, min(ts) AS f, max(ts) AS t FROM b GROUP BY 1, 2),
    h AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, b.ts) AS close
    FROM b GROUP BY 1, 2)
    SELECT h.symbol, h.ts, h.close, window_id FROM h JOIN w ON h.symbol = w.symbol AND h.ts BETWEEN f AND t""",
)
register(
    "trading_session",
    lambda s, d: hourly(s, d).select("symbol", "ts", ops.trading_session("ts").alias("session")),
    f"""WITH {HOURLY_SQL}, z AS (SELECT symbol, ts, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney') AS sy,
    hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo') AS tk, hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS ld,
    hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS ny FROM b)
    SELECT symbol, ts, CASE WHEN ny >= 8 AND ny < 17 THEN 'New York' WHEN ld >= 8 AND ld < 17 THEN 'London'
    WHEN tk >= 9 AND tk < 18 THEN 'Tokyo' WHEN sy >= 7 AND sy < 16 THEN 'Sydney' END AS session FROM z""",
)
register(
    "time_of_day_filters",
    lambda s, d: hourly(s, d).select(
        "symbol",
        "ts",
        ops.in_hours("ts", 8, 15).alias("in_hours"),
        ops.in_minutes("ts", "09:30", "16:00").alias("in_minutes"),
    ),
    f"""WITH {HOURLY_SQL} SELECT symbol, ts, hour(ts) BETWEEN 8 AND 15 AS in_hours,
    strftime(ts, '%H:%M') BETWEEN '09:30' AND '16:00' AS in_minutes FROM b""",
)
for _name, _start in (("tokyo", 0), ("london", 7)):
    register(
        f"session_range_{_name}",
        lambda s, d, h=_start: rounded(
            ops.session_range(hourly(s, d), f"{h:02d}:00", 8, "1h"), 6, "high", "low", "range", plain=("symbol", "day")
        ),
        f"""WITH {HOURLY_SQL} SELECT symbol, CAST(ts AS DATE) AS day, round(max(high), 6) AS high, round(min(low), 6) AS low,
        round(max(high) - min(low), 6) AS range FROM b WHERE hour(ts) >= {_start} AND hour(ts) < {_start + 8} GROUP BY 1, 2""",
    )
register(
    "clock_offset",
    lambda s, d: ops.clock_offset(
        price_ticks(s, d).withColumn("ingest_ts", F.timestamp_add("SECOND", -(F.col("seq") % 3 + 6500), F.col("ts")))
    ),
    """SELECT event_type AS symbol, CAST(coalesce(round(avg(CASE WHEN dayofweek(seen) NOT IN (0, 6)
    THEN g END) / 3600), 3) AS INTEGER) AS offset_hours
    FROM (SELECT *, event_id % 3 + 6500 AS g, ts - to_seconds(event_id % 3 + 6500) AS seen FROM events WHERE value > 0)
    GROUP BY 1""",
)
register(
    "previous_day_levels",
    lambda s, d: ops.previous_day_levels(hourly(s, d)).select("symbol", "ts", "prev_high", "prev_low"),
    f"""WITH {HOURLY_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l FROM b GROUP BY 1, 2),
    g AS (SELECT symbol, day, lag(h) OVER w AS prev_high, lag(l) OVER w AS prev_low FROM d
    WINDOW w AS (PARTITION BY symbol ORDER BY day))
    SELECT b.symbol, b.ts, prev_high, prev_low FROM b JOIN g ON b.symbol = g.symbol AND CAST(b.ts AS DATE) = g.day""",
)

_W = "OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W9, _W13 = _W.format(n=9), _W.format(n=13)
FEATURE_SQL = f"""
{ewm_sql("e", "b", "close", "1 - 2.0 / 11")},
f1 AS (SELECT b.*, e.v AS ema, lag(close) OVER w AS p1, lag(close, 3) OVER w AS p3, lag(close, 5) OVER w AS p5,
  lag(close, 10) OVER w AS p10, lag(volume) OVER w AS pv FROM b JOIN e ON b.symbol = e.symbol AND b.pos = e.pos
  WINDOW w AS (PARTITION BY b.symbol ORDER BY b.pos)),
f2 AS (SELECT *, close / p1 - 1 AS return_1, CASE WHEN p1 IS NOT NULL THEN greatest(high - low, abs(high - p1), abs(low - p1)) END AS true_range,
  CASE WHEN p1 IS NOT NULL THEN greatest(close - p1, 0) END AS gain, CASE WHEN p1 IS NOT NULL THEN greatest(p1 - close, 0) END AS loss FROM f1),
f3 AS (SELECT *, avg(true_range) {_W13} AS atr_14, stddev_samp(return_1) {_W9} AS rolling_std_10, avg(close) {_W9} AS sma_10,
  avg(gain) {_W13} AS g, avg(loss) {_W13} AS l, avg(volume) {_W9} AS volume_mean_10 FROM f2),
feats AS MATERIALIZED (SELECT symbol, ts, pos, open, high, low, close, volume, return_1, close / p3 - 1 AS return_3, close / p5 - 1 AS return_5,
  close / p10 - 1 AS return_10, ln(close / p1) AS log_return_1, true_range, CASE WHEN pos >= 14 THEN atr_14 END AS atr_14,
  CASE WHEN pos >= 10 THEN rolling_std_10 END AS rolling_std_10, CASE WHEN pos >= 10 THEN rolling_std_10 / close END AS normalized_volatility,
  CASE WHEN pos >= 9 THEN sma_10 END AS sma_10, CASE WHEN pos >= 9 THEN ema END AS ema_10,
  CASE WHEN pos >= 9 THEN close / sma_10 - 1 END AS price_vs_sma_10, CASE WHEN pos >= 9 THEN close / ema - 1 END AS price_vs_ema_10,
  CASE WHEN pos >= 9 THEN ema / sma_10 - 1 END AS ema_relationship,
  CASE WHEN pos < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END AS rsi_14,
  close / p10 - 1 AS roc_10, close - p10 AS momentum_10, high - low AS range, close - open AS body,
  high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick,
  (close - open) / nullif(high - low, 0) AS body_range_ratio, (close - low) / nullif(high - low, 0) AS close_position,
  volume / nullif(pv, 0) - 1 AS volume_change_1, CASE WHEN pos >= 9 THEN volume_mean_10 END AS volume_mean_10,
  CASE WHEN pos >= 9 THEN volume / nullif(volume_mean_10, 0) END AS relative_volume_10 FROM f3)"""
_LARGE = {"true_range", "atr_14", "sma_10", "ema_10", "momentum_10", "range", "body", "upper_wick", "lower_wick"}


def _digits(name: str) -> int:
    return 3 if name in _LARGE else 6 if name == "rsi_14" else 9


def _feature_query(spark, sf_dir, drop):
    out = features.build_features(daily(spark, sf_dir), DAY, drop_warmup=drop)
    return out.select("symbol", "ts", *[F.round(n, _digits(n)).alias(n) for n in features.feature_names()])


_FEATURE_COLS = ", ".join(f"round({n}, {_digits(n)}) AS {n}" for n in features.feature_names())
_ALL_KNOWN = " AND ".join(f"{n} IS NOT NULL" for n in features.feature_names())
register(
    "features_26",
    lambda s, d: _feature_query(s, d, False),
    f"WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL} SELECT symbol, ts, {_FEATURE_COLS} FROM feats",
)
register(
    "features_26_drop_warmup",
    lambda s, d: _feature_query(s, d, True),
    f"WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL} SELECT symbol, ts, {_FEATURE_COLS} FROM feats WHERE {_ALL_KNOWN}",
)


def _metadata(spark, sf_dir):
    bars = daily(spark, sf_dir)
    meta = features.feature_metadata(bars, features.build_features(bars, DAY))
    return meta.withColumn("features", F.array_join("features", ","))


register(
    "features_metadata",
    _metadata,
    f"""WITH RECURSIVE {DAILY_SQL}, {FEATURE_SQL} SELECT '{",".join(features.feature_names())}' AS features, 26 AS feature_count,
    (SELECT count(*) FROM b) AS input_rows, (SELECT count(*) FROM feats WHERE {_ALL_KNOWN}) AS output_rows,
    (SELECT count(*) FROM b) - (SELECT count(*) FROM feats WHERE {_ALL_KNOWN}) AS dropped_rows, 'drop' AS warmup_policy, '1' AS version""",
)
