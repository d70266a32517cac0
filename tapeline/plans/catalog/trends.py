"""Registered queries: trend-state indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import moving_averages as ma
from tapeline.operators import oscillators as osc
from tapeline.operators import trend
from tapeline.operators.bars import in_hours, resample
from tapeline.operators.steps import run
from tapeline.plans.catalog.averages_and_oscillators import (
    CCI_SQL, RSI_SQL, VIDYA_SQL, atr_sql, avg_sql, kalman_sql, macd_sql, wma_sql,
)
from tapeline.plans.catalog.common import (
    DAILY_SQL, DAY, HA_SQL, HOUR, HOURLY_SQL, TR_SQL, daily, ewm_sql, hourly, register, rounded,
)


def query(step, digits, values, plain):
    return lambda s, d: rounded(run(daily(s, d), DAY, step), digits, *values, plain=("symbol", "ts", *plain))


def supertrend_sql(name: str, n: int, mult: float, source: str = "b") -> str:
    """CTE ``name(symbol, pos, up, dn, side, before, pc)``; needs true ranges of ``source`` in ``t``."""
    return f"""
{ewm_sql(name + '_a', 't', 'tr', f'{n - 1}.0 / {n}')},
{name}_x AS MATERIALIZED (SELECT s.symbol, s.pos, close, (high + low) / 2 - {mult} * v AS lo, (high + low) / 2 + {mult} * v AS hi
  FROM {source} s JOIN {name}_a USING (symbol, pos)),
{name} AS (SELECT symbol, pos, lo AS up, hi AS dn, CASE WHEN close < lo THEN -1 ELSE 1 END AS side, NULL::INTEGER AS before, close AS pc FROM {name}_x WHERE pos = 0
  UNION ALL SELECT symbol, pos, up, dn, CASE WHEN ps = -1 AND close > dn THEN 1 WHEN ps = 1 AND close < up THEN -1 ELSE ps END, ps, close FROM (
  SELECT x.symbol, x.pos, x.close, CASE WHEN s.pc > s.up THEN greatest(lo, s.up) ELSE lo END AS up, CASE WHEN s.pc < s.dn THEN least(hi, s.dn) ELSE hi END AS dn, s.side AS ps
  FROM {name} s JOIN {name}_x x ON x.symbol = s.symbol AND x.pos = s.pos + 1) q)"""


ST_COLS = """CASE WHEN side = 1 THEN up ELSE dn END AS st_value, CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS st_position,
CASE WHEN before IS NULL THEN NULL WHEN side > before THEN 'buy' WHEN side < before THEN 'sell' ELSE 'hold' END AS st_signal"""
register(
    "trend_supertrend",
    query(trend.supertrend(), 3, ["st_value"], ["st_position", "st_signal"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {supertrend_sql('st', 10, 3.0)},
    r AS (SELECT symbol, pos, {ST_COLS} FROM st) SELECT symbol, ts, round(st_value, 3) AS st_value, st_position, st_signal FROM r JOIN b USING (symbol, pos)""",
)
HA_TR_SQL = f"{HA_SQL}, " + TR_SQL.replace(" FROM b)", " FROM ha)")
register(
    "trend_supertrend_heikin_ashi",
    lambda s, d: rounded(
        trend.laid_heikin_ashi(daily(s, d), DAY, trend.supertrend()), 3, "st_value", plain=("symbol", "ts", "st_position", "st_signal")
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {HA_TR_SQL}, {supertrend_sql('st', 10, 3.0, 'ha')},
    r AS (SELECT symbol, pos, {ST_COLS} FROM st) SELECT symbol, ts, round(st_value, 3) AS st_value, st_position, st_signal FROM r JOIN b USING (symbol, pos)""",
)
STV_SQL = f"""
{ewm_sql('sva', 't', 'tr', '9.0 / 10')},
svx AS MATERIALIZED (SELECT s.symbol, s.pos, close, (high + low) / 2 - 3 * v AS lo, (high + low) / 2 + 3 * v AS hi FROM b s JOIN sva USING (symbol, pos)),
sv AS (SELECT symbol, pos, lo AS dn, hi AS up, 1 AS side, 1 AS before FROM svx WHERE pos = 0
  UNION ALL SELECT x.symbol, x.pos, CASE WHEN s.side = 1 THEN greatest(lo, s.dn) ELSE lo END, CASE WHEN s.side = -1 THEN least(hi, s.up) ELSE hi END,
  CASE WHEN s.side = -1 AND close > s.up THEN 1 WHEN s.side = 1 AND close < s.dn THEN -1 ELSE s.side END, s.side
  FROM sv s JOIN svx x ON x.symbol = s.symbol AND x.pos = s.pos + 1)"""
register(
    "trend_supertrend_voting",
    query(trend.supertrend_voting(), 3, ["stv_line"], ["stv_direction", "stv_signal"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {STV_SQL} SELECT symbol, ts, round(CASE WHEN side = 1 THEN dn ELSE up END, 3) AS stv_line,
    CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS stv_direction, CASE WHEN side > before THEN 'buy' WHEN side < before THEN 'sell' ELSE 'hold' END AS stv_signal
    FROM sv JOIN b USING (symbol, pos)""",
)
SAR_SQL = """
sx AS MATERIALIZED (SELECT symbol, pos, high, low, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
sar AS (SELECT symbol, pos, low AS sar, high AS ep, 0.02::DOUBLE AS af, 1 AS side FROM sx WHERE pos = 0
  UNION ALL SELECT symbol, pos, CASE WHEN hit THEN ep WHEN side = 1 THEN least(raw, l1, coalesce(l2, l1)) ELSE greatest(raw, h1, coalesce(h2, h1)) END,
  CASE WHEN hit THEN CASE WHEN side = 1 THEN low ELSE high END WHEN side = 1 THEN greatest(high, ep) ELSE least(low, ep) END,
  CASE WHEN hit THEN 0.02::DOUBLE WHEN side = 1 AND high > ep OR side = -1 AND low < ep THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END,
  CASE WHEN hit THEN -side ELSE side END FROM (
  SELECT *, CASE WHEN side = 1 THEN low <= raw ELSE high >= raw END AS hit FROM (
  SELECT x.*, s.ep, s.af, s.side, s.sar + s.af * (s.ep - s.sar) AS raw FROM sar s JOIN sx x ON x.symbol = s.symbol AND x.pos = s.pos + 1) q) q2)"""
register(
    "trend_sar",
    query(trend.sar(), 3, ["sar", "sar_trend"], ["sar_signal"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {SAR_SQL}, j AS (SELECT symbol, ts, pos, open, close, sar, side, lag(open) OVER w AS po, lag(sar) OVER w AS ps FROM sar JOIN b USING (symbol, pos)
    WINDOW w AS (PARTITION BY symbol ORDER BY pos)) SELECT symbol, ts, round(sar, 3) AS sar, CAST(side AS DOUBLE) AS sar_trend,
    CASE WHEN po > ps AND close < sar THEN 'sell' WHEN po < ps AND close > sar THEN 'buy' END AS sar_signal FROM j""",
)
UT_SQL = f"""{atr_sql('ua', 10)},
ux AS MATERIALIZED (SELECT b.symbol, b.pos, close, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.pos) AS pc, 3 * atr AS w FROM b LEFT JOIN ua USING (symbol, pos)),
ut AS (SELECT symbol, pos, 0.0::DOUBLE AS stop FROM ux WHERE pos = 0
  UNION ALL SELECT x.symbol, x.pos, CASE WHEN close > stop AND pc > stop THEN CASE WHEN w IS NULL THEN stop ELSE greatest(stop, close - w) END
  WHEN close < stop AND pc < stop THEN CASE WHEN w IS NULL THEN stop ELSE least(stop, close + w) END WHEN close > stop THEN close - w ELSE close + w END
  FROM ut u JOIN ux x ON x.symbol = u.symbol AND x.pos = u.pos + 1),
uj AS (SELECT symbol, pos, stop, close, lag(stop) OVER w AS ps, lag(close) OVER w AS pc FROM ut JOIN b USING (symbol, pos) WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
us AS MATERIALIZED (SELECT symbol, pos, stop, coalesce(last_value(CASE WHEN pc < ps AND close > stop THEN 'long' WHEN pc > ps AND close < stop THEN 'short' END IGNORE NULLS)
  OVER (PARTITION BY symbol ORDER BY pos), 'No Signal') AS ut_state FROM uj)"""
register(
    "trend_ut_bot",
    query(trend.ut_bot(), 3, ["ut_stop"], ["ut_state"]),
    f"WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {UT_SQL} SELECT symbol, ts, round(stop, 3) AS ut_stop, ut_state FROM us JOIN b USING (symbol, pos)",
)
HT_SQL = """
hx AS MATERIALIZED (SELECT symbol, pos, high, low, close, CASE WHEN pos >= 1 THEN greatest(high, lag(high) OVER w) END AS hp, CASE WHEN pos >= 1 THEN least(low, lag(low) OVER w) END AS lp,
  (high + lag(high) OVER w) / 2 AS hm, (low + lag(low) OVER w) / 2 AS lm, coalesce(lag(high) OVER w, high) AS ph, coalesce(lag(low) OVER w, low) AS pl FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
ht AS (SELECT symbol, pos, 0 AS trend, 0 AS nxt, low AS maxlow, high AS minhigh, low AS up, NULL::DOUBLE AS down FROM hx WHERE pos = 0
  UNION ALL SELECT symbol, pos, trend, nxt, maxlow, minhigh,
  CASE WHEN trend = 0 THEN CASE WHEN before <> 0 THEN pdown ELSE greatest(coalesce(pup, maxlow), maxlow) END END,
  CASE WHEN trend = 1 THEN CASE WHEN before <> 1 THEN pup ELSE least(coalesce(pdown, minhigh), minhigh) END END FROM (
  SELECT symbol, pos, before, pup, pdown, CASE WHEN dn THEN 1 WHEN ups THEN 0 ELSE before END AS trend, CASE WHEN dn THEN 0 WHEN ups THEN 1 ELSE pn END AS nxt,
  CASE WHEN ups THEN lp ELSE ml END AS maxlow, CASE WHEN dn THEN hp ELSE mh END AS minhigh FROM (
  SELECT *, pn = 1 AND hm < ml AND close < pl AS dn, pn = 0 AND lm > mh AND close > ph AS ups FROM (
  SELECT x.*, h.trend AS before, h.nxt AS pn, h.up AS pup, h.down AS pdown, CASE WHEN h.nxt = 1 THEN greatest(lp, h.maxlow) ELSE h.maxlow END AS ml,
  CASE WHEN h.nxt = 0 THEN least(hp, h.minhigh) ELSE h.minhigh END AS mh FROM ht h JOIN hx x ON x.symbol = h.symbol AND x.pos = h.pos + 1) q) q2) q3)"""
register(
    "trend_half_trend",
    query(trend.half_trend(), 4, ["ht_line", "ht_high", "ht_low"], ["ht_position"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {HT_SQL}, ch AS (SELECT symbol, pos, ts, CASE WHEN pos >= 100 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) END AS half FROM t),
    hl AS (SELECT symbol, ts, CASE WHEN trend = 0 THEN up ELSE down END AS line, trend, half FROM ht JOIN ch USING (symbol, pos))
    SELECT symbol, ts, round(line, 4) AS ht_line, round(line + half, 4) AS ht_high, round(line - half, 4) AS ht_low, CASE WHEN trend = 0 THEN 'long' ELSE 'short' END AS ht_position FROM hl""",
)
register(
    "trend_half_trend_voting",
    query(trend.half_trend_voting(), 3, ["htv_line"], ["htv_direction", "htv_signal"]),
    f"""WITH {DAILY_SQL} SELECT symbol, ts, round(least(low, lag(low) OVER (PARTITION BY symbol ORDER BY pos)), 3) AS htv_line, 'long' AS htv_direction, 'hold' AS htv_signal FROM b""",
)


def _jma_sql(name: str, x: str) -> str:
    beta = 0.45 * 4 / (0.45 * 4 + 2)
    return f"""
{name} AS (SELECT symbol, pos, {x} AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2, {x} AS v FROM b WHERE pos = 0
  UNION ALL SELECT symbol, pos, e0, e1, e2, e2 + pv FROM (SELECT *, (e0 + 1.53 * e1 - pv) * ((1 - {beta}) ** 2) + ({beta} ** 2) * pe2 AS e2 FROM (
  SELECT *, (x - e0) * (1 - {beta}) + {beta} * pe1 AS e1 FROM (
  SELECT b.symbol, b.pos, b.{x} AS x, (1 - {beta}) * b.{x} + {beta} * e.e0 AS e0, e.e1 AS pe1, e.e2 AS pe2, e.v AS pv
  FROM {name} e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1) q) q2) q3)"""


def _latch_sql(high: str, low: str) -> str:
    return f"""last_value(CASE WHEN pos = 0 THEN 0 WHEN close > {high} THEN 1 WHEN close < {low} THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos)"""


def _hma_raw(x: str, n: int) -> str:
    return f"2 * {wma_sql(x, n // 2)} - {wma_sql(x, n)}"


SSL_SQL = f"""{TR_SQL}, {ewm_sql('srm', 't', 'tr', '1 - 2.0 / 61')}, {_jma_sql('jh', 'high')}, {_jma_sql('jl', 'low')},
s1 AS MATERIALIZED (SELECT *, {wma_sql('tr', 14)} AS atr, {_hma_raw('close', 60)} AS rc, {_hma_raw('high', 60)} AS rh, {_hma_raw('low', 60)} AS rl,
  {_hma_raw('high', 15)} AS xh, {_hma_raw('low', 15)} AS xl FROM t),
s2 AS MATERIALIZED (SELECT s1.symbol, s1.ts, s1.pos, s1.close, s1.atr, srm.v AS rm, {wma_sql('rc', 7, 59).replace('symbol', 's1.symbol').replace('pos', 's1.pos')} AS base, {wma_sql('rh', 7, 59).replace('symbol', 's1.symbol').replace('pos', 's1.pos')} AS bh,
  {wma_sql('rl', 7, 59).replace('symbol', 's1.symbol').replace('pos', 's1.pos')} AS bl, {wma_sql('xh', 3, 14).replace('symbol', 's1.symbol').replace('pos', 's1.pos')} AS eh, {wma_sql('xl', 3, 14).replace('symbol', 's1.symbol').replace('pos', 's1.pos')} AS el, jh.v AS sh, jl.v AS sl
  FROM s1 JOIN srm USING (symbol, pos) JOIN jh USING (symbol, pos) JOIN jl USING (symbol, pos)),
s3 AS (SELECT *, CASE WHEN {_latch_sql('bh', 'bl')} < 0 THEN bh ELSE bl END AS ssl1, CASE WHEN {_latch_sql('sh', 'sl')} < 0 THEN sh ELSE sl END AS ssl2,
  CASE WHEN {_latch_sql('eh', 'el')} < 0 THEN eh ELSE el END AS ssl_exit FROM s2),
s4 AS (SELECT *, CASE WHEN atr IS NOT NULL THEN 100 * (rank() OVER (PARTITION BY symbol ORDER BY atr NULLS LAST) + (count(*) OVER (PARTITION BY symbol, atr) - 1) / 2.0) / count(atr) OVER (PARTITION BY symbol) END AS pct,
  abs(close - base) / atr AS away FROM s3)"""
_COLOR = "CASE WHEN close > {0} THEN 'blue' WHEN close < {1} THEN 'red' ELSE 'gray' END"
register(
    "trend_ssl_hybrid",
    lambda s, d: rounded(
        trend.ssl_hybrid(daily(s, d), DAY).withColumns({c: F.round(c) for c in ("baseline", "ssl1", "ssl_exit", "upperk", "lowerk")}), 3, "atr_upper", "atr_lower", "baseline", "ssl1", "ssl2", "ssl_exit", "upperk", "lowerk", "atr_percentile",
        plain=("symbol", "ts", "baseline_color", "ssl1_color", "ssl2_color", "ssl_exit_color", "risk_level", "entry_distance"),
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {SSL_SQL} SELECT symbol, ts, round(close + atr, 3) AS atr_upper, round(close - atr, 3) AS atr_lower, round(base, 0) AS baseline,
    round(ssl1, 0) AS ssl1, round(ssl2, 3) AS ssl2, round(ssl_exit, 0) AS ssl_exit, round(base + 0.2 * rm, 0) AS upperk, round(base - 0.2 * rm, 0) AS lowerk,
    round(pct, 3) AS atr_percentile, {_COLOR.format('base + 0.2 * rm', 'base - 0.2 * rm')} AS baseline_color, {_COLOR.format('ssl1', 'ssl1')} AS ssl1_color,
    {_COLOR.format('ssl2', 'ssl2')} AS ssl2_color, {_COLOR.format('ssl_exit', 'ssl_exit')} AS ssl_exit_color,
    CASE WHEN (pct / 100) ** 2 * 100 > 75 THEN 'High' WHEN (pct / 100) ** 2 * 100 < 25 THEN 'Low' ELSE 'Normal' END AS risk_level,
    CASE WHEN away < 1 THEN 'Near' WHEN away < 2 THEN 'Extended' ELSE 'Far' END AS entry_distance FROM s4""",
)
register(
    "trend_kalman",
    lambda s, d: rounded(
        trend.laid_heikin_ashi(daily(s, d), DAY, trend.kalman_trend()), 3, "kalman_short", "kalman_long", plain=("symbol", "ts", "kalman_trend")
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {HA_SQL}, {kalman_sql('ks', 'ha', 50)}, {kalman_sql('kl', 'ha', 150)}
    SELECT symbol, ts, round(ks.v, 3) AS kalman_short, round(kl.v, 3) AS kalman_long, CASE WHEN ks.v > kl.v THEN 'long' ELSE 'short' END AS kalman_trend
    FROM ks JOIN kl USING (symbol, pos) JOIN b USING (symbol, pos)""",
)
register(
    "trend_indicator_a",
    lambda s, d: rounded(
        trend.laid_heikin_ashi(daily(s, d), DAY, trend.trend_indicator_a()), 6, "trend_value", plain=("symbol", "ts", "trend_a")
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {HA_SQL}, {", ".join(ewm_sql('a' + c[0], 'ha', c, '1 - 2.0 / 10') for c in ('open', 'high', 'low', 'close'))},
    r AS (SELECT symbol, pos, 100 * (ac.v - ao.v) / nullif(ah.v - al.v, 0) AS tv FROM ao JOIN ah USING (symbol, pos) JOIN al USING (symbol, pos) JOIN ac USING (symbol, pos))
    SELECT symbol, ts, round(tv, 6) AS trend_value, CASE WHEN tv > 0 THEN 'long' ELSE 'short' END AS trend_a FROM r JOIN b USING (symbol, pos)""",
)
register(
    "trend_indicator_a_sma_backtest",
    query(trend.trend_indicator_a("SMA", epsilon=1e-4), 6, ["trend_value"], ["trend_a"]),
    f"""WITH {DAILY_SQL}, r AS (SELECT symbol, ts, 100 * ({avg_sql('close', 9)} - {avg_sql('open', 9)}) / ({avg_sql('high', 9)} - {avg_sql('low', 9)} + 0.0001) AS tv FROM b)
    SELECT symbol, ts, round(tv, 6) AS trend_value, CASE WHEN tv > 0 THEN 'long' ELSE 'short' END AS trend_a FROM r""",
)
register(
    "trend_deviation",
    lambda s, d: run(daily(s, d), DAY, trend.deviation_trend()).select("symbol", "ts", "deviation_trend"),
    f"""WITH {DAILY_SQL}, a AS (SELECT *, {avg_sql('close', 50)} AS av FROM b), f AS (SELECT *, av - lag(av, 5) OVER (PARTITION BY symbol ORDER BY pos) AS df FROM a),
    r AS (SELECT *, CASE WHEN pos >= 553 THEN df / nullif(max(df) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 0) END AS rt FROM f),
    e AS (SELECT *, lag(rt) OVER (PARTITION BY symbol ORDER BY pos) AS pr FROM r)
    SELECT symbol, ts, CASE WHEN last_value(CASE WHEN rt > 0.1 AND pr <= 0.1 THEN 1 WHEN rt < -0.1 AND pr >= -0.1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos) = 1
    THEN 'long' ELSE 'short' END AS deviation_trend FROM e""",
)
register(
    "trend_volumatic_vidya",
    query(trend.volumatic_vidya(), 3, ["vidya_line"], ["vidya_trend"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {VIDYA_SQL}, w AS (SELECT t.symbol, t.ts, t.pos, t.close, vidya, CASE WHEN t.pos >= 199 THEN 2 * avg(tr) OVER (PARTITION BY t.symbol ORDER BY t.pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END AS wd
    FROM t JOIN vs ON t.symbol = vs.symbol AND t.pos = vs.pos), q AS (SELECT *, vidya + wd AS up, vidya - wd AS lo FROM w), l AS (SELECT *, lag(close) OVER x AS pc, lag(up) OVER x AS pu, lag(lo) OVER x AS pl FROM q WINDOW x AS (PARTITION BY symbol ORDER BY pos)),
    e AS (SELECT *, coalesce(last_value(CASE WHEN close > up AND pc <= pu THEN 1 WHEN close < lo AND pc >= pl THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos), 0) AS rising FROM l),
    n AS (SELECT *, CASE WHEN pos > 0 THEN CASE WHEN rising = 1 THEN lo ELSE up END END AS line FROM e), sd AS (SELECT *, coalesce(line = lo, false) AS side FROM n),
    c AS (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY pos) AS ps FROM sd)
    SELECT symbol, ts, round(line, 3) AS vidya_line, last_value(CASE WHEN pos > 1 AND NOT ps AND side THEN 'long' WHEN pos > 1 AND ps AND NOT side THEN 'short' END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos) AS vidya_trend FROM c""",
)
MAGIC_SQL = f"""{CCI_SQL}, {atr_sql('ma5', 5)},
mx AS MATERIALIZED (SELECT b.symbol, b.pos, cci, low - atr AS fl, high + atr AS ce FROM b JOIN cc USING (symbol, pos) JOIN ma5 USING (symbol, pos) WHERE cci IS NOT NULL),
mg AS (SELECT symbol, pos, fl AS v FROM mx WHERE pos = 19
  UNION ALL SELECT x.symbol, x.pos, CASE WHEN cci >= 0 THEN greatest(fl, m.v) ELSE least(ce, m.v) END FROM mg m JOIN mx x ON x.symbol = m.symbol AND x.pos = m.pos + 1)"""
register(
    "trend_magic",
    query(trend.trend_magic(), 3, ["magic_line"], ["magic_signal"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {MAGIC_SQL} SELECT symbol, ts, round(v, 3) AS magic_line, CASE WHEN v IS NULL THEN NULL WHEN cci >= 0 THEN 'long' ELSE 'short' END AS magic_signal
    FROM b LEFT JOIN mg USING (symbol, pos) LEFT JOIN cc USING (symbol, pos)""",
)


def _hull_sql(start: int) -> str:
    return f"""SELECT symbol, ts, round(hull, 2) AS hull, CASE WHEN pos < {start} THEN NULL WHEN pos < {start + 2} THEN 'NEUTRAL'
    WHEN hull > lag(hull, 2) OVER (PARTITION BY symbol ORDER BY pos) THEN 'long' ELSE 'short' END AS hull_trend"""


def hull_sql(n: int) -> str:
    """CTE ``h`` with a Hull mean of length ``n``: weighted means of long frames by index-weighted sums."""
    def w(x, n, start=0):
        f = f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN pos >= {start + n - 1} THEN (sum(pos * {x}) {f} - (pos - {n}) * sum({x}) {f}) / {n * (n + 1) / 2} END"

    return f"hr AS (SELECT *, 2 * {w('close', n // 2)} - {w('close', n)} AS raw FROM b), h AS MATERIALIZED (SELECT *, {w('raw', int(n**0.5), n - 1)} AS hull FROM hr)"


register(
    "trend_hull",
    query(trend.hull_trend(20, 6.0), 2, ["hull"], ["hull_trend"]),
    f"WITH {DAILY_SQL}, {hull_sql(120)} {_hull_sql(128)} FROM h",
)
register(
    "trend_hull_ehma",
    query(trend.hull_trend(20, 3.0, "Ehma"), 2, ["hull"], ["hull_trend"]),
    f"""WITH RECURSIVE {DAILY_SQL}, {ewm_sql('hh', 'b', 'close', '1 - 2.0 / 31')}, {ewm_sql('hf', 'b', 'close', '1 - 2.0 / 61')},
    hr AS MATERIALIZED (SELECT symbol, pos, 2 * hh.v - hf.v AS raw FROM hh JOIN hf USING (symbol, pos)), {ewm_sql('he', 'hr', 'raw', '1 - 2.0 / 8')},
    h AS (SELECT symbol, ts, pos, v AS hull FROM he JOIN b USING (symbol, pos)) {_hull_sql(0)} FROM h""",
)
LARGE_SQL = """
lb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close FROM b GROUP BY 1, 2)),
lc AS MATERIALIZED (SELECT *, (open + high + low + close) / 4 AS c4 FROM lb),
lo AS (SELECT symbol, pos, ts, open AS o, c4 FROM lc WHERE pos = 0 UNION ALL SELECT h.symbol, h.pos, h.ts, (p.o + p.c4) / 2, h.c4 FROM lo p JOIN lc h ON h.symbol = p.symbol AND h.pos = p.pos + 1)"""
ALERT_SQL = f"""{HA_SQL}, {ewm_sql('ae', 'ha', 'close', '1 - 2.0 / 21')}, {LARGE_SQL.format(hours=4)},
aj AS (SELECT h.symbol, h.ts, h.pos, h.open, h.close, ae.v AS ema, ae.v - lag(ae.v) OVER (PARTITION BY h.symbol ORDER BY h.pos) AS slope FROM ha h JOIN ae USING (symbol, pos)),
al AS MATERIALIZED (SELECT aj.*, CASE WHEN lo.c4 > lo.o AND close > open AND close > ema AND slope > 0 THEN 'long' WHEN lo.c4 < lo.o AND close < open AND close < ema AND slope < 0 THEN 'short' ELSE 'neutral' END AS alert
  FROM aj ASOF LEFT JOIN lo ON aj.symbol = lo.symbol AND aj.ts >= lo.ts)"""
register(
    "trend_alert",
    lambda s, d: rounded(
        trend.trend_alert(hourly(s, d), HOUR, resample(hourly(s, d), "4h"), 4 * HOUR), 6, "ema_20", plain=("symbol", "ts", "trend_alert")
    ),
    f"WITH RECURSIVE {HOURLY_SQL}, {ALERT_SQL} SELECT symbol, ts, round(ema, 6) AS ema_20, alert AS trend_alert FROM al",
)
register(
    "trend_agreeing_frames",
    lambda s, d: trend.agreeing_frames(
        trend.trend_alert(hourly(s, d), HOUR, resample(hourly(s, d), "4h"), 4 * HOUR), resample(hourly(s, d), 120), 2 * HOUR
    ).select("symbol", "ts", "agreed"),
    f"""WITH RECURSIVE {HOURLY_SQL}, {ALERT_SQL}, {LARGE_SQL.format(hours=2).replace('lb AS', 'l2b AS').replace('FROM lb', 'FROM l2b').replace('lc AS', 'l2c AS').replace('FROM lc', 'FROM l2c').replace('JOIN lc', 'JOIN l2c').replace('lo AS', 'l2 AS').replace('FROM lo p', 'FROM l2 p')}
    SELECT al.symbol, al.ts, CASE WHEN (l2.c4 > l2.o AND alert = 'long') OR (l2.c4 < l2.o AND alert = 'short') THEN alert END AS agreed
    FROM al ASOF LEFT JOIN l2 ON al.symbol = l2.symbol AND al.ts >= l2.ts""",
)
register(
    "trend_ema_cross",
    query(trend.ema_cross(), 3, ["ema_fast", "ema_slow"], ["ema_state", "ema_signal"]),
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw FROM b WHERE pos = 0
    UNION ALL SELECT b.symbol, b.pos, f * (19.0 / 21) + close, fw * (19.0 / 21) + 1, s * (49.0 / 51) + close, sw * (49.0 / 51) + 1 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1),
    v AS (SELECT symbol, pos, f / fw AS f, s / sw AS s FROM e), l AS (SELECT *, f > s AS up, lag(f > s) OVER (PARTITION BY symbol ORDER BY pos) AS pu FROM v)
    SELECT symbol, ts, round(f, 3) AS ema_fast, round(s, 3) AS ema_slow, CASE WHEN up THEN 'buy' ELSE 'sell' END AS ema_state,
    CASE WHEN pu IS NULL THEN NULL WHEN up AND NOT pu THEN 'buy' WHEN pu AND NOT up THEN 'sell' ELSE 'hold' END AS ema_signal FROM l JOIN b USING (symbol, pos)""",
)
register(
    "trend_price_side",
    lambda s, d: run(daily(s, d), DAY, ma.sma(20) >> trend.price_side("sma", "side")).select("symbol", "ts", "side"),
    f"WITH {DAILY_SQL}, a AS (SELECT *, {avg_sql('close', 20)} AS m FROM b) SELECT symbol, ts, CASE WHEN close > m THEN 'buy' WHEN close < m THEN 'sell' ELSE 'hold' END AS side FROM a",
)
register(
    "trend_change_signal",
    lambda s, d: run(daily(s, d), DAY, trend.supertrend() >> trend.change_signal("st_position", "turn")).select("symbol", "ts", "turn"),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {supertrend_sql('st', 10, 3.0)}, l AS (SELECT symbol, pos, lag(side) OVER w AS a, lag(side, 2) OVER w AS z FROM st WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, CASE WHEN a = 1 AND z = -1 THEN 'buy' WHEN a = -1 AND z = 1 THEN 'sell' ELSE 'hold' END AS turn FROM l JOIN b USING (symbol, pos)""",
)
register(
    "trend_cross_signal",
    lambda s, d: run(
        daily(s, d), DAY, ma.ema(5, out="f") >> ma.ema(20, out="g") >> trend.cross_signal("f", "g", "cross")
    ).select("symbol", "ts", "cross"),
    f"""WITH RECURSIVE {DAILY_SQL}, {ewm_sql('f', 'b', 'close', '1 - 2.0 / 6')}, {ewm_sql('g', 'b', 'close', '1 - 2.0 / 21')},
    l AS (SELECT symbol, pos, lag(f.v - g.v, 1) OVER w AS a, lag(f.v - g.v, 2) OVER w AS c, lag(f.v - g.v, 3) OVER w AS z FROM f JOIN g USING (symbol, pos) WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, CASE WHEN a > 0 AND c > 0 AND z <= 0 THEN 'buy' WHEN a < 0 AND c < 0 AND z >= 0 THEN 'sell' ELSE 'hold' END AS cross FROM l JOIN b USING (symbol, pos)""",
)


def _win_score(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    plain = run(bars, HOUR, osc.macd(25, 40, 9), osc.rsi())
    smooth = trend.laid_heikin_ashi(bars, HOUR, trend.supertrend(10, 2.0))
    smooth = smooth.select("symbol", "ts", "st_position", trend.candle_side().alias("color"))
    both = plain.join(smooth, ["symbol", "ts"])
    cols = [in_hours("ts", 8, 15), F.col("macd_hist"), F.col("st_position"), F.col("color"), F.col("rsi")]
    scored = both.withColumns({"buy_score": trend.win_score("buy", *cols), "sell_score": trend.win_score("sell", *cols)})
    smart = trend.smart_trend(F.col("color"), F.col("buy_score"), F.col("sell_score"))
    return scored.select("symbol", "ts", "buy_score", "sell_score", smart.alias("smart_trend"))


register(
    "trend_win_score",
    _win_score,
    f"""WITH RECURSIVE {HOURLY_SQL}, {macd_sql(25, 40, 9)}, {RSI_SQL}, {HA_TR_SQL}, {supertrend_sql('st', 10, 2.0, 'ha')},
    j AS (SELECT b.symbol, b.ts, CASE WHEN hour(b.ts) BETWEEN 8 AND 15 THEN 70 ELSE 30 END AS base, coalesce(m.macd - ms.v > 0, false) AS mp, side = 1 AS up, NOT ha.open > ha.close AS lc, rsi
    FROM b LEFT JOIN m USING (symbol, pos) LEFT JOIN ms USING (symbol, pos) LEFT JOIN r USING (symbol, pos) JOIN ha USING (symbol, pos) JOIN st USING (symbol, pos)),
    k AS (SELECT *, greatest(10, least(90, base + CASE WHEN mp THEN 10 ELSE 0 END + CASE WHEN up THEN 10 ELSE 0 END + CASE WHEN lc THEN 5 ELSE 0 END - CASE WHEN rsi > 70 THEN 10 ELSE 0 END)) AS buy_score,
    greatest(10, least(90, base + CASE WHEN mp THEN 0 ELSE 10 END + CASE WHEN up THEN 0 ELSE 10 END + CASE WHEN lc THEN 0 ELSE 5 END - CASE WHEN rsi < 30 THEN 10 ELSE 0 END)) AS sell_score FROM j)
    SELECT symbol, ts, buy_score, sell_score, CASE WHEN lc OR buy_score > 70 THEN 'long' ELSE 'short' END AS smart_trend FROM k""",
)
