"""Registered queries: moving averages, oscillators, bands, channels."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from tapeline.operators import moving_averages as ma
from tapeline.operators import oscillators as osc
from tapeline.operators.steps import run
from tapeline.plans.catalog.common import (
    DAILY_SQL, DAY, HOURLY_SQL, HOUR, TR_SQL, daily, ewm_sql, hourly, register, rounded,
)


def steps_query(names, digits, *steps):
    return lambda s, d: rounded(run(daily(s, d), DAY, *steps), digits, *names)


def avg_sql(x: str, n: int, source: str = "b", start: int = 0) -> str:
    """Mean of the last n rows of x, null before position start + n - 1."""
    return (
        f"CASE WHEN pos >= {start + n - 1} THEN avg({x}) OVER (PARTITION BY symbol ORDER BY pos "
        f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    )


def wma_sql(x: str, n: int, start: int = 0) -> str:
    """Weighted mean 1..n from explicit lags."""
    terms = " + ".join(f"{n - k} * lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY pos)" for k in range(n))
    return f"CASE WHEN pos >= {start + n - 1} THEN ({terms}) / {n * (n + 1) / 2} END"


register(
    "ma_sma",
    steps_query(["sma"], 3, ma.sma(21)),
    f"WITH {DAILY_SQL} SELECT symbol, ts, round({avg_sql('close', 21)}, 3) AS sma FROM b",
)
for _label, _q, _step in (
    ("ema", "1 - 2.0 / 21", ma.ema(20, out="v")),
    ("ema_fast", "1 - 2.0 / 4", ma.ema(3, out="v")),
    ("rma", "13.0 / 14", ma.rma(14, out="v")),
):
    register(
        f"ma_{_label}",
        steps_query(["v"], 3, _step),
        f"WITH RECURSIVE {DAILY_SQL}, {ewm_sql('e', 'b', 'close', _q)} SELECT symbol, ts, round(v, 3) AS v FROM e JOIN b USING (symbol, pos)",
    )
register(
    "ma_ema_adjusted",
    steps_query(["v"], 3, ma.ema(20, out="v", adjust=True)),
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS n, 1.0::DOUBLE AS w FROM b WHERE pos = 0
    UNION ALL SELECT b.symbol, b.pos, e.n * (19.0 / 21) + close, e.w * (19.0 / 21) + 1 FROM e JOIN b
    ON b.symbol = e.symbol AND b.pos = e.pos + 1)
    SELECT symbol, ts, round(n / w, 3) AS v FROM e JOIN b USING (symbol, pos)""",
)
register(
    "ma_smma",
    steps_query(["v"], 3, ma.smma(7, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, CAST(6 AS BIGINT) AS pos, avg(close) AS v FROM b WHERE pos < 7 GROUP BY 1
    UNION ALL SELECT b.symbol, b.pos, (e.v * 6 + close) / 7 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1)
    SELECT symbol, ts, round(v, 3) AS v FROM b LEFT JOIN e USING (symbol, pos)""",
)
register(
    "ma_wma",
    steps_query(["v"], 3, ma.wma(20, out="v")),
    f"WITH {DAILY_SQL} SELECT symbol, ts, round({wma_sql('close', 20)}, 3) AS v FROM b",
)


def chain_ewm_sql(q: str, depth: int, x: str = "close", source: str = "b") -> str:
    """CTEs e1..ed: exponential means of each other."""
    parts = [ewm_sql("e1", source, x, q)]
    for i in range(2, depth + 1):
        parts.append(f"s{i} AS MATERIALIZED (SELECT * FROM e{i - 1})")
        parts.append(ewm_sql(f"e{i}", f"s{i}", "v", q))
    return ", ".join(parts)


register(
    "ma_dema",
    steps_query(["v"], 3, ma.dema(9, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, {chain_ewm_sql('1 - 2.0 / 10', 2)} SELECT symbol, ts, round(2 * e1.v - e2.v, 3) AS v
    FROM e1 JOIN e2 USING (symbol, pos) JOIN b USING (symbol, pos)""",
)
register(
    "ma_tema",
    steps_query(["v"], 3, ma.tema(14, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, {chain_ewm_sql('1 - 2.0 / 15', 3)} SELECT symbol, ts,
    round(3 * (e1.v - e2.v) + e3.v, 3) AS v FROM e1 JOIN e2 USING (symbol, pos) JOIN e3 USING (symbol, pos) JOIN b USING (symbol, pos)""",
)
register(
    "ma_hma",
    steps_query(["v"], 2, ma.hma(16, out="v")),
    f"""WITH {DAILY_SQL}, r AS (SELECT *, 2 * {wma_sql('close', 8)} - {wma_sql('close', 16)} AS raw FROM b)
    SELECT symbol, ts, round({wma_sql('raw', 4, 15)}, 2) AS v FROM r""",
)
register(
    "ma_hma_simple",
    steps_query(["v"], 3, ma.hma_simple(9, out="v")),
    f"""WITH {DAILY_SQL}, r AS (SELECT *, 2 * {avg_sql('close', 4)} - {avg_sql('close', 9)} AS raw FROM b)
    SELECT symbol, ts, round({avg_sql('raw', 3, start=8)}, 3) AS v FROM r""",
)
register(
    "ma_ehma",
    steps_query(["v"], 2, ma.ehma(30, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, {ewm_sql('h', 'b', 'close', '1 - 2.0 / 16')}, {ewm_sql('f', 'b', 'close', '1 - 2.0 / 31')},
    r AS MATERIALIZED (SELECT symbol, pos, 2 * h.v - f.v AS raw FROM h JOIN f USING (symbol, pos)), {ewm_sql('e', 'r', 'raw', '1 - 2.0 / 6')}
    SELECT symbol, ts, round(v, 2) AS v FROM e JOIN b USING (symbol, pos)""",
)
register(
    "ma_thma",
    steps_query(["v"], 2, ma.thma(9, out="v")),
    f"""WITH {DAILY_SQL}, r AS (SELECT *, 3 * {wma_sql('close', 3)} - {wma_sql('close', 4)} - {wma_sql('close', 18)} AS raw FROM b)
    SELECT symbol, ts, round({wma_sql('raw', 18, 17)}, 2) AS v FROM r""",
)
register(
    "ma_zlema",
    steps_query(["v"], 3, ma.zlema(9, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, r AS MATERIALIZED (SELECT *, close - lag(close, 4) OVER (PARTITION BY symbol ORDER BY pos) AS chg FROM b),
    {ewm_sql('e', 'r', 'chg', '1 - 2.0 / 10', '4')}
    SELECT symbol, ts, round(close + v, 3) AS v FROM b LEFT JOIN e USING (symbol, pos)""",
)
_BELL = np.exp(-((np.arange(9) - 4) ** 2) / (2 * (9 / 6) ** 2))
_ALMA = " + ".join(
    f"{float(w)!r} * lag(close, {k}) OVER (PARTITION BY symbol ORDER BY pos)" for k, w in enumerate(_BELL / _BELL.sum())
)
register(
    "ma_alma",
    steps_query(["v"], 3, ma.alma(9, out="v")),
    f"WITH {DAILY_SQL} SELECT symbol, ts, round({_ALMA}, 3) AS v FROM b",
)
register(
    "ma_mcginley",
    steps_query(["v"], 3, ma.sma(50) >> ma.mcginley(10, "sma", "v")),
    f"""WITH RECURSIVE {DAILY_SQL}, m AS MATERIALIZED (SELECT symbol, pos, {avg_sql('close', 50)} AS x FROM b),
    e AS (SELECT symbol, pos, x AS v FROM m WHERE pos = 49
    UNION ALL SELECT m.symbol, m.pos, e.v + (x - e.v) / (10 * (x / e.v) ** 4) FROM e JOIN m ON m.symbol = e.symbol AND m.pos = e.pos + 1)
    SELECT symbol, ts, round(v, 3) AS v FROM b LEFT JOIN e USING (symbol, pos)""",
)
_B5 = 0.45 * 4 / (0.45 * 4 + 2)
register(
    "ma_jma",
    steps_query(["v"], 2, ma.jma(5, out="v")),
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS e0, 0.0::DOUBLE AS e1, 0.0::DOUBLE AS e2, close AS v FROM b WHERE pos = 0
    UNION ALL SELECT symbol, pos, e0, e1, e2, e2 + pv FROM (SELECT *, (e0 + 1.53 * e1 - pv) * ((1 - {_B5}) ** 2) + ({_B5} ** 2) * pe2 AS e2 FROM (
      SELECT *, (close - e0) * (1 - {_B5}) + {_B5} * pe1 AS e1 FROM (
      SELECT b.symbol, b.pos, close, (1 - {_B5}) * close + {_B5} * e.e0 AS e0, e.e1 AS pe1, e.e2 AS pe2, e.v AS pv
      FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1) q) q2) q3)
    SELECT symbol, ts, round(v, 2) AS v FROM e JOIN b USING (symbol, pos)""",
)
VIDYA_SQL = """
vc AS MATERIALIZED (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS chg FROM b),
vm AS MATERIALIZED (SELECT *, CASE WHEN pos >= 19 THEN sum(CASE WHEN chg >= 0 THEN chg ELSE 0 END) OVER w END AS up,
  CASE WHEN pos >= 19 THEN sum(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER w END AS dn FROM vc
  WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
vw AS MATERIALIZED (SELECT *, coalesce(abs((up - dn) / nullif(up + dn, 0)), 0) * (2.0 / 11) AS wt FROM vm),
ve AS (SELECT symbol, pos, close AS v FROM vw WHERE pos = 0 UNION ALL
  SELECT s.symbol, s.pos, s.wt * s.close + (1 - s.wt) * e.v FROM ve e JOIN vw s ON s.symbol = e.symbol AND s.pos = e.pos + 1),
vs AS MATERIALIZED (SELECT symbol, pos, CASE WHEN pos >= 14 THEN avg(v) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) END AS vidya FROM ve)"""
register(
    "ma_vidya",
    steps_query(["vidya"], 3, ma.vidya()),
    f"WITH RECURSIVE {DAILY_SQL}, {VIDYA_SQL} SELECT symbol, ts, round(vidya, 3) AS vidya FROM vs JOIN b USING (symbol, pos)",
)


def kalman_sql(name: str, source: str, length: int) -> str:
    return f"""
{name} AS (SELECT symbol, pos, close AS v, 1.0::DOUBLE AS err FROM {source} WHERE pos = 0
  UNION ALL SELECT s.symbol, s.pos, k.v + (k.err / (k.err + {0.01 * length})) * (s.close - k.v),
  (1 - k.err / (k.err + {0.01 * length})) * k.err + {0.1}::DOUBLE / {length}
  FROM {name} k JOIN {source} s ON s.symbol = k.symbol AND s.pos = k.pos + 1)"""


register(
    "ma_kalman",
    steps_query(["v"], 3, ma.kalman(50, out="v")),
    f"WITH RECURSIVE {DAILY_SQL}, {kalman_sql('k', 'b', 50)} SELECT symbol, ts, round(v, 3) AS v FROM k JOIN b USING (symbol, pos)",
)

GAIN_SQL = """
g0 AS MATERIALIZED (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS chg FROM b),
g AS MATERIALIZED (SELECT *, greatest(coalesce(chg, 0), 0) AS gain, greatest(-coalesce(chg, 0), 0) AS loss FROM g0)"""
RSI_SQL = f"""{GAIN_SQL}, {ewm_sql('gu', 'g', 'gain', '13.0 / 14')}, {ewm_sql('gd', 'g', 'loss', '13.0 / 14')},
r AS MATERIALIZED (SELECT symbol, pos, CASE WHEN pos < 13 THEN NULL WHEN gd.v = 0 THEN 100 ELSE 100 - 100 / (1 + gu.v / gd.v) END AS rsi
  FROM gu JOIN gd USING (symbol, pos))"""
register(
    "osc_rsi",
    steps_query(["rsi"], 8, osc.rsi()),
    f"WITH RECURSIVE {DAILY_SQL}, {RSI_SQL} SELECT symbol, ts, round(rsi, 8) AS rsi FROM r JOIN b USING (symbol, pos)",
)
register(
    "osc_sma_rsi",
    steps_query(["sma_rsi"], 8, osc.sma_rsi()),
    f"""WITH RECURSIVE {DAILY_SQL}, {RSI_SQL}, q AS (SELECT symbol, pos, {avg_sql('rsi', 14, start=13)} AS v FROM r)
    SELECT symbol, ts, round(v, 8) AS sma_rsi FROM q JOIN b USING (symbol, pos)""",
)
register(
    "osc_rsi_reversal",
    lambda s, d: rounded(
        run(daily(s, d), DAY, osc.rsi_reversal()), 8, "rsi", plain=("symbol", "ts", "rsi_signal", "rsi_direction")
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {GAIN_SQL}, {ewm_sql('gu', 'g', 'gain', '13.0 / 14', '1')}, {ewm_sql('gd', 'g', 'loss', '13.0 / 14', '1')},
    r AS (SELECT b.symbol, b.ts, b.pos, coalesce(100 - 100 / (1 + gu.v / nullif(gd.v, 0)), 50) AS rsi FROM b LEFT JOIN gu USING (symbol, pos)
    LEFT JOIN gd USING (symbol, pos)), l AS (SELECT *, lag(rsi) OVER (PARTITION BY symbol ORDER BY pos) AS pr FROM r)
    SELECT symbol, ts, round(rsi, 8) AS rsi, CASE WHEN pr <= 30 AND rsi > 30 THEN 'buy' WHEN pr >= 70 AND rsi < 70 THEN 'sell' ELSE 'hold' END AS rsi_signal,
    CASE WHEN rsi >= 50 THEN 'long' ELSE 'short' END AS rsi_direction FROM l""",
)
register(
    "osc_stoch_rsi",
    steps_query(["stoch_k", "stoch_d"], 7, osc.stoch_rsi()),
    f"""WITH RECURSIVE {DAILY_SQL}, {RSI_SQL}, st AS (SELECT symbol, pos, CASE WHEN pos >= 26 THEN 100 * (rsi - min(rsi) OVER w) / nullif(max(rsi) OVER w - min(rsi) OVER w, 0) END AS st
    FROM r WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
    k AS (SELECT symbol, pos, {avg_sql('st', 3, start=26)} AS k FROM st), dd AS (SELECT symbol, pos, k, {avg_sql('k', 3, start=28)} AS d FROM k)
    SELECT symbol, ts, round(k, 7) AS stoch_k, round(d, 7) AS stoch_d FROM dd JOIN b USING (symbol, pos)""",
)


def seeded_sql(name: str, source: str, x: str, n: int, start: int = 0) -> str:
    first = start + n - 1
    return f"""
{name} AS (SELECT symbol, CAST({first} AS BIGINT) AS pos, avg({x}) AS v FROM {source} WHERE pos BETWEEN {start} AND {first} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT s.symbol, s.pos, e.v * (1 - 2.0 / {n + 1}) + s.{x} * (2.0 / {n + 1}) FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.pos = e.pos + 1)"""


def macd_sql(fast: int, slow: int, signal: int, source: str = "b") -> str:
    return f"""{seeded_sql('mf', source, 'close', fast)}, {seeded_sql('mw', source, 'close', slow)},
m AS MATERIALIZED (SELECT symbol, pos, mf.v - mw.v AS macd FROM mf JOIN mw USING (symbol, pos)), {seeded_sql('ms', 'm', 'macd', signal, slow - 1)}"""


register(
    "osc_macd",
    steps_query(["macd", "macd_signal", "macd_hist"], 3, osc.macd()),
    f"""WITH RECURSIVE {DAILY_SQL}, {macd_sql(12, 26, 9)}
    SELECT symbol, ts, round(macd, 3) AS macd, round(ms.v, 3) AS macd_signal, round(macd - ms.v, 3) AS macd_hist
    FROM b LEFT JOIN m USING (symbol, pos) LEFT JOIN ms USING (symbol, pos)""",
)
register(
    "osc_macd_cross",
    lambda s, d: rounded(
        run(daily(s, d), DAY, osc.macd_cross()), 3, "macd", "macd_signal", plain=("symbol", "ts", "macd_cross", "macd_direction")
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {ewm_sql('mf', 'b', 'close', '1 - 2.0 / 13')}, {ewm_sql('mw', 'b', 'close', '1 - 2.0 / 27')},
    m AS MATERIALIZED (SELECT symbol, pos, mf.v - mw.v AS macd FROM mf JOIN mw USING (symbol, pos)), {ewm_sql('ms', 'm', 'macd', '1 - 2.0 / 10')},
    l AS (SELECT symbol, pos, macd, ms.v AS sg, lag(macd) OVER w AS pm, lag(ms.v) OVER w AS ps FROM m JOIN ms USING (symbol, pos) WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, round(macd, 3) AS macd, round(sg, 3) AS macd_signal, CASE WHEN pm <= ps AND ps < macd THEN 'buy' WHEN pm >= ps AND ps > macd THEN 'sell' ELSE 'hold' END AS macd_cross,
    CASE WHEN macd >= 0 THEN 'long' ELSE 'short' END AS macd_direction FROM l JOIN b USING (symbol, pos)""",
)
register(
    "osc_mfi",
    steps_query(["mfi"], 7, osc.mfi()),
    f"""WITH {DAILY_SQL}, a AS (SELECT *, (high + low + close) / 3 AS tp FROM b), c AS (SELECT *, tp - lag(tp) OVER (PARTITION BY symbol ORDER BY pos) AS chg FROM a),
    f AS (SELECT *, sum(CASE WHEN chg > 0 THEN tp * volume ELSE 0 END) OVER w AS i, sum(CASE WHEN chg < 0 THEN tp * volume ELSE 0 END) OVER w AS o FROM c
    WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(CASE WHEN pos >= 14 THEN 100 * i / nullif(i + o, 0) END, 7) AS mfi FROM f""",
)
CCI_SQL = """
ca AS (SELECT *, (high + low + close) / 3 AS tp FROM b),
cw AS (SELECT *, avg(tp) OVER w AS m, list(tp) OVER w AS near FROM ca WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
cc AS MATERIALIZED (SELECT symbol, pos, CASE WHEN pos >= 19 THEN (tp - m) / nullif(0.015 * list_avg(list_transform(near, lambda v: abs(v - m))), 0) END AS cci FROM cw)"""
register(
    "osc_cci",
    steps_query(["cci"], 6, osc.cci()),
    f"WITH {DAILY_SQL}, {CCI_SQL} SELECT symbol, ts, round(cci, 6) AS cci FROM cc JOIN b USING (symbol, pos)",
)
ADX_SQL = f"""{TR_SQL},
dm0 AS (SELECT *, high - lag(high) OVER (PARTITION BY symbol ORDER BY pos) AS u, lag(low) OVER (PARTITION BY symbol ORDER BY pos) - low AS d FROM t),
dm AS MATERIALIZED (SELECT *, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS mdm FROM dm0),
{ewm_sql('xt', 'dm', 'tr', '13.0 / 14')}, {ewm_sql('xp', 'dm', 'pdm', '13.0 / 14')}, {ewm_sql('xm', 'dm', 'mdm', '13.0 / 14')},
di AS MATERIALIZED (SELECT symbol, pos, 100 * xp.v / nullif(xt.v, 0) AS plus_di, 100 * xm.v / nullif(xt.v, 0) AS minus_di FROM xt JOIN xp USING (symbol, pos) JOIN xm USING (symbol, pos)),
dn AS (SELECT symbol, pos AS src, plus_di, minus_di FROM di WHERE plus_di + minus_di <> 0),
dx AS MATERIALIZED (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY src) AS pos, src, 100 * abs(plus_di - minus_di) / (plus_di + minus_di) AS dx FROM dn),
{ewm_sql('xa', 'dx', 'dx', '13.0 / 14', '1')},
ad AS MATERIALIZED (SELECT d.symbol, d.src AS pos, a.v AS adx FROM xa a JOIN dx d USING (symbol, pos))"""
register(
    "osc_adx",
    steps_query(["adx", "plus_di", "minus_di"], 7, osc.adx()),
    f"""WITH RECURSIVE {DAILY_SQL}, {ADX_SQL} SELECT symbol, ts, round(adx, 7) AS adx, round(plus_di, 7) AS plus_di, round(minus_di, 7) AS minus_di
    FROM b JOIN di USING (symbol, pos) LEFT JOIN ad USING (symbol, pos)""",
)


def atr_sql(name: str, n: int) -> str:
    """Wilder mean of ranges from the second bar on, shown after n of them; needs TR_SQL."""
    return f"{ewm_sql(name + '_e', 't', 'tr', f'{n - 1}.0 / {n}', '1')}, {name} AS (SELECT symbol, pos, CASE WHEN pos >= {n} THEN v END AS atr FROM {name}_e)"


register(
    "osc_atr",
    steps_query(["atr"], 3, osc.atr()),
    f"WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {atr_sql('a', 14)} SELECT symbol, ts, round(atr, 3) AS atr FROM b LEFT JOIN a USING (symbol, pos)",
)
_L20 = "OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
register(
    "osc_bollinger",
    steps_query(["bb_mid", "bb_upper", "bb_lower"], 4, osc.bollinger()),
    f"""WITH {DAILY_SQL}, s AS (SELECT symbol, ts, pos, avg(low) {_L20} AS m, stddev_samp(low) {_L20} AS sd FROM b)
    SELECT symbol, ts, round(CASE WHEN pos >= 19 THEN m END, 4) AS bb_mid, round(CASE WHEN pos >= 19 THEN m + 2 * sd END, 4) AS bb_upper,
    round(CASE WHEN pos >= 19 THEN m - 2 * sd END, 4) AS bb_lower FROM s""",
)
_P20 = "OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
register(
    "osc_donchian",
    steps_query(["dc_upper", "dc_lower", "dc_mid"], 3, osc.donchian()),
    f"""WITH {DAILY_SQL}, s AS (SELECT symbol, ts, pos, max(high) {_P20} AS u, min(low) {_P20} AS l FROM b)
    SELECT symbol, ts, round(CASE WHEN pos >= 20 THEN u END, 3) AS dc_upper, round(CASE WHEN pos >= 20 THEN l END, 3) AS dc_lower,
    round(CASE WHEN pos >= 20 THEN (u + l) / 2 END, 3) AS dc_mid FROM s""",
)
register(
    "osc_keltner",
    steps_query(["kc_mid", "kc_upper", "kc_lower"], 3, osc.keltner()),
    f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {ewm_sql('e', 'b', 'close', '1 - 2.0 / 21')},
    k AS (SELECT t.symbol, t.ts, t.pos, e.v AS m, CASE WHEN t.pos >= 9 THEN 2 * avg(tr) OVER (PARTITION BY t.symbol ORDER BY t.pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS w FROM t JOIN e USING (symbol, pos))
    SELECT symbol, ts, round(lag(m) OVER x, 3) AS kc_mid, round(lag(m + w) OVER x, 3) AS kc_upper, round(lag(m - w) OVER x, 3) AS kc_lower FROM k
    WINDOW x AS (PARTITION BY symbol ORDER BY pos)""",
)


def _mid(n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN pos >= {n - 1} THEN (max(high) {w} + min(low) {w}) / 2 END"


ICHIMOKU_SQL = f"""
i1 AS (SELECT *, {_mid(9)} AS cl, {_mid(26)} AS bl, {_mid(52)} AS lb, lead(close, 26) OVER (PARTITION BY symbol ORDER BY pos) AS lag26 FROM b),
ich AS MATERIALIZED (SELECT *, (cl + bl) / 2 AS la, CASE WHEN (cl + bl) / 2 IS NOT NULL AND lb IS NOT NULL THEN greatest((cl + bl) / 2, lb) END AS uk,
  CASE WHEN (cl + bl) / 2 IS NOT NULL AND lb IS NOT NULL THEN least((cl + bl) / 2, lb) END AS lk FROM i1)"""
_ICH = ["conversion_line", "base_line", "leading_a", "leading_b", "lagging_span", "upper_kumo", "lower_kumo"]
register(
    "osc_ichimoku",
    lambda s, d: rounded(run(daily(s, d), DAY, osc.ichimoku()), 4, *_ICH, plain=("symbol", "ts", "cloud")),
    f"""WITH {DAILY_SQL}, {ICHIMOKU_SQL} SELECT symbol, ts, round(cl, 4) AS conversion_line, round(bl, 4) AS base_line, round(la, 4) AS leading_a,
    round(lb, 4) AS leading_b, round(lag26, 4) AS lagging_span, round(uk, 4) AS upper_kumo, round(lk, 4) AS lower_kumo,
    CASE WHEN coalesce(la, 0) > coalesce(lb, 0) THEN 'green' ELSE 'red' END AS cloud FROM ich""",
)
register(
    "osc_nadaraya_watson",
    lambda s, d: rounded(
        osc.nadaraya_watson(daily(s, d), DAY), 3, "center", "upper", "lower", plain=("symbol", "ts", "cross_up", "cross_down")
    ),
    f"""WITH {DAILY_SQL}, r AS MATERIALIZED (SELECT * FROM b WHERE pos >= total - 500), c AS MATERIALIZED (SELECT x.symbol, x.ts, x.pos, any_value(x.close) AS close,
    sum(y.close * exp(-((x.pos - y.pos) ** 2) / 128.0)) / sum(exp(-((x.pos - y.pos) ** 2) / 128.0)) AS m FROM r x JOIN r y ON x.symbol = y.symbol GROUP BY 1, 2, 3),
    e AS (SELECT *, avg(abs(close - m)) OVER (PARTITION BY symbol) * 3 AS s FROM c),
    l AS (SELECT *, lag(close) OVER w AS pc, lag(m + s) OVER w AS pu, lag(m - s) OVER w AS pl FROM e WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, round(m, 3) AS center, round(m + s, 3) AS upper, round(m - s, 3) AS lower, coalesce(pc < pl AND close > m - s, false) AS cross_up,
    coalesce(pc > pu AND close < m + s, false) AS cross_down FROM l""",
)
_KEYS = [str(round(v * 1000)) for v in osc.FIBONACCI_LEVELS]
register(
    "osc_fibonacci",
    lambda s, d: hourly(s, d)
    .withColumn("levels", osc.fibonacci(F.col("high"), F.col("low")))
    .select("symbol", "ts", *[F.col("levels")[k].alias(f"level_{k}") for k in _KEYS]),
    f"WITH {HOURLY_SQL} SELECT symbol, ts, "
    + ", ".join(f"floor((high - abs(high - low) * {v}::DOUBLE) * 100 + 0.5) / 100 AS level_{k}" for k, v in zip(_KEYS, osc.FIBONACCI_LEVELS))
    + " FROM b",
)
register(
    "osc_range_ladder",
    lambda s, d: rounded(osc.range_ladder(hourly(s, d), HOUR, "1d"), 6, "above", "below"),
    f"""WITH {HOURLY_SQL}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_min(open, b.ts) AS o, max(high) AS h, min(low) AS l, arg_max(close, b.ts) AS c FROM b GROUP BY 1, 2),
    p AS (SELECT *, (lag(h) OVER w - lag(l) OVER w) / 8 AS leg FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)),
    r AS (SELECT symbol, day, unnest(range(0, 51)) AS k, CASE WHEN o > c THEN h ELSE l END AS base, CASE WHEN o > c THEN -leg ELSE leg END AS leg FROM p WHERE leg IS NOT NULL),
    j AS (SELECT b.symbol, b.ts, close, base + leg * k AS rung FROM b JOIN r ON b.symbol = r.symbol AND CAST(b.ts AS DATE) = r.day)
    SELECT symbol, ts, round(min(rung) FILTER (rung > close), 6) AS above, round(max(rung) FILTER (rung < close), 6) AS below FROM j GROUP BY 1, 2""",
)
