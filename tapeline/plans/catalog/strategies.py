"""Registered queries: strategies, sweeps, hit rates, experiments, walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import labels, signals, trades
from tapeline.operators import moving_averages as ma
from tapeline.operators import trend
from tapeline.operators.bars import calendar_windows, resample
from tapeline.operators.layout import POS, TOTAL
from tapeline.operators.scans import ewm_from_start, fade_rows, shift
from tapeline.operators.steps import Step, run
from tapeline.plans import sweeps
from tapeline.plans.catalog.averages_and_oscillators import ADX_SQL, ICHIMOKU_SQL, kalman_sql, macd_sql
from tapeline.plans.catalog.common import (
    DAILY_SQL, DAY, ORACLES, TR_SQL, daily, ewm_sql, hourly, price_ticks, register, rounded,
)
from tapeline.plans.catalog.trading import CROSS_TRADES_SQL, SIGNAL_SQL, cross_trades, crossing, trades_sql
from tapeline.plans.catalog.trends import HT_SQL, MAGIC_SQL, SAR_SQL, STV_SQL, UT_SQL, hull_sql, supertrend_sql
from tapeline.session import materialize

_SIG = ("symbol", "ts", "side", "strategy")
BASE_SQL = f"""{TR_SQL}, {supertrend_sql('st', 10, 3.0)},
sb AS MATERIALIZED (SELECT b.*, CASE WHEN side = 1 THEN up ELSE dn END AS line, side = 1 AS lg, coalesce(side > before, false) AS fu, coalesce(side < before, false) AS fd FROM b JOIN st USING (symbol, pos))"""


def _flip_sql(name: str, joins: str, buy: str, sell: str) -> str:
    return f"""SELECT symbol, ts, CASE WHEN {buy} THEN 'buy' ELSE 'sell' END AS side, '{name}' AS strategy, round(close, 3) AS entry, round(line, 3) AS sl, round(close + 2 * (close - line), 3) AS tp
    FROM sb {joins} WHERE ({buy}) OR ({sell})"""


def _strategy(name):
    return lambda s, d: rounded(signals.strategy_signals(daily(s, d), DAY, name), 3, "entry", "sl", "tp", plain=_SIG)


register("strategy_supertrend", _strategy("supertrend"), f"WITH RECURSIVE {DAILY_SQL}, {BASE_SQL} {_flip_sql('supertrend', '', 'fu', 'fd')}")
_ADX_ONLY = ADX_SQL[len(TR_SQL) + 1 :]
register(
    "strategy_adx",
    _strategy("adx"),
    f"WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {_ADX_ONLY} {_flip_sql('adx', 'JOIN ad USING (symbol, pos)', 'fu AND adx > 25', 'fd AND adx > 25')}",
)
register(
    "strategy_ichimoku",
    _strategy("ichimoku"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {ICHIMOKU_SQL}, ik AS (SELECT symbol, pos, uk, lk FROM ich)
    {_flip_sql('ichimoku', 'JOIN ik USING (symbol, pos)', 'fu AND close > uk', 'fd AND close < lk')}""",
)
register(
    "strategy_sar",
    _strategy("sar"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {SAR_SQL}, sj AS (SELECT symbol, pos, sar.sar AS sv, lag(open) OVER w AS po, lag(sar.sar) OVER w AS ps FROM sar JOIN b USING (symbol, pos) WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    {_flip_sql('sar', 'JOIN sj USING (symbol, pos)', 'lg AND po < ps AND close > sv', 'NOT lg AND po > ps AND close < sv')}""",
)
register(
    "strategy_macd",
    _strategy("macd"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {macd_sql(12, 26, 9)}, mh AS (SELECT symbol, pos, macd - ms.v AS h FROM m JOIN ms USING (symbol, pos)), mj AS (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY pos) AS ph FROM mh)
    {_flip_sql('macd', 'JOIN mj USING (symbol, pos)', 'lg AND h > 0 AND ph < 0', 'NOT lg AND h < 0 AND ph > 0')}""",
)
register(
    "strategy_keltner",
    _strategy("keltner"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {ewm_sql('ke', 'b', 'close', '1 - 2.0 / 21')}, kk AS (SELECT t.symbol, t.pos, ke.v AS m, CASE WHEN t.pos >= 9 THEN 2 * avg(tr) OVER (PARTITION BY t.symbol ORDER BY t.pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS w FROM t JOIN ke USING (symbol, pos)),
    kj AS (SELECT symbol, pos, lag(m + w) OVER x AS ku, lag(m - w) OVER x AS kl FROM kk WINDOW x AS (PARTITION BY symbol ORDER BY pos))
    {_flip_sql('keltner', 'JOIN kj USING (symbol, pos)', 'fu AND close > ku', 'fd AND close < kl')}""",
)
register(
    "strategy_trend_magic",
    _strategy("trend_magic"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {MAGIC_SQL}, mj AS (SELECT symbol, pos, cci FROM mg JOIN cc USING (symbol, pos))
    {_flip_sql('trend_magic', 'JOIN mj USING (symbol, pos)', 'fu AND cci >= 0', 'fd AND cci < 0')}""",
)
register(
    "strategy_vidya",
    _strategy("vidya"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, vv AS MATERIALIZED (SELECT symbol, ts, vidya_trend FROM ({ORACLES['trend_volumatic_vidya']}) o)
    {_flip_sql('vidya', 'JOIN vv USING (symbol, ts)', "fu AND vidya_trend = 'long'", "fd AND vidya_trend = 'short'")}""",
)
register(
    "strategy_hull",
    _strategy("hull"),
    f"""WITH RECURSIVE {DAILY_SQL}, {BASE_SQL}, {hull_sql(360)}, hl AS (SELECT symbol, pos, hull > lag(hull, 2) OVER (PARTITION BY symbol ORDER BY pos) AS rising FROM h)
    {_flip_sql('hull', 'JOIN hl USING (symbol, pos)', 'fu AND pos >= 378 AND rising', 'fd AND pos >= 378 AND NOT rising')}""",
)

VOTE_SQL = f"""{TR_SQL}, {STV_SQL},
vg0 AS MATERIALIZED (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS chg FROM b), vg AS MATERIALIZED (SELECT *, greatest(chg, 0) AS gain, greatest(-chg, 0) AS loss FROM vg0),
{ewm_sql('vu', 'vg', 'gain', '13.0 / 14', '1')}, {ewm_sql('vd', 'vg', 'loss', '13.0 / 14', '1')}, {ewm_sql('vmf', 'b', 'close', '1 - 2.0 / 13')}, {ewm_sql('vmw', 'b', 'close', '1 - 2.0 / 27')},
vm AS MATERIALIZED (SELECT symbol, pos, vmf.v - vmw.v AS macd FROM vmf JOIN vmw USING (symbol, pos)), {ewm_sql('vms', 'vm', 'macd', '1 - 2.0 / 10')},
vl AS (SELECT b.symbol, b.ts, b.pos, lead(b.open) OVER w AS entry, lead(b.ts) OVER w AS entry_ts, CASE WHEN sv.side = 1 THEN sv.dn ELSE sv.up END AS line, sv.side > sv.before AS su, sv.side < sv.before AS sd, coalesce(100 - 100 / (1 + vu.v / nullif(vd.v, 0)), 50) AS rsi,
  lag(coalesce(100 - 100 / (1 + vu.v / nullif(vd.v, 0)), 50)) OVER w AS pr, vm.macd, vms.v AS ms, lag(vm.macd) OVER w AS pm, lag(vms.v) OVER w AS ps, least(low, lag(low) OVER w) AS hl
  FROM b JOIN sv USING (symbol, pos) LEFT JOIN vu USING (symbol, pos) LEFT JOIN vd USING (symbol, pos) JOIN vm USING (symbol, pos) JOIN vms USING (symbol, pos) WINDOW w AS (PARTITION BY b.symbol ORDER BY b.pos)),
vc AS (SELECT *, su::INT + coalesce(pr <= 30 AND rsi > 30, false)::INT + coalesce(pm <= ps AND ps < macd, false)::INT AS nb, sd::INT + coalesce(pr >= 70 AND rsi < 70, false)::INT + coalesce(pm >= ps AND ps > macd, false)::INT AS ns FROM vl),
vs AS (SELECT *, CASE WHEN nb >= 1 THEN 'buy' WHEN ns >= 1 THEN 'sell' END AS side FROM vc),
vt AS (SELECT *, CASE WHEN side = 'buy' THEN least(line, hl) ELSE greatest(line, hl) END AS sl FROM vs WHERE side IS NOT NULL AND entry IS NOT NULL)"""
register(
    "strategy_voting",
    lambda s, d: rounded(signals.voting_signals(daily(s, d), DAY, 1), 3, "entry", "sl", "tp", plain=(*_SIG, "entry_ts", "trade_id")),
    f"""WITH RECURSIVE {DAILY_SQL}, {VOTE_SQL} SELECT symbol, ts, side, 'voting' AS strategy, entry_ts, concat_ws(':', 'voting', symbol, strftime(ts, '%Y-%m-%d %H:%M:%S'), side) AS trade_id,
    round(entry, 3) AS entry, round(sl, 3) AS sl, round(entry + 2 * (entry - sl), 3) AS tp FROM vt WHERE CASE WHEN side = 'buy' THEN sl < entry ELSE sl > entry END""",
)


def _confirmed(s, d):
    step = trend.ema_cross(9, 21) >> ma.sma(50) >> trend.price_side("sma", "side")
    rows = run(daily(s, d), DAY, step)
    return rows.select("symbol", "ts", signals.confirmed_signal(F.col("ema_signal"), F.col("side")).alias("signal"))


register(
    "strategy_confirmed_pair",
    _confirmed,
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw FROM b WHERE pos = 0
    UNION ALL SELECT b.symbol, b.pos, f * 0.8::DOUBLE + close, fw * 0.8::DOUBLE + 1, s * (20.0 / 22) + close, sw * (20.0 / 22) + 1 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1),
    l AS (SELECT symbol, pos, f / fw > s / sw AS up, lag(f / fw > s / sw) OVER (PARTITION BY symbol ORDER BY pos) AS pu FROM e),
    a AS (SELECT *, CASE WHEN pos >= 49 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS m FROM b)
    SELECT symbol, ts, CASE WHEN up AND NOT pu AND close > m THEN 1 WHEN pu AND NOT up AND close < m THEN -1 ELSE 0 END AS signal FROM a JOIN l USING (symbol, pos)""",
)


def _turn_sql(source: str) -> str:
    """Trend and its turns from a CTE ``(symbol, pos, trend)``."""
    return f"""tl AS (SELECT *, lag(trend) OVER (PARTITION BY symbol ORDER BY pos) AS pt FROM {source})
    SELECT symbol, ts, trend, CASE WHEN pt IS NULL OR trend IS NULL THEN NULL WHEN trend = 'buy' AND pt <> 'buy' THEN 'buy' WHEN trend = 'sell' AND pt <> 'sell' THEN 'sell' ELSE 'hold' END AS signal FROM tl JOIN b USING (symbol, pos)"""


_INDICATOR_SQL = {
    "ema": f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS x, close AS n, 1.0::DOUBLE AS w FROM b WHERE pos = 0
    UNION ALL SELECT b.symbol, b.pos, close, e.n * (19.0 / 21) + close, e.w * (19.0 / 21) + 1 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1),
    tt AS (SELECT symbol, pos, CASE WHEN x > n / w THEN 'buy' WHEN x < n / w THEN 'sell' END AS trend FROM e), {_turn_sql('tt')}""",
    "ut_bot": f"""WITH RECURSIVE {DAILY_SQL}, {TR_SQL}, {UT_SQL}, tt AS (SELECT symbol, pos, CASE ut_state WHEN 'long' THEN 'buy' WHEN 'short' THEN 'sell' END AS trend FROM us), {_turn_sql('tt')}""",
    "half_trend": f"WITH RECURSIVE {DAILY_SQL}, {HT_SQL}, tt AS (SELECT symbol, pos, CASE WHEN trend = 0 THEN 'buy' ELSE 'sell' END AS trend FROM ht), {_turn_sql('tt')}",
    "deviation_trend": f"""WITH {DAILY_SQL}, tt AS (SELECT symbol, b.pos, CASE WHEN deviation_trend = 'long' THEN 'buy' ELSE 'sell' END AS trend FROM ({ORACLES['trend_deviation']}) o JOIN b USING (symbol, ts)), {_turn_sql('tt')}""",
    "kalman_trend": f"""WITH RECURSIVE {DAILY_SQL}, {kalman_sql('ks', 'b', 20)}, {kalman_sql('kl', 'b', 50)},
    tt AS (SELECT symbol, pos, CASE WHEN ks.v > kl.v THEN 'buy' ELSE 'sell' END AS trend FROM ks JOIN kl USING (symbol, pos)), {_turn_sql('tt')}""",
}


def _named_sql(query: str, trend: str) -> str:
    """Trend from the SQL of a registered query that has the indicator's state."""
    return f"WITH {DAILY_SQL}, tt AS (SELECT symbol, b.pos, {trend} AS trend FROM ({ORACLES[query]}) o JOIN b USING (symbol, ts)), {_turn_sql('tt')}"


def _side_sql(column: str) -> str:
    return f"CASE WHEN {column} = 'long' THEN 'buy' WHEN {column} IS NOT NULL THEN 'sell' END"


_INDICATOR_SQL |= {
    "sma": f"""WITH {DAILY_SQL}, m AS (SELECT symbol, pos, close, CASE WHEN pos >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m FROM b),
    tt AS (SELECT symbol, pos, CASE WHEN close > m THEN 'buy' WHEN close < m THEN 'sell' END AS trend FROM m), {_turn_sql('tt')}""",
    "macd": _named_sql("osc_macd", "CASE WHEN macd_hist > 0 THEN 'buy' WHEN macd_hist <= 0 THEN 'sell' END"),
    "supertrend": _named_sql("trend_supertrend", _side_sql("st_position")),
    "sar": _named_sql("trend_sar", "CASE WHEN sar_trend > 0 THEN 'buy' WHEN sar_trend <= 0 THEN 'sell' END"),
    "volumatic_vidya": _named_sql("trend_volumatic_vidya", _side_sql("vidya_trend")),
    "trend_ali": _named_sql("trend_hull", _side_sql("hull_trend")),
}
for _name, _params in (
    ("sma", {"window": 20}), ("macd", {}), ("supertrend", {}), ("sar", {}), ("volumatic_vidya", {}), ("trend_ali", {"length": 20, "length_mult": 6.0}),
    ("ema", {"window": 20}), ("ut_bot", {"key_value": 3, "atr_period": 10}), ("half_trend", {"amplitude": 2}), ("deviation_trend", {"sma_length": 50}),
    ("stoch_rsi", {}), ("kalman_trend", {"sell_len": 20, "buy_len": 50}),
):
    register(
        f"indicator_{_name}", lambda s, d, n=_name, p=_params: signals.indicator_signals(daily(s, d), DAY, n, p), _INDICATOR_SQL.get(_name)
    )
register(
    "indicator_ema_cross",
    lambda s, d: signals.indicator_signals(daily(s, d), DAY, "ema_cross", {"fast_period": 10, "slow_period": 30}),
    f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw FROM b WHERE pos = 0
    UNION ALL SELECT b.symbol, b.pos, f * (9.0 / 11) + close, fw * (9.0 / 11) + 1, s * (29.0 / 31) + close, sw * (29.0 / 31) + 1 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1),
    l AS (SELECT symbol, pos, f / fw > s / sw AS up, lag(f / fw > s / sw) OVER (PARTITION BY symbol ORDER BY pos) AS pu FROM e)
    SELECT symbol, ts, CASE WHEN up THEN 'buy' ELSE 'sell' END AS trend, CASE WHEN pu IS NULL THEN NULL WHEN up AND NOT pu THEN 'buy' WHEN pu AND NOT up THEN 'sell' ELSE 'hold' END AS signal FROM l JOIN b USING (symbol, pos)""",
)
register(
    "strategy_price_ladder",
    lambda s, d: signals.price_ladder(hourly(s, d).select("symbol", "ts", "close"), F.col("close"), F.lit(2.5), 4).select(
        "symbol", "ts", "level", "side", F.round("level_price", 6).alias("level_price")
    ),
    """WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_max(value, (ts, event_id)) AS close FROM events WHERE value > 0 GROUP BY 1, 2),
    l AS (SELECT *, CAST(unnest(range(1, 5)) AS INTEGER) AS level FROM h), s AS (SELECT *, unnest(['buy', 'sell']) AS side FROM l)
    SELECT symbol, ts, level, side, round(close + CASE WHEN side = 'buy' THEN 1 ELSE -1 END * level * 2.5, 6) AS level_price FROM s""",
)


def _news(s, d):
    """Sign-ups as news, large ones as holidays."""
    t = price_ticks(s, d)
    return t.filter("symbol = 'signup'").select("ts", F.when(F.col("price") > 250, "Bank Holiday").otherwise("CPI").alias("event"))


register(
    "strategy_news_flags",
    lambda s, d: signals.flag_news(price_ticks(s, d).select("symbol", "ts", "seq"), _news(s, d)).select("seq", "during_news", "upcoming_news", "holiday", "avoid"),
    """WITH n AS (SELECT ts AS nt, value > 250 AS hol FROM events WHERE value > 0 AND event_type = 'signup'),
    j AS (SELECT event_id AS seq, coalesce(bool_or(g >= 0 AND g < 1800), false) AS during_news, coalesce(bool_or(g > 0 AND g <= 3600), false) AS upcoming_news, coalesce(bool_or(hol AND abs(g) <= 43200), false) AS holiday
    FROM (SELECT e.event_id, n.hol, CAST(floor(epoch(nt)) - floor(epoch(e.ts)) AS BIGINT) AS g FROM events e CROSS JOIN n WHERE e.value > 0) x GROUP BY 1)
    SELECT seq, during_news, upcoming_news, holiday, during_news OR upcoming_news OR holiday AS avoid FROM j""",
)


def _abcd(s, d):
    bars = daily(s, d)
    large = run(resample(bars, "1w"), 7 * DAY, trend.hull_trend(5, 2.0)).select("symbol", "ts", F.col("hull_trend").alias("htf_trend"))
    return signals.abcd_signals(bars, DAY, large, 7 * DAY, F.lit(0), 1440, deviation=50.0)


register("strategy_abcd", _abcd)

# -- grids and sweeps -------------------------------------------------------------------------------------------

_CROSS = sweeps.DEFAULT_GRIDS["ema_cross"]


_GRID_SQL = f"""g AS (SELECT f AS fast_period, s AS slow_period, '(''' || f || ''', ''' || s || ''')' AS combo FROM (SELECT unnest({_CROSS['fast_period']}) AS f) a, (SELECT unnest({_CROSS['slow_period']}) AS s) b),
c AS MATERIALIZED (SELECT * FROM g)"""


def sweep_params(spark):
    """Every valid pair of the grid as a list: one row per pair, whatever the data."""
    rows = sorted((r.fast_period, r.slow_period) for r in sweeps.param_grid(spark, _CROSS).collect())
    return [{"fast_period": f, "slow_period": s} for f, s in rows if f < s]


def _sweep_bars(bars, seconds, params, keys=("symbol",)):
    """One EMA column per distinct period and its previous value, positions kept."""
    periods = sorted({v for p in params for v in p.values()})

    def means(laid):
        laid = laid.add({f"_e{n}": ewm_from_start(laid, F.col("close"), ma.span_decay(n)) for n in periods})
        return laid.add({f"_p{n}": shift(laid, f"_e{n}") for n in periods})

    reach = max(fade_rows(ma.span_decay(n)) for n in periods) + 1
    return run(bars, seconds, Step(means, reach), keys=keys, keep=[POS, TOTAL])


def _cross_signal(p):
    up = F.col(f"_e{p['fast_period']}") > F.col(f"_e{p['slow_period']}")
    was = F.col(f"_p{p['fast_period']}") > F.col(f"_p{p['slow_period']}")
    return F.when(up & ~was, 1).when(~up & was, -1).otherwise(0)


def sweep_results(s, d):
    params = sweep_params(s)
    bars = _sweep_bars(daily(s, d), DAY, params)
    done = sweeps.sweep_trades(bars, DAY, params, _cross_signal, 100.0, 0.1)
    return sweeps.sweep_metrics(materialize(done), DAY, params, 5000.0)


_RES = ["roi", "winrate", "profit_factor", "max_drawdown", "final_balance"]
SWEEP_SQL = f"""WITH RECURSIVE {DAILY_SQL}, {_GRID_SQL}, pr AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY fast_period, slow_period) - 1 AS INTEGER) AS param_id FROM c WHERE fast_period < slow_period),
ps AS MATERIALIZED (SELECT DISTINCT n FROM (SELECT fast_period AS n FROM pr UNION ALL SELECT slow_period FROM pr)),
em AS (SELECT symbol, pos, n, close AS x, 1.0::DOUBLE AS w FROM b, ps WHERE pos = 0 UNION ALL SELECT b.symbol, b.pos, n, x * (1 - 2.0 / (n + 1)) + close, w * (1 - 2.0 / (n + 1)) + 1 FROM em JOIN b ON b.symbol = em.symbol AND b.pos = em.pos + 1),
ev AS MATERIALIZED (SELECT symbol, pos, n, x / w AS v FROM em), eu AS (SELECT f.symbol, f.pos, param_id, f.v > s.v AS up FROM pr JOIN ev f ON f.n = fast_period JOIN ev s ON s.n = slow_period AND s.symbol = f.symbol AND s.pos = f.pos),
el AS (SELECT *, lag(up) OVER (PARTITION BY symbol, param_id ORDER BY pos) AS pu FROM eu),
sg AS MATERIALIZED (SELECT b.symbol || '|' || param_id AS symbol, b.pos, close, high, low, CASE WHEN up AND NOT pu THEN 1 WHEN NOT up AND pu THEN -1 ELSE 0 END AS sig FROM el JOIN b USING (symbol, pos)),
{trades_sql('sw', 'sg', '50000', '100000', '1e18', 'false', '0.0002').split('sw_t AS MATERIALIZED')[0].rstrip().rstrip(',')},
st AS MATERIALIZED (SELECT symbol AS k, pos, t_side * (t_exit - t_entry) * round(greatest(0.01, round(100 / (500 * 0.1::DOUBLE), 2)) * 0.1::DOUBLE, 3) / 100 AS profit FROM sw WHERE reason IS NOT NULL),
bc AS (SELECT *, 5000 + sum(profit) OVER (PARTITION BY k ORDER BY pos) AS bal FROM st), bp AS (SELECT *, greatest(5000, max(bal) OVER (PARTITION BY k ORDER BY pos)) AS pk FROM bc),
rs AS MATERIALIZED (SELECT split_part(k, '|', 1) AS symbol, CAST(split_part(k, '|', 2) AS INTEGER) AS param_id, count(*) AS total_trades, sum(profit) / 5000 * 100 AS roi, count(*) FILTER (profit > 0) * 100.0 / count(*) AS winrate,
  CASE WHEN coalesce(-sum(profit) FILTER (profit < 0), 0) > 0 THEN coalesce(sum(profit) FILTER (profit > 0), 0) / -sum(profit) FILTER (profit < 0) WHEN coalesce(sum(profit) FILTER (profit > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor,
  max(pk - bal) / max(pk) * 100 AS max_drawdown, sum(profit) + 5000 AS final_balance FROM bp GROUP BY k)"""
_RES_SQL = "symbol, param_id, total_trades, round(roi, 4) AS roi, round(winrate, 4) AS winrate, round(profit_factor, 4) AS profit_factor, round(max_drawdown, 4) AS max_drawdown, round(final_balance, 4) AS final_balance"
_PLAIN = ("symbol", "param_id", "total_trades")


def _capped(s, d):
    """Results of the ten combinations that a cap by hash keeps: the cap is the operator here."""
    kept = sweeps.cap_by_hash(sweeps.param_grid(s, _CROSS), "orders|1d|ema_cross", 10).select("fast_period", "slow_period", "combo")
    numbered = s.createDataFrame([(i, p["fast_period"], p["slow_period"]) for i, p in enumerate(sweep_params(s))], "param_id int, fast_period int, slow_period int")
    done = sweep_results(s, d).filter("status = 'success'").join(numbered, "param_id").join(kept, ["fast_period", "slow_period"])
    return rounded(done, 4, "roi", plain=("symbol", "fast_period", "slow_period", "combo", "total_trades"))


register(
    "sweep_grid_capped",
    _capped,
    f"""{SWEEP_SQL}, ck AS (SELECT * FROM g ORDER BY sha256('orders|1d|ema_cross:' || combo) LIMIT 10)
    SELECT symbol, fast_period, slow_period, ck.combo, total_trades, round(roi, 4) AS roi FROM rs JOIN pr USING (param_id) JOIN ck USING (fast_period, slow_period)""",
)
register("sweep_results", lambda s, d: rounded(sweep_results(s, d).filter("status = 'success'"), 4, *_RES, plain=_PLAIN), f"{SWEEP_SQL} SELECT {_RES_SQL} FROM rs")
register(
    "sweep_best",
    lambda s, d: rounded(sweeps.best_result(sweep_results(s, d)), 4, *_RES, plain=_PLAIN),
    f"{SWEEP_SQL} SELECT {_RES_SQL} FROM rs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY roi DESC, winrate DESC, param_id) = 1",
)
register(
    "sweep_top_setups",
    lambda s, d: rounded(sweeps.top_setups(sweep_results(s, d), 10), 4, *_RES, plain=_PLAIN),
    f"""{SWEEP_SQL} SELECT {_RES_SQL} FROM rs QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY roi DESC, param_id) <= 10 AND row_number() OVER (PARTITION BY symbol ORDER BY winrate DESC, param_id) <= 10""",
)


_RISK = list(sweeps.risk_grid([150.0, 300.0, 450.0], [200.0, 400.0, 800.0], [300.0, 600.0, 900.0]))


def _risk_sweep(s, d):
    """Money has at most 7 decimal places and its percentage of 5,000 at most 9: rounded there, no value lies between two."""
    bars = run(daily(s, d), DAY, crossing(), keep=[POS, TOTAL])
    done = sweeps.sweep_trades(bars, DAY, _RISK, lambda p: F.col("signal"), 100.0, 0.1)
    told = sweeps.sweep_metrics(materialize(done), DAY, _RISK, 5000.0).withColumn("final_balance", F.round("final_balance", 7))
    return rounded(told, 9, *_RES, plain=(*_PLAIN, "status"))


def _risk_values() -> str:
    """Settings as rows of SQL; a distance that is off is out of reach. The lot follows the stop, or 50 pips without one."""
    row = "({}, {!r}::DOUBLE, {!r}::DOUBLE, {!r}::DOUBLE, {})"
    far = lambda p, switch, pips: p[pips] * 100.0 if p[switch] else 1e18
    return ", ".join(
        row.format(i, far(p, "use_sl", "sl_pips"), far(p, "use_tp", "tp_pips"), far(p, "use_risk_free", "risk_free_distance_pips"), p["close_opposite_position"])
        for i, p in enumerate(_RISK)
    )


_RISK_SQL = f"""WITH RECURSIVE {DAILY_SQL}, {SIGNAL_SQL.replace('sg AS MATERIALIZED', 'sg0 AS MATERIALIZED')},
rp(id, stop, target, free, opp) AS (VALUES {_risk_values()}),
rz AS (SELECT *, greatest(0.01, round(100 / (CASE WHEN stop < 1e18 THEN stop / 100 ELSE 50 END * 0.1::DOUBLE), 2)) AS lot FROM rp),
sg AS MATERIALIZED (SELECT concat_ws('|', symbol, id, stop, target, free, opp, lot) AS symbol, pos, close, high, low, sig FROM sg0, rz),
{trades_sql('rk', 'sg', "split_part(symbol, '|', 3)::DOUBLE", "split_part(symbol, '|', 4)::DOUBLE", "split_part(symbol, '|', 5)::DOUBLE", "split_part(s.symbol, '|', 6)::BOOLEAN", '1').split('rk_t AS MATERIALIZED')[0].rstrip().rstrip(',')},
st AS MATERIALIZED (SELECT symbol AS k, pos, t_side * (t_exit - t_entry) * round(split_part(symbol, '|', 7)::DOUBLE * 0.1::DOUBLE, 3) / 100 AS profit FROM rk WHERE reason IS NOT NULL),
{SWEEP_SQL[SWEEP_SQL.index("bc AS (SELECT *, 5000"):]}
SELECT b0.symbol, rp.id AS param_id, total_trades, {_RES_SQL.split("total_trades, ", 1)[1].replace("final_balance, 4)", "final_balance, 7)").replace(", 4)", ", 9)")}, CASE WHEN total_trades IS NULL THEN 'no_trades' ELSE 'success' END AS status
FROM (SELECT DISTINCT symbol FROM b) b0 CROSS JOIN rp LEFT JOIN rs ON rs.symbol = b0.symbol AND rs.param_id = rp.id"""
register("sweep_risk_settings", _risk_sweep, _RISK_SQL)


def _hit_events(s, d):
    bars = calendar_windows(run(daily(s, d), DAY, trend.ema_cross(5, 12)), DAY, 400)
    rows = bars.select("symbol", "window_id", "ts", "close", F.col("ema_state").alias("state"))
    return sweeps.hit_rate_events(rows, DAY, (5, 20), ("symbol", "window_id"))


_HIT = ["rate_pct", "wald_low", "wald_high"]
HIT_SQL = f"""WITH RECURSIVE {DAILY_SQL}, e AS (SELECT symbol, pos, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw FROM b WHERE pos = 0
UNION ALL SELECT b.symbol, b.pos, f * (4.0 / 6) + close, fw * (4.0 / 6) + 1, s * (11.0 / 13) + close, sw * (11.0 / 13) + 1 FROM e JOIN b ON b.symbol = e.symbol AND b.pos = e.pos + 1),
w AS (SELECT b.symbol, b.pos, b.pos // 400 AS window_id, close, f / fw > s / sw AS up FROM e JOIN b USING (symbol, pos)),
l AS (SELECT *, lag(up) OVER x AS pu, lead(close, 5) OVER x AS c5, lead(close, 20) OVER x AS c20 FROM w WINDOW x AS (PARTITION BY symbol, window_id ORDER BY pos)),
h AS (SELECT symbol, window_id, up, close, unnest([5, 20]) AS horizon, unnest([c5, c20]) AS later FROM l WHERE pu IS NOT NULL AND up <> pu),
k AS (SELECT *, later IS NOT NULL AS kn, CASE WHEN up THEN later > close ELSE later < close END AS hit FROM h)"""
_HIT_COLS = """count(*) FILTER (kn) AS events, count(*) FILTER (kn AND hit) AS hits, count(*) FILTER (NOT kn) AS excluded"""
_HIT_OUT = """events, hits, excluded, round(hits * 100.0 / nullif(events, 0), 6) AS rate_pct, round(greatest(0, hits * 1.0 / nullif(events, 0) - 1.96 * sqrt(hits * 1.0 / nullif(events, 0) * (1 - hits * 1.0 / nullif(events, 0)) / nullif(events, 0))) * 100, 6) AS wald_low,
round(least(100, hits * 1.0 / nullif(events, 0) + 1.96 * sqrt(hits * 1.0 / nullif(events, 0) * (1 - hits * 1.0 / nullif(events, 0)) / nullif(events, 0))) * 100, 6) AS wald_high"""
register(
    "hit_rate_by_window",
    lambda s, d: rounded(sweeps.hit_rates(_hit_events(s, d), ("symbol", "window_id")), 6, *_HIT, plain=("symbol", "window_id", "horizon", "events", "hits", "excluded")),
    f"{HIT_SQL}, a AS (SELECT symbol, window_id, horizon, {_HIT_COLS} FROM k GROUP BY 1, 2, 3) SELECT symbol, window_id, horizon, {_HIT_OUT} FROM a",
)
register(
    "hit_rate_pooled",
    lambda s, d: rounded(sweeps.pooled_hit_rates(_hit_events(s, d)), 6, *_HIT, plain=("symbol", "window_id", "horizon", "events", "hits", "excluded")),
    f"{HIT_SQL}, a AS (SELECT symbol, horizon, window_id, {_HIT_COLS} FROM k GROUP BY GROUPING SETS ((symbol, horizon, window_id), (symbol, horizon))) SELECT symbol, window_id, horizon, {_HIT_OUT} FROM a",
)


def _walk_forward(s, d):
    params = sweep_params(s)
    keys = ("symbol", "window_id")
    windows = calendar_windows(daily(s, d), DAY, 400)
    bars = _sweep_bars(windows, DAY, params, keys)
    done = materialize(sweeps.sweep_trades(bars, DAY, params, _cross_signal, 100.0, 0.1, keys=keys))
    universe = windows.select(*keys).distinct()
    results = sweeps.sweep_metrics(done, DAY, params, 5000.0, keys, universe)
    return rounded(sweeps.walk_forward(materialize(results)), 4, "is_roi", "oos_roi", plain=("symbol", "fold", "param_id", "oos_trades", "status"))


_DAILY0_SQL = DAILY_SQL.replace("\nb AS MATERIALIZED", "\nb0 AS MATERIALIZED")
_WALK_SQL = f"""WITH RECURSIVE {_DAILY0_SQL}, {_GRID_SQL}, pr AS MATERIALIZED (SELECT fast_period AS f, slow_period AS s, CAST(row_number() OVER (ORDER BY fast_period, slow_period) - 1 AS INTEGER) AS pid FROM c WHERE fast_period < slow_period),
b AS MATERIALIZED (SELECT symbol || '|' || (pos // 400) || '|' || pid AS symbol, pos % 400 AS pos, ts, open, high, low, close, volume, f, s FROM b0, pr),
em AS (SELECT symbol, pos, close AS x, 1.0::DOUBLE AS xw, close AS y, 1.0::DOUBLE AS yw FROM b WHERE pos = 0
  UNION ALL SELECT b.symbol, b.pos, x * (1 - 2.0 / (f + 1)) + close, xw * (1 - 2.0 / (f + 1)) + 1, y * (1 - 2.0 / (s + 1)) + close, yw * (1 - 2.0 / (s + 1)) + 1 FROM em JOIN b ON b.symbol = em.symbol AND b.pos = em.pos + 1),
eu AS (SELECT symbol, pos, x / xw > y / yw AS up FROM em), el AS (SELECT *, lag(up) OVER (PARTITION BY symbol ORDER BY pos) AS pu FROM eu),
sg AS MATERIALIZED (SELECT b.*, CASE WHEN up AND NOT pu THEN 1 WHEN NOT up AND pu THEN -1 ELSE 0 END AS sig FROM b JOIN el USING (symbol, pos)),
{trades_sql('wf', 'sg', '50000', '100000', '1e18', 'false', '0.002')},
ks AS (SELECT DISTINCT symbol FROM b), rs AS MATERIALIZED (SELECT split_part(k.symbol, '|', 1) AS symbol, CAST(split_part(k.symbol, '|', 2) AS BIGINT) AS win, CAST(split_part(k.symbol, '|', 3) AS INTEGER) AS pid, nullif(count(profit), 0) AS n, sum(profit) / 50 AS roi
  FROM ks k LEFT JOIN wf_t t ON t.symbol = k.symbol GROUP BY k.symbol),
pk AS (SELECT symbol, win, arg_max(pid, (roi, n, -pid)) FILTER (n >= 10) AS pid, arg_max(roi, (roi, n, -pid)) FILTER (n >= 10) AS roi FROM rs GROUP BY 1, 2), lw AS (SELECT symbol, max(win) AS mw FROM rs GROUP BY 1)
SELECT pk.symbol, pk.win AS fold, pk.pid AS param_id, o.n AS oos_trades, CASE WHEN pk.pid IS NULL THEN 'THIN_IS' ELSE 'OK' END AS status, round(pk.roi, 4) AS is_roi, round(o.roi, 4) AS oos_roi
FROM pk JOIN lw USING (symbol) LEFT JOIN rs o ON o.symbol = pk.symbol AND o.win = pk.win + 1 AND o.pid = pk.pid WHERE pk.win < mw"""
register("walk_forward_selection", _walk_forward, _WALK_SQL)


_SPEC = {"fast": 9, "slow": 21, "symbol": "orders"}
_EXPERIMENT_SQL = f"""WITH RECURSIVE {_DAILY0_SQL}, sp AS (SELECT *, CASE WHEN pos < greatest(1, floor(total * 0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM b0),
b AS MATERIALIZED (SELECT symbol || '|' || split AS symbol, row_number() OVER (PARTITION BY symbol, split ORDER BY pos) - 1 AS pos, ts, open, high, low, close, volume FROM sp),
{SIGNAL_SQL}, {trades_sql('xt', 'sg', '50000', '100000', '1e18', 'true', '0.001')},
xb AS (SELECT symbol, exit_pos, profit, 5000 + sum(profit) OVER (PARTITION BY symbol ORDER BY exit_pos) AS bal FROM xt_t), xp AS (SELECT *, greatest(5000, max(bal) OVER (PARTITION BY symbol ORDER BY exit_pos)) AS pk FROM xb),
xm AS (SELECT symbol, count(*) AS n, sum(profit) AS net, max(pk - bal) AS dd, arg_max(pk, (pk - bal, -exit_pos)) AS at_pk FROM xp GROUP BY 1),
xw AS (SELECT split_part(symbol, '|', 1) AS symbol, max(n) FILTER (symbol LIKE '%|train') AS train_trades, max(n) FILTER (symbol LIKE '%|test') AS test_trades, max(net) FILTER (symbol LIKE '%|train') AS train_net, max(net) FILTER (symbol LIKE '%|test') AS test_net,
  max(dd) FILTER (symbol LIKE '%|test') AS test_dd, max(dd / at_pk * 100) FILTER (symbol LIKE '%|test') AS test_pct FROM xm GROUP BY split_part(symbol, '|', 1)),
xr AS MATERIALIZED (SELECT *, '{sweeps.experiment_id(_SPEC)}' AS experiment_id, coalesce(test_trades >= 1 AND test_pct <= 20 AND test_net > 0, false) AS passed, test_net - test_dd * 0.5 AS score FROM xw)"""


def _experiment(s, d):
    spec = _SPEC
    split = labels.two_way_split(daily(s, d), DAY).drop("row", "rows")
    bars = run(split, DAY, crossing(), keys=("symbol", "split"))
    done = trades.bar_trades(
        bars, DAY, F.col("signal"), F.lit(50000.0), F.lit(100000.0), close_opposite=True, money_per_point=0.001, keys=("symbol", "split")
    )
    return sweeps.experiment_results(materialize(done), DAY, spec, 5000.0)


register(
    "experiment_gate",
    lambda s, d: rounded(_experiment(s, d), 6, "train_net_profit", "test_net_profit", "test_max_drawdown", "score", plain=("symbol", "experiment_id", "train_trades", "test_trades", "passed")),
    f"{_EXPERIMENT_SQL} SELECT symbol, experiment_id, train_trades, test_trades, passed, round(train_net, 6) AS train_net_profit, round(test_net, 6) AS test_net_profit, round(test_dd, 6) AS test_max_drawdown, round(score, 6) AS score FROM xr",
)
register(
    "experiment_best",
    lambda s, d: sweeps.best_experiment(_experiment(s, d)).select("symbol", "experiment_id", F.round("score", 4).alias("score")),
    f"{_EXPERIMENT_SQL} SELECT symbol, experiment_id, round(score, 4) AS score FROM xr WHERE passed ORDER BY xr.score DESC LIMIT 1",
)
register(
    "experiment_equivalence",
    lambda s, d: sweeps.equivalence(_small_metrics(cross_trades(s, d)), _small_metrics(cross_trades(s, d).repartition(7)), ["symbol"], ["net_profit", "win_rate"]).select("symbol"),
    f"{CROSS_TRADES_SQL} SELECT symbol FROM bt_t WHERE false",
)


def _small_metrics(done):
    from tapeline.operators.metrics import trade_metrics

    return trade_metrics(done).select("symbol", "net_profit", "win_rate")


def _compare(s, d):
    bars = daily(s, d)
    fast = run(bars, DAY, crossing(5, 12))
    runs = {
        "cross_9_21": cross_trades(s, d),
        "cross_5_12": trades.bar_trades(fast, DAY, F.col("signal"), F.lit(50000.0), F.lit(100000.0), F.lit(40000.0), close_opposite=True, lot=0.1, money_per_point=0.01),
    }
    runs = {k: materialize(v) for k, v in runs.items()}
    return rounded(sweeps.compare_strategies(runs, bars, DAY, 5000.0), 4, "net_profit", "profit_factor", "max_drawdown", plain=("strategy", "symbol", "candles", "closed"))


register("strategies_compared", _compare)
