"""Registered queries: candles and market structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import candles
from tapeline.operators import structure
from tapeline.operators.steps import run
from tapeline.plans.catalog.common import DAILY_SQL, DAY, daily, register, rounded

register(
    "candle_predicates",
    lambda s, d: daily(s, d).select(
        "symbol",
        "ts",
        candles.colour().alias("colour"),
        candles.no_tail().alias("no_tail"),
        candles.rejection_wick("up").alias("wick_up"),
        candles.rejection_wick("down").alias("wick_down"),
        F.round(candles.body_size(), 4).alias("body"),
    ),
    f"""WITH {DAILY_SQL} SELECT symbol, ts, CASE WHEN open > close THEN 'short' ELSE 'long' END AS colour,
    (open > close AND open = high) OR (open < close AND open = low) AS no_tail,
    CASE WHEN open > close THEN (open - close) * 3 < high - open WHEN open < close THEN (close - open) * 4 < high - close ELSE false END AS wick_up,
    CASE WHEN open > close THEN (open - close) * 4 < close - low WHEN open < close THEN (close - open) * 3 < open - low ELSE false END AS wick_down,
    round(abs(close - open), 4) AS body FROM b""",
)
register(
    "candle_gap",
    lambda s, d: run(daily(s, d), DAY, candles.gap_step()).select("symbol", "ts", "gap"),
    f"""WITH {DAILY_SQL}, l AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, coalesce((open > pc AND open <= close AND po <= pc) OR (open < pc AND open > close AND po > pc), false) AS gap FROM l""",
)

ZIGZAG_SQL = """
z1 AS (SELECT *, CASE WHEN pos >= 11 THEN min(low) OVER w END AS m, CASE WHEN pos >= 11 THEN max(high) OVER w END AS x FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
z2 AS (SELECT *, coalesce(lag(m) OVER w, 0) AS pm, coalesce(lag(x) OVER w, 0) AS px FROM z1 WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
z3 AS (SELECT *, CASE WHEN m <> pm AND low - m <= 0.0005 THEN m END AS cl, CASE WHEN x <> px AND x - high <= 0.0005 THEN x END AS ch FROM z2),
z4 AS (SELECT *, min(cl) OVER w AS ncl, max(ch) OVER w AS nch FROM z3 WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
z5 AS (SELECT *, coalesce(cl = low AND NOT coalesce(ncl < low, false), false) AS il, coalesce(ch = high AND NOT coalesce(nch > high, false), false) AS ih FROM z4),
zs AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS k FROM z5 WHERE il OR ih),
zr AS (SELECT symbol, k, pos, ts, CASE WHEN ih THEN 1 ELSE -1 END AS st, pos AS kept, ts AS kept_ts, CASE WHEN ih THEN high ELSE low END AS price, 0 AS run FROM zs WHERE k = 1
  UNION ALL SELECT z.symbol, z.k, z.pos, z.ts, CASE WHEN z.ih AND NOT z.il THEN 1 WHEN z.il AND NOT z.ih THEN -1 ELSE r.st END,
  CASE WHEN flip OR better THEN z.pos ELSE r.kept END, CASE WHEN flip OR better THEN z.ts ELSE r.kept_ts END,
  CASE WHEN flip OR better THEN CASE WHEN z.ih THEN z.high ELSE z.low END ELSE r.price END, CASE WHEN flip THEN r.run + 1 ELSE r.run END
  FROM zr r JOIN (SELECT *, ih <> il AS one FROM zs) z ON z.symbol = r.symbol AND z.k = r.k + 1,
  LATERAL (SELECT z.one AND (CASE WHEN z.ih THEN 1 ELSE -1 END) <> r.st AS flip, z.one AND (CASE WHEN z.ih THEN 1 ELSE -1 END) = r.st AND (CASE WHEN z.ih THEN z.high > r.price ELSE z.low < r.price END) AS better) f),
zg AS MATERIALIZED (SELECT symbol, CASE WHEN st = 1 THEN 'high' ELSE 'low' END AS kind, arg_max(kept_ts, k) AS ts, arg_max(kept, k) AS pos, arg_max(price, k) AS price FROM zr GROUP BY symbol, run, st)"""
_ZZ = ["symbol", "kind", "ts", "pos", "price", "ordinal"]
_ORD = "row_number() OVER (PARTITION BY symbol, kind ORDER BY pos DESC) - 1 AS ordinal"
register(
    "structure_zigzag",
    lambda s, d: structure.zigzag(daily(s, d), DAY).select(*_ZZ),
    f"WITH RECURSIVE {DAILY_SQL}, {ZIGZAG_SQL} SELECT symbol, kind, ts, pos, price, {_ORD} FROM zg",
)
register(
    "structure_confirmed_swings",
    lambda s, d: structure.confirmed(structure.zigzag(daily(s, d), DAY)).select(*_ZZ[:5]),
    f"""WITH RECURSIVE {DAILY_SQL}, {ZIGZAG_SQL}, n AS (SELECT DISTINCT symbol, total FROM b)
    SELECT symbol, kind, ts, pos, price FROM zg JOIN n USING (symbol) WHERE total - 1 - pos >= 18""",
)
register(
    "structure_untouched_swings",
    lambda s, d: structure.untouched_swings(daily(s, d), DAY),
    f"""WITH {DAILY_SQL}, c AS (SELECT *, max(high) OVER w AS mh, min(low) OVER w AS ml, count(*) OVER w AS n, lag(high, 5) OVER o AS ph, lead(high, 5) OVER o AS nh, lag(low, 5) OVER o AS pl, lead(low, 5) OVER o AS nl,
    max(high) OVER f AS fh, min(low) OVER f AS fl FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), o AS (PARTITION BY symbol ORDER BY pos),
    f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT symbol, ts, 'high' AS kind, high AS price FROM c WHERE n = 5 AND high = mh AND ph < high AND nh < high AND fh < high
    UNION ALL SELECT symbol, ts, 'low', low FROM c WHERE n = 5 AND low = ml AND pl > low AND nl > low AND fl > low""",
)
PIVOT_SQL = """
pv0 AS (SELECT *, max(high) OVER w AS mh, min(low) OVER w AS ml FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)),
pv AS MATERIALIZED (SELECT symbol, ts, pos, 'high' AS kind, high AS price FROM pv0 WHERE high = mh AND pos BETWEEN 15 AND total - 16
  UNION ALL SELECT symbol, ts, pos, 'low', low FROM pv0 WHERE low = ml AND pos BETWEEN 15 AND total - 16)"""
register(
    "structure_pivots",
    lambda s, d: structure.pivots(daily(s, d), DAY),
    f"WITH {DAILY_SQL}, {PIVOT_SQL} SELECT symbol, ts, pos, kind, price FROM pv",
)
register(
    "structure_fair_value_gaps",
    lambda s, d: rounded(
        structure.fair_value_gaps(daily(s, d), DAY), 6, "top", "bottom", "fill_percentage", plain=("symbol", "ts", "type", "is_mitigated")
    ),
    f"""WITH {DAILY_SQL}, l AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(ts) OVER w AS mid, min(low) OVER f AS dl, max(high) OVER f AS th FROM b
    WINDOW w AS (PARTITION BY symbol ORDER BY pos), f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    g AS (SELECT symbol, mid AS ts, 'bullish' AS type, low AS top, h2 AS bottom, coalesce(dl <= h2, false) AS is_mitigated, coalesce(greatest(0, (low - dl) / (low - h2) * 100), 0) AS fill FROM l WHERE low > h2
    UNION ALL SELECT symbol, mid, 'bearish', l2, high, coalesce(th >= l2, false), coalesce(greatest(0, (th - high) / (l2 - high) * 100), 0) FROM l WHERE high < l2)
    SELECT symbol, ts, type, is_mitigated, round(top, 6) AS top, round(bottom, 6) AS bottom, round(CASE WHEN is_mitigated THEN 100 ELSE fill END, 6) AS fill_percentage FROM g""",
)
register(
    "structure_gap_predicate",
    lambda s, d: run(daily(s, d), DAY, structure.gap_predicate()).select("symbol", "ts", "has_gap"),
    f"""WITH {DAILY_SQL}, l AS (SELECT *, open > close AS sh, lag(open > close) OVER w AS psh, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos))
    SELECT symbol, ts, coalesce((high < l2 AND sh AND psh) OR (low > h2 AND NOT sh AND NOT psh), false) AS has_gap FROM l""",
)


def structure_sql(forget: bool) -> str:
    """CTE ``sx``: structure state after every bar with the events of the bar, one recursive step per bar."""
    kept = "coalesce(pl2, idm_l)" if not forget else "pl2"
    kept_h = "coalesce(ph2, idm_h)" if not forget else "ph2"
    up_ok, down_ok = ("bos_u", "bos_d") if not forget else ("idm_l1 <> 0", "idm_h1 <> 0")
    clear_l, clear_h = ("CASE WHEN tu THEN NULL ELSE pl2 END", "CASE WHEN td THEN NULL ELSE ph2 END") if forget else ("pl2", "ph2")
    return f"""
sx AS (SELECT symbol, CAST(-1 AS BIGINT) AS pos, high AS top, low AS bot, high AS top_h, low AS bot_h, 0 AS leg, 0 AS prev, NULL::DOUBLE AS pl, NULL::DOUBLE AS ph, high AS hh, low AS ll, low AS idm_l, high AS idm_h,
    high AS last_h, low AS last_l, false AS find, false AS bos_u, false AS bos_d, true AS coc_u, true AS coc_d, false AS e_iu, false AS e_id, false AS e_cu, false AS e_cd, false AS e_bu, false AS e_bd, NULL::DOUBLE AS p_iu, NULL::DOUBLE AS p_id, NULL::DOUBLE AS p_h, NULL::DOUBLE AS p_l
  FROM b WHERE pos = 0
  UNION ALL SELECT symbol, pos, top2, bot2, top_h2, bot_h2, leg2, prev2, {clear_l}, {clear_h}, hh2, ll2, idm_l1, idm_h1, greatest(CASE WHEN bd THEN hh2 ELSE last_h2 END, high), least(CASE WHEN bu THEN ll2 ELSE last_l2 END, low),
    find3 OR bu OR bd, (bos_u3 OR bu) AND NOT bd, (bos_d3 OR bd) AND NOT bu, (coc_u3 OR bu) AND NOT bd, (coc_d3 OR bd) AND NOT bu, tu, td, cu, cd, bu, bd, idm_l1, idm_h1, last_h2, last_l2
  FROM (SELECT *, NOT find3 AND NOT bu AND NOT bos_d3 AND coc_d3 AND low < last_l2 AND close < last_l2 AS bd FROM (
  SELECT *, NOT find3 AND NOT bos_u3 AND coc_u3 AND high > last_h2 AND close > last_h2 AS bu FROM (
  SELECT *, find2 OR cu OR cd AS find3, (bos_u2 OR cu) AND NOT cd AS bos_u3, (bos_d2 AND NOT cu) OR cd AS bos_d3, (coc_u OR cu) AND NOT cd AS coc_u3, (coc_d AND NOT cu) OR cd AS coc_d3 FROM (
  SELECT *, (coc_u OR cu) AND low < last_l2 AND close < last_l2 AS cd FROM (
  SELECT *, coc_d AND high > last_h2 AND close > last_h2 AS cu FROM (
  SELECT *, CASE WHEN tu THEN low ELSE ll1 END AS ll2, CASE WHEN td THEN high ELSE hh1 END AS hh2, CASE WHEN tu THEN hh1 ELSE last_h END AS last_h2, CASE WHEN td THEN ll1 ELSE last_l END AS last_l2,
    find AND NOT tu AND NOT td AS find2, bos_u AND NOT tu AS bos_u2, bos_d AND NOT td AS bos_d2 FROM (
  SELECT *, find AND NOT tu AND coc_d AND {down_ok} AND coalesce(high > idm_h1, false) AS td FROM (
  SELECT *, find AND coc_u AND {up_ok} AND coalesce(low < idm_l1, false) AS tu FROM (
  SELECT *, CASE WHEN high >= hh THEN {kept} ELSE idm_l END AS idm_l1, CASE WHEN low <= ll THEN {kept_h} ELSE idm_h END AS idm_h1, greatest(hh, high) AS hh1, least(ll, low) AS ll1 FROM (
  SELECT *, CASE WHEN o AND prev1 = 1 THEN top ELSE top_h END AS top_h2, CASE WHEN o AND prev1 <> 1 THEN bot ELSE bot_h END AS bot_h2, CASE WHEN o THEN prev1 WHEN u OR w THEN 0 ELSE prev END AS prev2,
    CASE WHEN o THEN 0 WHEN u THEN 1 WHEN w THEN -1 ELSE leg END AS leg2, CASE WHEN o OR u OR w THEN high ELSE top END AS top2, CASE WHEN o OR u OR w THEN low ELSE bot END AS bot2,
    CASE WHEN u AND leg <= 0 THEN bot WHEN w AND leg = 0 AND prev <> 1 THEN bot_h ELSE pl END AS pl2, CASE WHEN u AND leg = 0 AND prev = 1 THEN top_h WHEN w AND leg >= 0 THEN top ELSE ph END AS ph2 FROM (
  SELECT *, CASE WHEN leg <> 0 THEN leg ELSE prev END AS prev1 FROM (
  SELECT s.* EXCLUDE (symbol, pos), x.symbol, x.pos, x.high, x.low, x.close, x.high >= s.top AND x.low <= s.bot AS o, x.high >= s.top AND x.low > s.bot AS u, x.high < s.top AND x.low <= s.bot AS w
  FROM sx s JOIN b x ON x.symbol = s.symbol AND x.pos = s.pos + 1) q1) q2) q3) q4) q5) q6) q7) q8) q9) q10) q11) q12)"""


def _event_sql(rows: list[tuple[str, str, str]], select: str) -> str:
    return " UNION ALL ".join(f"SELECT sx.symbol, b.ts, {select.format(*r)} AS price FROM sx JOIN b USING (symbol, pos) WHERE {r[2]}" for r in rows)


_BOS = [("'BOS_Up'", "p_h", "e_bu"), ("'BOS_Down'", "p_l", "e_bd")]
_CHOCH = [("'ChoCh_Up'", "p_h", "e_cu"), ("'ChoCh_Down'", "p_l", "e_cd")]
register(
    "structure_bos",
    lambda s, d: structure.breaks_of_structure(daily(s, d), DAY),
    f"WITH RECURSIVE {DAILY_SQL}, {structure_sql(False)} {_event_sql(_BOS, '{0} AS type, {1}')}",
)
register(
    "structure_choch",
    lambda s, d: structure.changes_of_character(daily(s, d), DAY),
    f"WITH RECURSIVE {DAILY_SQL}, {structure_sql(False)} {_event_sql(_CHOCH, '{0} AS type, {1}')}",
)
_SCRIPT = [
    ("'BOS' AS event, 'up'", "p_h", "e_bu"), ("'BOS' AS event, 'down'", "p_l", "e_bd"), ("'CHOCH' AS event, 'up'", "p_h", "e_cu"), ("'CHOCH' AS event, 'down'", "p_l", "e_cd"),
    ("'IDM' AS event, 'up'", "p_iu", "e_iu"), ("'IDM' AS event, 'down'", "p_id", "e_id"),
]
register(
    "structure_script_breaks",
    lambda s, d: structure.structure_events(daily(s, d), DAY, forget=True).filter(F.col("event").isin("BOS", "CHOCH", "IDM")).select(
        "symbol", "ts", "event", "direction", "price"
    ),
    f"WITH RECURSIVE {DAILY_SQL}, {structure_sql(True)} {_event_sql(_SCRIPT, '{0} AS direction, {1}')}",
)
MOTHER_SQL = """
mo AS (SELECT symbol, pos, high AS mh, low AS ml, pos AS mp, false AS ins FROM b WHERE pos = 0
  UNION ALL SELECT x.symbol, x.pos, CASE WHEN i THEN mh ELSE x.high END, CASE WHEN i THEN ml ELSE x.low END, CASE WHEN i THEN mp ELSE x.pos END, i
  FROM mo m JOIN b x ON x.symbol = m.symbol AND x.pos = m.pos + 1, LATERAL (SELECT m.mh > x.high AND m.ml < x.low AS i) f)"""
register(
    "structure_mother_bars",
    lambda s, d: structure.mother_bars(daily(s, d), DAY),
    f"WITH RECURSIVE {DAILY_SQL}, {MOTHER_SQL} SELECT symbol, ts, mp AS mother_pos, mh AS mother_high, ml AS mother_low FROM mo JOIN b USING (symbol, pos) WHERE ins",
)
OUTSIDE_SQL = """
ob AS (SELECT symbol, pos, high AS th, low AS bl, false AS hit FROM b WHERE pos = 0
  UNION ALL SELECT x.symbol, x.pos, CASE WHEN x.high >= th OR x.low <= bl THEN x.high ELSE th END, CASE WHEN x.high >= th OR x.low <= bl THEN x.low ELSE bl END, x.high > th AND x.low < bl
  FROM ob o JOIN b x ON x.symbol = o.symbol AND x.pos = o.pos + 1)"""
register(
    "structure_outside_bars",
    lambda s, d: structure.outside_bars(daily(s, d), DAY),
    f"WITH RECURSIVE {DAILY_SQL}, {OUTSIDE_SQL} SELECT symbol, ts, CASE WHEN close > open THEN 'up' ELSE 'down' END AS direction FROM ob JOIN b USING (symbol, pos) WHERE hit",
)
register("structure_inducements", lambda s, d: structure.inducements(daily(s, d), DAY))
# both sides as series of their own, demand on negated prices; one bar of the zone machine per recursion, zones in a list
ZONES_SQL = """
zv AS MATERIALIZED (SELECT symbol, pos, ts, s, CASE WHEN s = 0 THEN high ELSE -low END AS h, CASE WHEN s = 0 THEN low ELSE -high END AS l FROM b, (VALUES (0), (1)) sides(s)),
zb AS MATERIALIZED (SELECT *, lag(h, 1) OVER w AS h1, lag(l, 1) OVER w AS l1, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2, lag(h, 3) OVER w AS h3, lag(l, 3) OVER w AS l3, lag(h, 4) OVER w AS h4
  FROM zv WINDOW w AS (PARTITION BY symbol, s ORDER BY pos)),
zm AS (SELECT symbol, s, pos, false AS armed, CAST(NULL AS DOUBLE) AS top, CAST(NULL AS DOUBLE) AS bottom, CAST(0 AS BIGINT) AS af,
    CAST([] AS STRUCT(t DOUBLE, b DOUBLE, a BIGINT, m BOOLEAN)[]) AS zones, CAST([] AS STRUCT(e VARCHAR, a BIGINT, t DOUBLE, b DOUBLE)[]) AS told FROM zb WHERE pos = 3
  UNION ALL
  SELECT symbol, s, pos, CASE WHEN NOT armed THEN h3 > h4 AND h3 > h2 ELSE NOT born END,
    CASE WHEN NOT armed THEN CASE WHEN h3 > h4 AND h3 > h2 THEN h3 ELSE top END WHEN born THEN top WHEN h2 < h3 AND l2 > l3 THEN greatest(top, h2) ELSE h2 END,
    CASE WHEN NOT armed THEN CASE WHEN h3 > h4 AND h3 > h2 THEN l3 ELSE bottom END WHEN born THEN bottom WHEN h2 < h3 AND l2 > l3 THEN least(bottom, l2) ELSE l2 END,
    CASE WHEN NOT armed THEN CASE WHEN h3 > h4 AND h3 > h2 THEN pos - 3 ELSE af END WHEN born OR (h2 < h3 AND l2 > l3) THEN af ELSE pos - 2 END,
    CASE WHEN NOT born THEN kept WHEN joins THEN list_append(kept[:-2], joined) ELSE list_append(kept, {'t': top, 'b': bottom, 'a': af, 'm': false}) END,
    list_concat(list_transform(list_filter(zones, lambda z: h >= z.t), lambda z: {'e': 'removed', 'a': z.a, 't': z.t, 'b': z.b}),
      list_transform(list_filter(zones, lambda z: h < z.t AND h >= z.b AND NOT z.m), lambda z: {'e': 'mitigated', 'a': z.a, 't': z.t, 'b': z.b}),
      CASE WHEN NOT born THEN [] WHEN joins THEN [{'e': 'merged', 'a': joined.a, 't': joined.t, 'b': joined.b}] ELSE [{'e': 'created', 'a': af, 't': top, 'b': bottom}] END)
  FROM (SELECT *, {'t': greatest(top, tail.t), 'b': least(bottom, tail.b), 'a': tail.a, 'm': false} AS joined,
      coalesce(NOT tail.m AND tail.t > tail.b AND (abs(top - tail.t) / (tail.t - tail.b) < 0.5 OR abs(bottom - tail.b) / (tail.t - tail.b) < 0.5 OR (top >= tail.b AND bottom <= tail.t)), false) AS joins
    FROM (SELECT *, kept[-1] AS tail FROM (
      SELECT z.symbol, z.s, z.armed, z.top, z.bottom, z.af, z.zones, x.pos, x.h, x.h1, x.h2, x.l2, x.h3, x.l3, x.h4, z.armed AND z.bottom > x.h1 AND z.bottom <> 0 AS born,
        list_transform(list_filter(z.zones, lambda q: x.h < q.t), lambda q: {'t': q.t, 'b': q.b, 'a': q.a, 'm': q.m OR x.h >= q.b}) AS kept
      FROM zm z JOIN zb x ON x.symbol = z.symbol AND x.s = z.s AND x.pos = z.pos + 1)))),
ze AS MATERIALIZED (SELECT symbol, pos, s, unnest(told, recursive := true) FROM zm WHERE len(told) > 0),
zone AS (SELECT symbol, pos, CASE WHEN s = 0 THEN 'supply' ELSE 'demand' END AS kind, e AS event, a AS start_pos, CASE WHEN s = 0 THEN t ELSE -b END AS top, CASE WHEN s = 0 THEN b ELSE -t END AS bottom FROM ze)"""
register(
    "structure_zone_events",
    lambda s, d: structure.zone_events(daily(s, d), DAY),
    f"WITH RECURSIVE {DAILY_SQL}, {ZONES_SQL} SELECT zone.symbol, b.ts, zone.pos, kind, event, start_pos, top, bottom FROM zone JOIN b USING (symbol, pos)",
)
_NEWEST = "(pos, CASE event WHEN 'removed' THEN 3 WHEN 'mitigated' THEN 2 ELSE 1 END)"
register(
    "structure_order_blocks",
    lambda s, d: structure.order_blocks(daily(s, d), DAY),
    f"""WITH RECURSIVE {DAILY_SQL}, {ZONES_SQL}, o AS (SELECT symbol, kind, start_pos, arg_max(top, {_NEWEST}) AS top, arg_max(bottom, {_NEWEST}) AS bottom,
    bool_or(event = 'removed') AS gone, bool_or(event = 'mitigated') AS met FROM zone GROUP BY ALL)
    SELECT symbol, kind, start_pos, top, bottom, CASE WHEN met THEN 'mitigated' ELSE 'active' END AS status FROM o WHERE NOT gone""",
)
register(
    "structure_script_events",
    lambda s, d: structure.structure_events(daily(s, d), DAY, forget=True).drop("pos"),
)
register(
    "structure_abcd",
    lambda s, d: rounded(
        structure.abcd_patterns(structure.confirmed(structure.zigzag(daily(s, d), DAY)), DAY), 6, "ratio", "d_price",
        plain=("symbol", "type", "a_pos", "b_pos", "c_pos", "c_ts"),
    ),
    f"""WITH RECURSIVE {DAILY_SQL}, {ZIGZAG_SQL}, n AS (SELECT DISTINCT symbol, total FROM b), s AS (SELECT zg.* FROM zg JOIN n USING (symbol) WHERE total - 1 - pos >= 18),
    e AS (SELECT *, lag(pos) OVER w AS ap, lag(price) OVER w AS av FROM s WINDOW w AS (PARTITION BY symbol, kind ORDER BY pos)),
    j AS (SELECT e.symbol, e.kind, e.ap, e.av, e.pos AS cp, e.ts AS ct, e.price AS cv, max(o.pos) AS bp, arg_max(o.price, o.pos) AS bv FROM e JOIN s o ON o.symbol = e.symbol AND o.kind <> e.kind AND o.pos > ap AND o.pos < e.pos GROUP BY ALL),
    k AS (SELECT *, CASE WHEN kind = 'high' THEN 1 ELSE -1 END AS sg FROM j), r AS (SELECT *, (av - bv) * sg AS ab, (cv - bv) * sg AS bc FROM k)
    SELECT symbol, CASE WHEN sg = 1 THEN 'bullish' ELSE 'bearish' END AS type, ap AS a_pos, bp AS b_pos, cp AS c_pos, ct AS c_ts, round(bc / ab, 6) AS ratio, round(cv - ab * sg, 6) AS d_price
    FROM r WHERE ab > 0 AND bc > 0 AND bc / ab BETWEEN 0.55 AND 0.85""",
)
register(
    "structure_levels",
    lambda s, d: rounded(structure.structure_levels(daily(s, d), DAY), 4, "structure_high", "structure_low", "equilibrium"),
    f"""WITH RECURSIVE {DAILY_SQL}, {structure_sql(True)} SELECT symbol, ts, round(last_h, 4) AS structure_high, round(last_l, 4) AS structure_low, round((last_h + last_l) / 2, 4) AS equilibrium FROM sx JOIN b USING (symbol, pos)""",
)
register("structure_script_zones", lambda s, d: structure.script_zones(daily(s, d), DAY).drop("pos"))
