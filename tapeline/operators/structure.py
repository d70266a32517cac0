"""Market structure: swings, gaps, breaks of structure, inducements, zones, AB=CD patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tapeline.functions.candles import colour
from tapeline.operators.fold import fold_columns, fold_events
from tapeline.operators.layout import CHUNK, CORE, POS, TOTAL, Laid, lay_out, with_positions
from tapeline.operators.scans import prefix_carry, rolling, shift
from tapeline.operators.steps import Step
from tapeline.operators.touch import first_touch
from tapeline.session import chunk_rows, materialize

NAN = float("nan")


# -- swings -----------------------------------------------------------------------------------------------------


def zigzag(
    bars: DataFrame, seconds: float, depth: int = 12, deviation: float = 5.0, backstep: int = 3, point: float = 1e-4
) -> DataFrame:
    """Alternating peaks and bottoms: ``symbol, kind, ts, pos, price, ordinal`` (newest of a kind is 0).

    A candidate is a new rolling extreme that no changed extreme within the next ``backstep`` bars beats. Runs of
    candidates of one kind keep their extreme, the earliest on ties.
    """

    def candidates(laid: Laid) -> Laid:
        laid = laid.add({"_m": rolling(laid, F.min, "low", depth), "_x": rolling(laid, F.max, "high", depth)})
        fresh_low = F.col("_m") != F.coalesce(shift(laid, "_m"), F.lit(0.0))
        fresh_high = F.col("_x") != F.coalesce(shift(laid, "_x"), F.lit(0.0))
        near = deviation * point
        laid = laid.add(
            {
                "_cl": F.when(fresh_low & (F.col("low") - F.col("_m") <= near), F.col("_m")),
                "_ch": F.when(fresh_high & (F.col("_x") - F.col("high") <= near), F.col("_x")),
            }
        )
        ahead = laid.frame(1, backstep)
        low_kept = (F.col("_cl") == F.col("low")) & ~F.coalesce(F.min("_cl").over(ahead) < F.col("low"), F.lit(False))
        high_kept = (F.col("_ch") == F.col("high")) & ~F.coalesce(F.max("_ch").over(ahead) > F.col("high"), F.lit(False))
        return laid.add({"is_low": F.coalesce(low_kept, F.lit(False)), "is_high": F.coalesce(high_kept, F.lit(False))})

    laid = candidates(lay_out(bars, seconds, depth + 1, backstep))
    hits = laid.core(keep=[POS, TOTAL]).filter("is_low OR is_high")
    hits = hits.select("symbol", "ts", F.col(POS).alias("pos"), "is_low", "is_high", "low", "high", F.col(TOTAL).alias("bars"))
    hits = materialize(hits)
    first = hits.groupBy("symbol").agg(F.min("pos").alias("_first"))
    hits = hits.join(first, "symbol").filter("NOT (is_low AND is_high) OR pos = _first").drop("_first")
    kind = F.when(F.col("is_high"), "high").otherwise("low")
    hits = hits.select(
        "symbol", "ts", "pos", "bars", kind.alias("kind"), F.when(F.col("is_high"), F.col("high")).otherwise(F.col("low")).alias("price")
    )
    runs = lay_out(hits, seconds, 1)
    turned = shift(runs, "kind").isNull() | (shift(runs, "kind") != F.col("kind"))
    runs = runs.add({"_turn": turned.cast("long")})
    runs = prefix_carry(runs, {"_run": ("sum", F.col("_turn"))})
    best = F.min(F.struct(F.when(F.col("kind") == "high", -F.col("price")).otherwise(F.col("price")).alias("rank"), "pos", "ts", "price"))
    swings = runs.core().groupBy("symbol", "kind", "_run").agg(best.alias("_b"), F.max("bars").alias("bars"))
    swings = swings.select("symbol", "kind", "_b.ts", "_b.pos", "_b.price", "bars")
    placed = with_positions(materialize(swings), seconds, keys=("symbol", "kind"))
    return placed.withColumn("ordinal", F.col(TOTAL) - 1 - F.col(POS)).drop(POS, TOTAL)


def confirmed(swings: DataFrame, depth: int = 12, mult: float = 1.5) -> DataFrame:
    """Swings far enough from the newest bar to be final."""
    return swings.filter(F.col("bars") - 1 - F.col("pos") >= math.ceil(depth * mult))


def untouched_swings(bars: DataFrame, seconds: float, window: int = 5, lookback: int | None = None) -> DataFrame:
    """Centred extremes beyond the bars ``window`` rows away on both sides that no later bar reached."""
    from tapeline.operators.bars import last_n

    source = last_n(bars, lookback, seconds) if lookback else bars
    back = window // 2
    ahead = window - 1 - back
    laid = lay_out(source, seconds, window, window)
    frame = laid.frame(-back, ahead)
    full = F.count("close").over(frame) == window
    laid = laid.add(
        {
            "_sh": full
            & (F.col("high") == F.max("high").over(frame))
            & (shift(laid, "high", window) < F.col("high"))
            & (shift(laid, "high", -window) < F.col("high")),
            "_sl": full
            & (F.col("low") == F.min("low").over(frame))
            & (shift(laid, "low", window) > F.col("low"))
            & (shift(laid, "low", -window) > F.col("low")),
        }
    )
    later = {"_later_high": ("max", F.col("high")), "_later_low": ("min", F.col("low"))}
    laid = prefix_carry(laid, later, reverse=True, inclusive=False)
    high = F.when(F.col("_sh") & ~F.coalesce(F.col("_later_high") >= F.col("high"), F.lit(False)), F.struct(F.lit("high"), "high"))
    low = F.when(F.col("_sl") & ~F.coalesce(F.col("_later_low") <= F.col("low"), F.lit(False)), F.struct(F.lit("low"), "low"))
    shape = "struct<kind:string,price:double>"
    rows = laid.core().select("symbol", "ts", F.explode(F.array_compact(F.array(high.cast(shape), low.cast(shape)))).alias("_s"))
    return rows.select("symbol", "ts", "_s.kind", "_s.price")


def pivots(bars: DataFrame, seconds: float, length: int = 15) -> DataFrame:
    """Bars equal to the extreme of ``length`` bars on both sides: ``symbol, ts, pos, kind, price``."""
    laid = lay_out(bars, seconds, length, length)
    frame = laid.frame(-length, length)
    inside = (F.col(POS) >= length) & (F.col(POS) < F.col(TOTAL) - length)
    high = F.when(inside & (F.col("high") == F.max("high").over(frame)), F.struct(F.lit("high"), "high"))
    low = F.when(inside & (F.col("low") == F.min("low").over(frame)), F.struct(F.lit("low"), "low"))
    shape = "struct<kind:string,price:double>"
    laid = laid.add({"_p": F.array_compact(F.array(high.cast(shape), low.cast(shape)))})
    rows = laid.core(keep=[POS]).select("symbol", "ts", F.col(POS).alias("pos"), F.explode("_p").alias("_s"))
    return rows.select("symbol", "ts", "pos", "_s.kind", "_s.price")


# -- fair-value gaps --------------------------------------------------------------------------------------------


def fair_value_gaps(
    bars: DataFrame, seconds: float, unmitigated_only: bool = False, unfilled_only: bool = False
) -> DataFrame:
    """Three-bar gaps named by their middle bar, with how far later bars filled them."""
    laid = lay_out(bars, seconds, 2)
    laid = laid.add(
        {"_h2": shift(laid, "high", 2), "_l2": shift(laid, "low", 2), "_mid": shift(laid, "ts", 1)}
    )
    later = {"_deep": ("min", F.col("low")), "_tall": ("max", F.col("high"))}
    laid = prefix_carry(laid, later, reverse=True, inclusive=False)
    rising = F.col("low") > F.col("_h2")
    falling = F.col("high") < F.col("_l2")
    gaps = laid.core().filter(rising | falling)
    top = F.when(rising, F.col("low")).otherwise(F.col("_l2"))
    bottom = F.when(rising, F.col("_h2")).otherwise(F.col("high"))
    gaps = gaps.select(
        "symbol",
        F.col("_mid").alias("ts"),
        F.when(rising, "bullish").otherwise("bearish").alias("type"),
        top.alias("top"),
        bottom.alias("bottom"),
        "_deep",
        "_tall",
    )
    bullish = F.col("type") == "bullish"
    hit = F.when(bullish, F.col("_deep") <= F.col("bottom")).otherwise(F.col("_tall") >= F.col("top"))
    depth = F.when(bullish, F.col("top") - F.col("_deep")).otherwise(F.col("_tall") - F.col("bottom"))
    fill = F.coalesce(F.greatest(depth / (F.col("top") - F.col("bottom")) * 100, F.lit(0.0)), F.lit(0.0))
    done = gaps.withColumn("is_mitigated", F.coalesce(hit, F.lit(False)))
    done = done.withColumn("fill_percentage", F.when(F.col("is_mitigated"), F.lit(100.0)).otherwise(fill))
    done = done.drop("_deep", "_tall")
    if unmitigated_only:
        done = done.filter(~F.col("is_mitigated"))
    if unfilled_only:
        done = done.filter(F.col("fill_percentage") < 100)
    return done


def gap_predicate(out: str = "has_gap") -> Step:
    """Gap between the closed bar and the one two before it, in the colour of the last two."""

    def apply(laid: Laid) -> Laid:
        laid = laid.add({"_colour": colour()})
        now, before = F.col("_colour"), shift(laid, "_colour")
        down = (F.col("high") < shift(laid, "low", 2)) & (now == "short") & (before == "short")
        up = (F.col("low") > shift(laid, "high", 2)) & (now == "long") & (before == "long")
        return laid.add({out: F.coalesce(down | up, F.lit(False))}).drop("_colour")

    return Step(apply, 2)


# -- breaks of structure and inducements ------------------------------------------------------------------------

# Event codes of the structure fold.
STRUCTURE_EVENTS = ("BOS", "CHOCH", "IDM", "SWEEP", "PULLBACK", "HH_LL", "HL_LH", "TARGET")
BOS, CHOCH, IDM, SWEEP, PULLBACK, TREND_EXTREME, PULLBACK_EXTREME, TARGET = range(8)


def structure_step(forget: bool, join_idm: bool, skip_first: bool):
    """One bar of the structure state machine; both directions share the code.

    Side 0 looks up, side 1 looks down on negated prices, so a test such as "high above the last high" is written once.
    ``forget``: pullbacks are forgotten when their level is taken, and a missing pullback clears the level.
    ``join_idm``: an inducement at the opposite structure level moves that level back or turns the trend.
    ``skip_first``: the first bar only starts the state.
    Emits ``(event code, side, price, start position, other)`` rows.
    """

    def step(state, row):
        pos, high, low, close = row
        out = []
        if not state:
            leg, prev, held, held_at, box, box_at = 0.0, 0.0, [high, low], pos, [high, low], pos
            extreme, last, stack = [high, -low], [high, -low], [NAN, NAN]
            level = [NAN, NAN] if skip_first else [low, -high]
            level_at, pull, pull_at, broke, trend = [NAN, NAN], [NAN, NAN], [NAN, NAN], [0.0, 0.0], [1.0, 1.0]
            searching, by_break = 0.0, 0.0
            fresh = skip_first
        else:
            fresh = False
            (leg, prev, held_at, box_at, searching, by_break, h0, h1, b0, b1) = state[:10]
            held, box = [h0, h1], [b0, b1]
            extreme, last, stack, level, level_at, pull, pull_at, broke, trend = (
                state[10 + 2 * i : 12 + 2 * i] for i in range(9)
            )
        if not fresh:
            # 1. pullback points
            if high >= box[0] and low <= box[1]:
                prev = leg or prev
                if prev > 0:
                    held[0] = box[0]
                else:
                    held[1] = box[1]
                held_at, leg, box, box_at = box_at, 0.0, [high, low], pos
            elif high >= box[0] or low <= box[1]:
                rising = high >= box[0]
                tops, bottoms = [], []
                if rising:
                    if leg == 0 and prev > 0:
                        tops.append((held[0], held_at))
                    if leg <= 0:
                        bottoms.append((box[1], box_at))
                else:
                    if leg == 0 and prev <= 0:
                        bottoms.append((held[1], held_at))
                    if leg >= 0:
                        tops.append((box[0], box_at))
                for price, at in tops:
                    pull[1], pull_at[1] = -price, at
                    out.append((PULLBACK, 1.0, price, at, NAN))
                for price, at in bottoms:
                    pull[0], pull_at[0] = price, at
                    out.append((PULLBACK, 0.0, price, at, NAN))
                leg, prev, box, box_at = (1.0 if rising else -1.0), 0.0, [high, low], pos

            views = ((high, low, close, 1.0), (-low, -high, -close, -1.0))
            # 2. new extremes take the last pullback as inducement level
            for s, (ahead, _, _, _) in enumerate(views):
                if ahead >= extreme[s]:
                    extreme[s] = ahead
                    if forget or pull[s] == pull[s]:
                        level[s], level_at[s] = pull[s], pull_at[s]
            # 3. the level is taken
            for s, (_, behind, _, sign) in enumerate(views):
                o = 1 - s
                if searching and trend[s] and (broke[s] or forget) and behind < level[s] and (level[s] != 0 or not forget):
                    out.append((IDM, float(s), sign * level[s], level_at[s], NAN))
                    searching, broke[s], extreme[o] = 0.0, 0.0, -behind
                    if join_idm and level[s] == -last[o]:
                        if by_break:
                            last[o] = stack[o] if stack[o] == stack[o] else last[o]
                        else:
                            trend[s], trend[o] = 0.0, 1.0
                    last[s] = extreme[s]
                    stack = list(last)
                    out.append((TREND_EXTREME, float(s), sign * last[s], NAN, NAN))
                    if forget:
                        pull[s], pull_at[s] = NAN, NAN
            # 4. change of character against the trend of the other side
            for s, (ahead, _, end, sign) in enumerate(views):
                o = 1 - s
                if trend[o] and ahead > last[s]:
                    if end > last[s]:
                        out.append((CHOCH, float(s), sign * last[s], NAN, NAN))
                        searching, by_break = 1.0, 0.0
                        broke[s], trend[s], broke[o], trend[o] = 1.0, 1.0, 0.0, 0.0
                        out.append((TARGET, float(s), max(sign * ahead + sign * abs(last[s] + last[o]), 0.0), NAN, NAN))
                    else:
                        out.append((SWEEP, float(s), sign * last[s], NAN, NAN))
            # 5. break of structure with the trend
            for s, (ahead, _, end, sign) in enumerate(views):
                o = 1 - s
                if not searching and not broke[s] and trend[s] and ahead > last[s]:
                    if end > last[s]:
                        out.append((BOS, float(s), sign * last[s], NAN, NAN))
                        searching, by_break = 1.0, 1.0
                        broke[s], trend[s], broke[o], trend[o] = 1.0, 1.0, 0.0, 0.0
                        out.append((PULLBACK_EXTREME, float(s), -sign * extreme[o], NAN, NAN))
                        last[o] = extreme[o]
                        out.append((TARGET, float(s), max(sign * ahead + sign * abs(last[s] + last[o]), 0.0), NAN, NAN))
                    else:
                        out.append((SWEEP, float(s), sign * last[s], NAN, NAN))
            # 6. the structure levels follow the bar
            last = [max(last[0], high), max(last[1], -low)]
        flat = [leg, prev, held_at, box_at, searching, by_break, *held, *box]
        for pair in (extreme, last, stack, level, level_at, pull, pull_at, broke, trend):
            flat += pair
        return flat, out

    return step


_EVENT_COLUMNS = StructType([StructField(n, DoubleType()) for n in ("code", "side", "price", "start_pos", "other")])


def structure_events(
    bars: DataFrame,
    seconds: float,
    forget: bool = False,
    join_idm: bool = False,
    skip_first: bool = False,
    warmup: int = 1024,
) -> DataFrame:
    """All events of the structure fold: ``symbol, ts, pos, event, direction, price, start_pos``."""
    laid = lay_out(bars, seconds, warmup)
    laid = laid.add({"_p": F.col(POS).cast("double")})
    step = structure_step(forget, join_idm, skip_first)
    rows = fold_events(laid, step, ["_p", "high", "low", "close"], _EVENT_COLUMNS)
    names = F.array(*[F.lit(n) for n in STRUCTURE_EVENTS])
    return rows.select(
        "symbol",
        "ts",
        F.col(POS).alias("pos"),
        F.element_at(names, F.col("code").cast("int") + 1).alias("event"),
        F.when(F.col("side") == 0, "up").otherwise("down").alias("direction"),
        "price",
        F.when(~F.isnan("start_pos"), F.col("start_pos").cast("long")).alias("start_pos"),
    )


def breaks_of_structure(bars: DataFrame, seconds: float) -> DataFrame:
    rows = structure_events(bars, seconds).filter(F.col("event") == "BOS")
    return rows.select("symbol", "ts", F.concat(F.lit("BOS_"), F.initcap("direction")).alias("type"), "price")


def changes_of_character(bars: DataFrame, seconds: float) -> DataFrame:
    rows = structure_events(bars, seconds).filter(F.col("event") == "CHOCH")
    return rows.select("symbol", "ts", F.concat(F.lit("ChoCh_"), F.initcap("direction")).alias("type"), "price")


def inducements(bars: DataFrame, seconds: float, join_idm: bool = True, length: int = 15) -> DataFrame:
    """Taken inducement levels with head, last pivot, start of move and the bars that later mitigate them."""
    events = structure_events(bars, seconds, forget=True, join_idm=join_idm, skip_first=True)
    events = events.filter(F.col("event") == "IDM").select(
        "symbol", "ts", "direction", F.col("price").alias("idm_price"), "start_pos", F.col("pos").alias("end_pos")
    )
    events = materialize(events)
    numbered = materialize(with_positions(bars, seconds, total=False).select("symbol", POS, "high", "low"))
    sign = F.when(F.col("direction") == "up", F.lit(1.0)).otherwise(F.lit(-1.0))

    # head: the extreme between the start of the level and the bar that takes it
    block = 256
    spans = events.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_pos") / block), F.floor(F.col("end_pos") / block))))
    inside = spans.join(numbered.withColumn("_block", F.floor(F.col(POS) / block)), ["symbol", "_block"])
    inside = inside.filter(F.col(POS).between(F.col("start_pos"), F.col("end_pos")))
    view = F.when(F.col("direction") == "up", F.col("high")).otherwise(-F.col("low"))
    heads = inside.groupBy("symbol", "direction", "end_pos").agg(
        F.min(F.struct((-view).alias("rank"), F.col(POS).alias("pos"))).alias("_head")
    )
    events = events.join(heads, ["symbol", "direction", "end_pos"])
    events = events.select(
        *[c for c in events.columns if c != "_head"], F.col("_head.pos").alias("head_pos"), (-F.col("_head.rank") * sign).alias("head_price")
    )

    # pivots before the take, before the head, and the first one beyond the level before the left shoulder
    turns = pivots(bars, seconds, length).select("symbol", "kind", F.col("pos").alias("_pp"), F.col("price").alias("_pv"))
    turns = materialize(turns)
    ids = ["symbol", "direction", "end_pos"]
    events = materialize(events.withColumn("kind", F.when(F.col("direction") == "up", "high").otherwise("low")))
    anything, never = F.lit(float("-inf")), F.lit(None).cast("double")
    last_any = latest_before(events, turns, ids, "end_pos", ["symbol"], anything, never)
    shoulder = latest_before(events, turns, ids, "head_pos", ["symbol", "kind"], anything, never)
    events = events.join(last_any.select(*ids, F.col("_pp").alias("last_pivot_pos")), ids, "left")
    events = events.join(shoulder.select(*ids, F.col("_pp").alias("prev_pivot_pos")), ids, "left")
    events = materialize(events)
    up = F.col("direction") == "up"
    seekers = events.filter("prev_pivot_pos IS NOT NULL").withColumn("kind", F.when(up, "low").otherwise("high"))
    over, under = F.when(~up, F.col("idm_price")), F.when(up, F.col("idm_price"))
    origin = latest_before(seekers, turns, ids, "prev_pivot_pos", ["symbol", "kind"], over, under)
    events = events.join(
        origin.select(*ids, F.col("_pp").alias("start_of_move_pos"), F.col("_pv").alias("start_of_move_price")), ids, "left"
    )

    # first later bars that reach the head and the start of the move
    events = events.withColumns(
        {
            "_hu": F.when(up, F.col("head_price")),
            "_hd": F.when(~up, F.col("head_price")),
            "_su": F.when(~up, F.col("start_of_move_price")),
            "_sd": F.when(up, F.col("start_of_move_price")),
        }
    )
    events = materialize(events)
    events = first_touch(events, numbered, ids, "end_pos", "_hu", "_hd", "high", "low", out="head_mitigated_pos")
    events = materialize(events)
    events = first_touch(events, numbered, ids, "end_pos", "_su", "_sd", "high", "low", out="start_mitigated_pos")
    name = F.when(up, "Bullish_IDM_Taken").otherwise("Bearish_IDM_Taken")
    return events.withColumn("type", name).drop("_hu", "_hd", "_su", "_sd", "kind")


def latest_before(
    events: DataFrame, points: DataFrame, ids: list[str], before: str, keys: list[str], over: Column, under: Column
) -> DataFrame:
    """Newest point before position ``before`` with a value over ``over`` or under ``under`` (null: not asked for).

    The first-touch search on negated positions; ``points`` holds ``_pp`` and ``_pv``.
    """
    asked = events.select(*dict.fromkeys([*ids, *keys]), (-F.col(before)).alias("_at"), over.alias("_over"), under.alias("_under"))
    mirrored = points.select(*keys, (-F.col("_pp")).alias("_back"), "_pv")
    found = first_touch(
        asked, mirrored, ids, "_at", "_over", "_under", "_pv", "_pv", keys=keys, row_pos="_back", out="_hit", strict=True
    ).filter("_hit IS NOT NULL")
    found = found.select(*dict.fromkeys([*ids, *keys]), (-F.col("_hit")).alias("_pp"))
    return found.join(points.select(*keys, "_pp", "_pv"), [*keys, "_pp"]).dropDuplicates(ids).select(*ids, "_pp", "_pv")


# -- supply and demand zones ------------------------------------------------------------------------------------

ZONE_EVENTS = ("created", "merged", "mitigated", "removed")


def zone_step(merge_ratio: float, mother_bar: bool):
    """One bar of the zone machine; supply is side 0, demand is side 1 on negated prices.

    State per side: armed flag, candidate (top, bottom, position), then the open zones as (top, bottom, position,
    mitigated). Emits ``(event, side, position of the zone, top, bottom)``.
    """

    def step(state, row):
        pos, h0, l0, h1, l1, h2, l2, h3, l3, h4, l4 = row
        if h4 != h4 or h4 is None:
            return state, []
        sides, out = _zone_sides(state), []
        views = (
            ((h0, l0), (h1, l1), (h2, l2), (h3, l3), (h4, l4)),
            ((-l0, -h0), (-l1, -h1), (-l2, -h2), (-l3, -h3), (-l4, -h4)),
        )
        for s, (bar0, bar1, bar2, bar3, bar4) in enumerate(views):
            armed, top, bottom, at, zones = sides[s]
            show = (lambda t, b: (t, b)) if s == 0 else (lambda t, b: (-b, -t))
            reach = bar0[0]
            if zones and reach >= min(z[0] if z[3] else z[1] for z in zones):
                kept = []
                for zone in zones:
                    if reach >= zone[0]:
                        out.append((3.0, float(s), zone[2], *show(zone[0], zone[1])))
                        continue
                    if reach >= zone[1] and not zone[3]:
                        zone[3] = 1.0
                        out.append((2.0, float(s), zone[2], *show(zone[0], zone[1])))
                    kept.append(zone)
                zones = kept
            if not armed:
                if bar3[0] > bar4[0] and bar3[0] > bar2[0]:
                    armed, top, bottom, at = 1.0, bar3[0], bar3[1], pos - 3
            elif bottom > bar1[0] and bottom != 0:
                armed = 0.0
                tail = zones[-1] if zones and not zones[-1][3] else None
                width = tail[0] - tail[1] if tail else 0.0
                joins = width > 0 and (
                    abs(top - tail[0]) / width < merge_ratio
                    or abs(bottom - tail[1]) / width < merge_ratio
                    or (top >= tail[1] and bottom <= tail[0])
                )
                if joins:
                    tail[0], tail[1] = max(top, tail[0]), min(bottom, tail[1])
                    out.append((1.0, float(s), tail[2], *show(tail[0], tail[1])))
                else:
                    zones = [*zones, [top, bottom, at, 0.0]]
                    out.append((0.0, float(s), at, *show(top, bottom)))
            elif mother_bar and bar2[0] < bar3[0] and bar2[1] > bar3[1]:
                top, bottom = max(top, bar2[0]), min(bottom, bar2[1])
            else:
                top, bottom, at = bar2[0], bar2[1], pos - 2
            sides[s] = [armed, top, bottom, at, zones]
        return _flat_sides(sides), out

    return step


def _zone_sides(state: list) -> list[list]:
    """Armed flag, candidate and list of open zones of both sides."""
    sides, rest = [], list(state) or [0.0, NAN, NAN, NAN, 0.0] * 2
    for _ in range(2):
        armed, top, bottom, at, count = rest[:5]
        cut = 5 + 4 * int(count)
        flat = rest[5:cut]
        sides.append([armed, top, bottom, at, [flat[i : i + 4] for i in range(0, len(flat), 4)]])
        rest = rest[cut:]
    return sides


def _flat_sides(sides: list[list]) -> list[float]:
    flat = []
    for armed, top, bottom, at, zones in sides:
        flat += [armed, top, bottom, at, float(len(zones))]
        for zone in zones:
            flat += zone
    return flat


def _zones_due(chunks: list[tuple[list, list, float, float]]) -> list[list | None]:
    """Entry state due to every chunk of a series, from (entry used, exit state, highest high, lowest low) of all of them.

    A chunk needs of the older open zones only those that its prices reach, and the newest one that they do not remove, since
    a new zone may join that. The others pass by it. A chunk that has not seen a zone yet is taken to do to it what its prices
    do. So a zone finds the chunk that ends it in one go, however far away.
    """
    due: list[list | None] = []
    open_: list[list[list]] = [[], []]
    leave: list | None = None
    for entry, exit_state, high, low in chunks:
        given: list[list] = [[], []]
        if leave is not None:
            for s, reach in enumerate((high, -low)):
                last = max((i for i, z in enumerate(open_[s]) if z[0] > reach), default=-1)
                given[s] = [z for i, z in enumerate(open_[s]) if i == last or reach >= (z[0] if z[3] else z[1])]
        due.append(None if leave is None else _flat_sides([[*side[:4], g] for side, g in zip(_zone_sides(leave), given)]))
        leave = exit_state
        for s, (before, after, reach) in enumerate(zip(_zone_sides(entry), _zone_sides(exit_state), (high, -low))):
            seen, left, kept = {z[2] for z in before[4]}, {z[2]: z for z in after[4]}, []  # a zone is known by its position
            asked = {z[2] for z in given[s]}
            for zone in open_[s]:
                if zone[2] in asked and zone[2] in seen:
                    zone = left.get(zone[2])
                elif zone[2] in asked:
                    zone = [*zone[:3], 1.0 if zone[3] or reach >= zone[1] else 0.0] if zone[0] > reach else None
                kept += [zone] if zone else []
            known = {z[2] for z in open_[s]} | seen
            open_[s] = kept + [z for z in after[4] if z[2] not in known]
    return due


def _relink_zones(laid: Laid):
    """The relink of the zone machine; one row per chunk of a series meets in a task."""
    keys = [*laid.keys, CHUNK]
    ranges = materialize(laid.df.filter(CORE).groupBy(*keys).agg(F.max("high").alias("_top"), F.min("low").alias("_low")))

    def relink(states: DataFrame) -> DataFrame:
        fields = [f for f in states.schema.fields if f.name in (*keys, "_entry")]
        schema = StructType([*fields, StructField("_due", states.schema["_exit"].dataType)])

        def link(pdf):
            pdf = pdf.sort_values(CHUNK)
            rows = zip(pdf["_entry"], pdf["_exit"], pdf["_top"].fillna(-float("inf")), pdf["_low"].fillna(float("inf")))
            due = _zones_due([(list(e), list(x), float(t), float(b)) for e, x, t, b in rows])
            return pdf[[f.name for f in fields]].assign(_due=due)

        return states.join(ranges, keys).groupBy(*laid.keys).applyInPandas(link, schema)

    return relink


_ZONE_COLUMNS = StructType([StructField(n, DoubleType()) for n in ("code", "side", "start_pos", "top", "bottom")])


def zone_events(
    bars: DataFrame, seconds: float, merge_ratio: float = 0.5, mother_bar: bool = True, warmup: int = 256
) -> DataFrame:
    """Creation, merging, mitigation and removal of zones: ``symbol, ts, pos, kind, event, start_pos, top, bottom``.

    Zones outlive chunks, so their entry states are not handed from chunk to chunk but linked over the whole series at once.
    """
    laid = lay_out(bars, seconds, warmup + 4)
    lags = {f"_{n[0]}{k}": shift(laid, n, k) for k in range(1, 5) for n in ("high", "low")}
    laid = laid.add({"_p": F.col(POS).cast("double"), **lags})
    inputs = ["_p", "high", "low"] + [f"_{c}{k}" for k in range(1, 5) for c in ("h", "l")]
    rows = fold_events(laid, zone_step(merge_ratio, mother_bar), inputs, _ZONE_COLUMNS, _relink_zones(laid))
    names = F.array(*[F.lit(n) for n in ZONE_EVENTS])
    return rows.select(
        "symbol",
        "ts",
        F.col(POS).alias("pos"),
        F.when(F.col("side") == 0, "supply").otherwise("demand").alias("kind"),
        F.element_at(names, F.col("code").cast("int") + 1).alias("event"),
        F.col("start_pos").cast("long").alias("start_pos"),
        "top",
        "bottom",
    )


def order_blocks(bars: DataFrame, seconds: float, merge_ratio: float = 0.5, mother_bar: bool = True) -> DataFrame:
    """Zones still open at the end: ``symbol, kind, start_pos, top, bottom, status``."""
    events = zone_events(bars, seconds, merge_ratio, mother_bar)
    rank = F.when(F.col("event") == "removed", 3).when(F.col("event") == "mitigated", 2).otherwise(1)
    newest = F.max_by(F.struct("top", "bottom"), F.struct("pos", rank)).alias("_last")
    zones = events.groupBy("symbol", "kind", "start_pos").agg(newest, F.max(rank).alias("_state"))
    open_zones = zones.filter(F.col("_state") < 3)
    status = F.when(F.col("_state") == 2, "mitigated").otherwise("active")
    return open_zones.select("symbol", "kind", "start_pos", "_last.top", "_last.bottom", status.alias("status"))


def zone_lives(bars: DataFrame, seconds: float, merge_ratio: float = 0.5, mother_bar: bool = True) -> DataFrame:
    """Stretches in which a zone is active with the same bounds: ``symbol, kind, top, bottom, from_pos, until_pos``.

    A stretch starts with the event that creates or widens the zone and ends before its next event; ``until_pos`` is null
    while it is open. Events of one zone are few.
    """
    events = zone_events(bars, seconds, merge_ratio, mother_bar)
    rank = F.when(F.col("event") == "removed", 3).when(F.col("event") == "mitigated", 2).otherwise(1)
    after = F.lead("pos").over(Window.partitionBy("symbol", "kind", "start_pos").orderBy("pos", rank))
    rows = events.withColumn("until_pos", after).filter(F.col("event").isin("created", "merged"))
    return rows.select("symbol", "kind", "top", "bottom", F.col("pos").alias("from_pos"), "until_pos")


# -- inside and outside bars ------------------------------------------------------------------------------------


def mother_bars(bars: DataFrame, seconds: float, warmup: int = 256) -> DataFrame:
    """Inside bars with the range of the bar that encloses them."""

    def step(state, row):
        high, low, pos = row
        if state and state[0] > high and state[1] < low:
            return state, [(state[2], state[0], state[1])]
        return [high, low, pos], []

    laid = lay_out(bars, seconds, warmup).add({"_p": F.col(POS).cast("double")})
    columns = StructType([StructField(n, DoubleType()) for n in ("mother_pos", "mother_high", "mother_low")])
    rows = fold_events(laid, step, ["high", "low", "_p"], columns)
    return rows.select("symbol", "ts", F.col("mother_pos").cast("long").alias("mother_pos"), "mother_high", "mother_low")


def outside_bars(bars: DataFrame, seconds: float) -> DataFrame:
    """Bars beyond both ends of the box left by the last bar that was not inside it."""

    def step(state, row):
        high, low = row
        if not state:
            return [high, low], []
        hit = high > state[0] and low < state[1]
        moved = high >= state[0] or low <= state[1]
        return ([high, low] if moved else state), ([(1.0,)] if hit else [])

    laid = lay_out(bars, seconds, 256)
    rows = fold_events(laid, step, ["high", "low"], StructType([StructField("hit", DoubleType())]))
    sides = bars.select("symbol", "ts", F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("direction"))
    return rows.select("symbol", "ts").join(sides, ["symbol", "ts"])


# -- AB=CD ------------------------------------------------------------------------------------------------------


def abcd_patterns(swings: DataFrame, seconds: float, low_ratio: float = 0.55, high_ratio: float = 0.85) -> DataFrame:
    """Every confirmed swing as C, the previous one of its kind as A, the last opposite one between them as B."""
    named = materialize(swings.select("symbol", "kind", "ts", "pos", "price"))
    laid = lay_out(named, seconds, 1, keys=("symbol", "kind"))
    laid = laid.add({"a_pos": shift(laid, "pos"), "a_price": shift(laid, "price"), "a_ts": shift(laid, "ts")})
    ends = laid.core().filter("a_pos IS NOT NULL").withColumnsRenamed({"pos": "c_pos", "price": "c_price", "ts": "c_ts"})

    # between two swings of one kind lie few swings of the other, so blocks of positions bound the join
    block = 512
    spans = ends.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a_pos") / block), F.floor(F.col("c_pos") / block))))
    other = named.select(
        "symbol",
        F.when(F.col("kind") == "high", "low").otherwise("high").alias("kind"),
        F.col("pos").alias("b_pos"),
        F.col("price").alias("b_price"),
        F.floor(F.col("pos") / block).alias("_block"),
    )
    inside = spans.join(other, ["symbol", "kind", "_block"]).filter("b_pos > a_pos AND b_pos < c_pos")
    picked = inside.groupBy("symbol", "kind", "c_pos").agg(F.max(F.struct("b_pos", "b_price")).alias("_b"))
    joined = ends.join(picked, ["symbol", "kind", "c_pos"]).select("*", "_b.b_pos", "_b.b_price").drop("_b")
    bullish = F.col("kind") == "high"
    sign = F.when(bullish, 1).otherwise(-1)
    ab = (F.col("a_price") - F.col("b_price")) * sign
    bc = (F.col("c_price") - F.col("b_price")) * sign
    out = joined.filter((ab > 0) & (bc > 0)).withColumns(
        {
            "type": F.when(bullish, "bullish").otherwise("bearish"),
            "ratio": bc / ab,
            "d_price": F.col("c_price") - ab * sign,
        }
    )
    out = out.filter(F.col("ratio").between(low_ratio, high_ratio))
    return out.select("symbol", "type", "a_pos", "a_price", "b_pos", "b_price", "c_pos", "c_ts", "c_price", "ratio", "d_price")


def min_score(losses: Column) -> Column:
    """Required score after a number of losses in a row."""
    return F.when(losses >= 2, 80).when(losses == 1, 75).otherwise(70)


def pattern_score(
    patterns: DataFrame, context: DataFrame, zones: DataFrame, use_rsi: bool, use_macd: bool, minutes: int
) -> DataFrame:
    """Score 0..100 of patterns whose C row carries ``context``: ``htf_trend, atr, atr_mean, rsi, macd_hist, macd_prev``.

    ``zones`` are stretches of active order blocks (``zone_lives``): only those that are active at the C bar count, so a
    score does not know the future. Zones and patterns meet in ranges of positions.
    """
    rows = patterns.join(context, ["symbol", "c_pos"])
    bullish = F.col("type") == "bullish"
    size = chunk_rows(patterns.sparkSession)
    last = F.coalesce(F.col("until_pos") - 1, F.col("_end"))
    ends = rows.groupBy("symbol").agg(F.max("c_pos").alias("_end"))
    active = zones.join(ends, "symbol").withColumn("_last", F.least(last, "_end")).filter(F.col("_last") >= F.col("from_pos"))
    active = active.withColumn("_range", F.explode(F.sequence(F.floor(F.col("from_pos") / size), F.floor(F.col("_last") / size))))
    near = (
        rows.withColumns({"kind": F.when(bullish, "demand").otherwise("supply"), "_range": F.floor(F.col("c_pos") / size)})
        .join(active.select("symbol", "kind", "_range", "from_pos", "_last", "top", "bottom"), ["symbol", "kind", "_range"])
        .filter(
            F.col("c_pos").between(F.col("from_pos"), F.col("_last"))
            & F.col("d_price").between(F.col("bottom") - F.col("atr") * 0.5, F.col("top") + F.col("atr") * 0.5)
        )
        .select("symbol", "type", "c_pos")
        .distinct()
        .withColumn("_zone", F.lit(True))
    )
    rows = rows.join(near, ["symbol", "type", "c_pos"], "left")
    geometry = F.greatest(F.lit(0.0), 1 - F.abs(F.col("ratio") - 0.7) / 0.15) * 25
    wanted = F.when(bullish, "long").otherwise("short")
    frame = F.when(F.lower("htf_trend") == wanted, 20).when(F.lower("htf_trend") == "neutral", 5).otherwise(0)
    zone = F.when(F.coalesce("_zone", F.lit(False)), 20).otherwise(0)
    low, high = (20, 80) if minutes < 15 else (30, 70)
    momentum = F.lit(0)
    if use_rsi:
        r = F.col("rsi")
        momentum = momentum + F.when(F.when(bullish, r < 50).otherwise(r > 50), 8).otherwise(0)
        momentum = momentum + F.when(F.when(bullish, r < low + 5).otherwise(r > high - 5), 4).otherwise(0)
    if use_macd:
        turn = F.col("macd_hist") - F.col("macd_prev")
        momentum = momentum + F.when(F.when(bullish, turn > 0).otherwise(turn < 0), 3).otherwise(0)
    vol = F.coalesce(F.try_divide(F.col("atr"), F.col("atr_mean")), F.lit(1.0))
    volatility = F.when(vol.between(0.7, 1.8), 10).when(vol.between(0.5, 2.5), 5).otherwise(0)
    total = geometry + frame + zone + F.least(momentum, F.lit(15)) + volatility
    return rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).drop("_zone")




# -- chart-script superset --------------------------------------------------------------------------------------


def structure_levels(bars: DataFrame, seconds: float, warmup: int = 1024) -> DataFrame:
    """Structure high and low after every bar, and their middle."""
    core = structure_step(forget=True, join_idm=False, skip_first=False)

    def step(state, row):
        state, _ = core(state, row)
        high, low = state[12], -state[13]
        return state, [high, low, (high + low) / 2]

    laid = lay_out(bars, seconds, warmup).add({"_p": F.col(POS).cast("double")})
    names = ["structure_high", "structure_low", "equilibrium"]
    return fold_columns(laid, step, ["_p", "high", "low", "close"], names).core().select("symbol", "ts", *names)


SCRIPT_ZONE_EVENTS = ("created", "merged", "breaker", "mitigated", "swept", "expired", "scob")
CREATED, MERGED, BREAKER, MITIGATED, SWEPT, EXPIRED, SCOB = (float(i) for i in range(7))


def script_zone_step(merge_ratio: float, mother_bar: bool, max_age: int):
    """One bar of the chart-script zones; both sides share the code on mirrored prices.

    Besides creation and merging: a zone broken through in one bar turns into one of the other side, touched zones are
    mitigated, swept and old ones removed, and a bar that turns inside the newest zone is reported.
    """

    def step(state, row):
        pos, close, *flat = row
        if flat[-1] is None or flat[-1] != flat[-1]:
            return state, []
        bars_ = [(flat[2 * k], flat[2 * k + 1]) for k in range(5)]  # (high, low) of this bar and the four before it
        if state:
            mothers, rest = state[:9], list(state[9:])
        else:
            mothers, rest = [NAN] * 9, [0.0, NAN, NAN, NAN, 0.0] * 2
        # mother bar after this bar, and those of one and two bars ago: (high, low, whether the bar was inside)
        (m0h, m0l, m0i, m1h, m1l, m1i), oldest = mothers[:6], mothers[3:6]
        inside = m0h == m0h and m0h > bars_[0][0] and m0l < bars_[0][1]
        now = [m0h, m0l, 1.0] if inside else [*bars_[0], 0.0]
        mothers = [*now, m0h, m0l, m0i, *oldest]
        sides = []
        for _ in range(2):
            armed, top, bottom, at, count = rest[:5]
            cut = 5 + 4 * int(count)
            sides.append([armed, top, bottom, at, [rest[i : i + 4] for i in range(5, cut, 4)]])
            rest = rest[cut:]
        out = []

        def tell(code, s, zone):
            top, bottom = (zone[0], zone[1]) if s == 0 else (-zone[1], -zone[0])
            out.append((code, float(s), zone[2], top, bottom))

        views = [bars_, [(-lo, -h) for h, lo in bars_]]
        for s, b in enumerate(views):
            armed, top, bottom, at, zones = sides[s]
            if not armed:
                (top, bottom), at = b[3], pos - 3
                armed = 1.0 if b[3][0] > b[4][0] and b[3][0] > b[2][0] else 0.0
            elif bottom > b[1][0]:
                armed = 0.0
                fresh = [top, bottom, at, 0.0]
                code = CREATED
                add = True
                if zones:
                    last = zones[-1]
                    width = last[0] - last[1]
                    close_edge = width > 0 and min(abs(top - last[0]), abs(bottom - last[1])) / width < merge_ratio
                    if (top >= last[0] and bottom <= last[1]) or close_edge:
                        fresh = [max(top, last[0]), min(bottom, last[1]), last[2], 0.0]
                        zones.pop()
                        code = MERGED
                    add = not (fresh[0] <= last[0] and fresh[1] >= last[1])
                if add:
                    zones.append(fresh)
                    tell(code, s, fresh)
            elif mother_bar and m1i == 1.0:
                mh, ml = (m1h, m1l) if s == 0 else (-m1l, -m1h)
                top, bottom = max(top, mh), min(bottom, ml)
            else:
                (top, bottom), at = b[2], pos - 2
            sides[s] = [armed, top, bottom, at, zones]
        for s, b in enumerate(views):
            zones = sides[s][4]
            end = close if s == 0 else -close
            if zones and m0i == 0.0:
                top, bottom = zones[-1][0], zones[-1][1]
                turned = b[1][0] > b[2][0] and b[1][0] > b[0][0] and end < b[1][1]
                if turned and bottom < b[1][0] < top:
                    tell(SCOB, s, zones[-1])
        for s, b in enumerate(views):
            end = close if s == 0 else -close
            kept, other = [], sides[1 - s][4]
            for zone in sides[s][4]:
                top, bottom, at, touched = zone
                if b[0][1] < bottom and end > top:
                    flipped = [-bottom, -top, at, 0.0]
                    other.append(flipped)
                    tell(BREAKER, 1 - s, flipped)
                elif bottom <= b[0][0] < top and not touched:
                    zone[3] = 1.0
                    tell(MITIGATED, s, zone)
                if b[0][0] >= top:
                    tell(SWEPT, s, zone)
                elif pos - at > max_age:
                    tell(EXPIRED, s, zone)
                else:
                    kept.append(zone)
            sides[s][4] = kept
        flat_state = list(mothers)
        for armed, top, bottom, at, zones in sides:
            flat_state += [armed, top, bottom, at, float(len(zones))]
            for zone in zones:
                flat_state += zone
        return flat_state, out

    return step


def script_zones(
    bars: DataFrame, seconds: float, merge_ratio: float = 0.0, mother_bar: bool = False, max_age: int = 2000, warmup: int = 2100
) -> DataFrame:
    """Life of chart-script zones: ``symbol, ts, pos, kind, event, start_pos, top, bottom``."""
    laid = lay_out(bars, seconds, warmup + 4)
    lags = {f"_{n[0]}{k}": shift(laid, n, k) for k in range(1, 5) for n in ("high", "low")}
    laid = laid.add({"_p": F.col(POS).cast("double"), **lags})
    inputs = ["_p", "close", "high", "low"] + [f"_{c}{k}" for k in range(1, 5) for c in ("h", "l")]
    rows = fold_events(laid, script_zone_step(merge_ratio, mother_bar, max_age), inputs, _ZONE_COLUMNS)
    names = F.array(*[F.lit(n) for n in SCRIPT_ZONE_EVENTS])
    return rows.select(
        "symbol",
        "ts",
        F.col(POS).alias("pos"),
        F.when(F.col("side") == 0, "supply").otherwise("demand").alias("kind"),
        F.element_at(names, F.col("code").cast("int") + 1).alias("event"),
        F.col("start_pos").cast("long").alias("start_pos"),
        "top",
        "bottom",
    )
