"""Bars: building, resampling, sessions and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.layout import POS, epoch_seconds, lay_out, with_positions
from tapeline.operators.scans import decayed_sum, shift
from tapeline.operators.steps import Step
from tapeline.schema import tf_minutes, tf_seconds

NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def mid_price(bid: str = "bid", ask: str = "ask") -> Column:
    return F.coalesce((F.col(bid) + F.col(ask)) / 2, F.col(bid))


def at_seconds(seconds: Column) -> Column:
    """Timestamp without zone from wall-clock seconds."""
    return F.timestamp_add("SECOND", seconds, F.expr(NTZ_EPOCH))


def floor_time(ts: Column | str, timeframe: str | int) -> Column:
    step = tf_seconds(timeframe)
    return at_seconds(F.floor(epoch_seconds(ts) / step) * step)


def tick_order(ts: str = "ts", seq: str = "seq") -> Column:
    """Time and sequence number as one number: a fixed-width value keeps the aggregation of ticks hash based."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(NTZ_EPOCH), F.col(ts).cast("timestamp_ntz"))
    return micros.cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + F.col(seq).cast("decimal(19,0)")


def ticks_to_bars(ticks: DataFrame, timeframe: str | int, price: str = "price", seq: str = "seq") -> DataFrame:
    """First, highest, lowest and last price per symbol and frame; volume is the tick count."""
    order = tick_order("ts", seq).cast("decimal(38,0)")
    return (
        ticks.groupBy("symbol", floor_time("ts", timeframe).alias("_start"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .withColumnRenamed("_start", "ts")
    )


def resample(bars: DataFrame, timeframe: str | int, limit: int | None = None) -> DataFrame:
    """Larger bars, left-closed and left-labelled, empty ones left out.

    Frames that divide a day are aligned to midnight; others start at midnight of the first bar's day, per symbol.
    """
    step = tf_seconds(timeframe)
    if 86400 % step == 0:
        keyed = bars.withColumn("_start", floor_time("ts", timeframe))
    else:
        origin = bars.groupBy("symbol").agg(epoch_seconds(F.date_trunc("day", F.min("ts"))).alias("_origin"))
        offset = F.floor((epoch_seconds("ts") - F.col("_origin")) / step) * step
        keyed = bars.join(origin, "symbol").withColumn("_start", at_seconds(F.col("_origin") + offset))
    volume = F.sum("volume") if "volume" in bars.columns else F.lit(0.0)
    out = (
        keyed.groupBy("symbol", "_start")
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            volume.alias("volume"),
        )
        .withColumnRenamed("_start", "ts")
    )
    return last_n(out, limit, step) if limit else out


def last_n(bars: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Newest ``limit`` rows per symbol."""
    placed = with_positions(bars, seconds)
    return placed.filter(F.col(POS) >= F.col("_total") - limit).drop(POS, "_total")


def heikin_ashi_step(prefix: str = "") -> Step:
    """Smoothed bars; with an empty prefix they replace the plain ones."""

    def apply(laid):
        laid = laid.add({"_hc": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4})
        fed = F.when(F.col(POS) == 0, F.col("open")).otherwise(shift(laid, "_hc") * 0.5)
        laid = laid.add({"_fed": fed})
        laid = laid.add({"_ho": decayed_sum(laid, F.col("_fed"), 0.5)})
        return laid.add(
            {
                f"{prefix}high": F.greatest("_ho", "_hc", "high"),
                f"{prefix}low": F.least("_ho", "_hc", "low"),
                f"{prefix}open": F.col("_ho"),
                f"{prefix}close": F.col("_hc"),
            }
        ).drop("_hc", "_ho", "_fed")

    return Step(apply, 58)


def heikin_ashi(bars: DataFrame, seconds: float) -> DataFrame:
    step = heikin_ashi_step()
    return step.apply(lay_out(bars, seconds, step.lookback)).core()


def bars_to_path(bars: DataFrame) -> DataFrame:
    """Four price points per bar: open, the nearer extreme for its direction, the other one, close."""
    rising = F.array("open", "high", "low", "close")
    falling = F.array("open", "low", "high", "close")
    points = F.posexplode(F.when(F.col("close") >= F.col("open"), rising).otherwise(falling)).alias("leg", "price")
    tick_id = F.concat_ws("#", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("leg"))
    return bars.select("symbol", "ts", points).withColumn("tick_id", tick_id)


def calendar_windows(bars: DataFrame, seconds: float, rows: int, others: DataFrame | None = None) -> DataFrame:
    """``window_id`` for every ``rows`` consecutive bars; rows of another frame get the window whose bounds hold them.

    ``others`` is matched by equal day and an inclusive range, so a window wider than a day is found on each of its
    days.
    """
    numbered = with_positions(bars, seconds).withColumn("window_id", F.floor(F.col(POS) / rows))
    if others is None:
        return numbered.drop(POS, "_total")
    bounds = numbered.groupBy("symbol", "window_id").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    days = F.sequence(F.to_date("_from"), F.to_date("_to"))
    spread = bounds.withColumn("_day", F.explode(days))
    joined = others.withColumn("_day", F.to_date("ts")).join(spread, ["symbol", "_day"])
    return joined.filter(F.col("ts").between(F.col("_from"), F.col("_to"))).drop("_day", "_from", "_to")


# Market sessions in the order they are tried; local opening and closing hour.
SESSIONS = (
    ("Sydney", "Australia/Sydney", 7, 16),
    ("Tokyo", "Asia/Tokyo", 9, 18),
    ("London", "Europe/London", 8, 17),
    ("New York", "America/New_York", 8, 17),
)


def trading_session(ts: Column | str) -> Column:
    """Name of the last listed session open at a UTC time, else null."""
    col = F.col(ts) if isinstance(ts, str) else ts
    name = F.lit(None).cast("string")
    for label, zone, opens, closes in SESSIONS:
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), col.cast("timestamp_ntz"))
        hour = F.hour(local)
        name = F.when((hour >= opens) & (hour < closes), F.lit(label)).otherwise(name)
    return name


def in_hours(ts: Column | str, first: int, last: int) -> Column:
    return F.hour(ts).between(first, last)


def in_minutes(ts: Column | str, first: str, last: str) -> Column:
    """Inclusive ``HH:mm`` range within a day."""
    return F.date_format(ts, "HH:mm").between(first, last)


def session_range(bars: DataFrame, start: str, count: int, timeframe: str | int) -> DataFrame:
    """Highest high and lowest low of the first ``count`` bars from a time of day, per symbol and day."""
    hours, minutes = (int(v) for v in start.split(":"))
    first = hours * 60 + minutes
    minute = F.hour("ts") * 60 + F.minute("ts")
    span = count * tf_minutes(timeframe)
    held = bars.filter((minute >= first) & (minute < first + span)).withColumn("day", F.to_date("ts"))
    return held.groupBy("symbol", "day").agg(
        F.max("high").alias("high"), F.min("low").alias("low"), (F.max("high") - F.min("low")).alias("range")
    )


def clock_offset(ticks: DataFrame, tick_ts: str = "ts", seen_ts: str = "ingest_ts") -> DataFrame:
    """Rounded hours between tick time and UTC per symbol; three when all rows were seen at a weekend."""
    gap = epoch_seconds(tick_ts) - epoch_seconds(seen_ts)
    weekday = ~F.dayofweek(seen_ts).isin(1, 7)
    hours = F.round(F.avg(F.when(weekday, gap)) / 3600).cast("int")
    return ticks.groupBy("symbol").agg(F.coalesce(hours, F.lit(3)).alias("offset_hours"))


def previous_day_levels(bars: DataFrame) -> DataFrame:
    """High and low of the previous trading day on every bar."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("_day")).agg(
        F.max("high").alias("prev_high"), F.min("low").alias("prev_low")
    )
    seconds = 86400
    placed = with_positions(daily.withColumn("_dts", F.col("_day").cast("timestamp_ntz")), seconds, ts="_dts")
    nxt = placed.select("symbol", (F.col(POS) + 1).alias(POS), "prev_high", "prev_low")
    levels = placed.select("symbol", "_day", POS).join(nxt, ["symbol", POS], "left").drop(POS)
    return bars.withColumn("_day", F.to_date("ts")).join(levels, ["symbol", "_day"]).drop("_day")
