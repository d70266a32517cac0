"""Readers of bar, tick, dataset and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from tapeline.operators.quality import canonicalize, content_hash, dataset_summary, dedupe, mixed_zones, normalize_ts, order_violations, require_valid
from tapeline.schema import LOG


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, so that a bad value is found by a rule and not lost by a cast."""
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=True)


_PLACE = ("_file", "_block", "_seq")  # order of lines: by file, by block of it, by row; a block is read in order by one task


def _placed(df: DataFrame) -> DataFrame:
    """The rows of a file source with their place, which does not depend on how files are dealt to tasks."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"))


def _plain(name: str) -> str:
    return name.replace("﻿", "").strip().strip("<>").lower()


def _numbers(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.col(n).try_cast("double") for n in names if n in df.columns})


def _timed(df: DataFrame) -> DataFrame:
    """``ts`` read from text; times that cannot be read, and times with and without a zone in one table, raise ``ValueError``."""
    if df.schema["ts"].dataType.typeName() == "string" and mixed_zones(df, "ts").first().mixed:
        raise ValueError("times with and without a zone")
    timed = normalize_ts(df)
    broken = timed.filter(F.col("ts_problem").isNotNull()).select("ts_problem").limit(1).collect()
    if broken:
        raise ValueError(broken[0].ts_problem)
    return timed.drop("ts_problem")


def _all_timed(df: DataFrame) -> DataFrame:
    """The table, or ``ValueError`` when a row has no time."""
    if not df.filter(F.col("ts").isNull()).isEmpty():
        raise ValueError("unreadable timestamp")
    return df


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """``timestamp,open,high,low,close[,volume]``; bad prices and duplicate times raise ``ValueError``."""
    raw = _csv(spark, path)
    named = raw.toDF(*[_plain(c) for c in raw.columns])
    bars = canonicalize(_numbers(named, ("open", "high", "low", "close", "volume")).withColumn("symbol", F.lit(symbol)))
    return dedupe(require_valid(_timed(bars)), "reject")


def _terminal_time(date: Column, time: Column) -> Column:
    """Dates with dots and times with an optional fraction, taken as UTC."""
    text = F.concat_ws(" ", F.replace(date, F.lit("."), F.lit("-")), time)
    return text.try_cast("timestamp_ntz")


def read_terminal_bars(spark: SparkSession, path: str, symbol: str, newest: int | None = None) -> DataFrame:
    """Tab-separated terminal export ``<DATE> <TIME> <OPEN> <HIGH> <LOW> <CLOSE>`` with ``<TICKVOL>`` or ``<VOL>``.

    Every row is checked; ``newest`` then keeps the last rows by time.
    """
    raw = _csv(spark, path, "\t")
    named = raw.toDF(*[_plain(c) for c in raw.columns])
    volume = "tickvol" if "tickvol" in named.columns else "vol"
    cols = [F.col(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close")]
    bars = named.select(
        F.lit(symbol).alias("symbol"), _terminal_time(F.col("date"), F.col("time")).alias("ts"), *cols,
        (F.col(volume).try_cast("double") if volume in named.columns else F.lit(0.0)).alias("volume"),
    )
    checked = dedupe(require_valid(_all_timed(bars)), "reject")
    return checked.orderBy(F.desc("ts")).limit(newest) if newest else checked


def read_terminal_ticks(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Tab-separated ``<DATE> <TIME> <BID> <ASK>``; rows without bid or ask are skipped. Lazy."""
    raw = _csv(spark, path, "\t")
    named = raw.toDF(*[_plain(c) for c in raw.columns])
    ticks = named.select(
        F.lit(symbol).alias("symbol"), _terminal_time(F.col("date"), F.col("time")).alias("ts"),
        F.col("bid").try_cast("double").alias("bid"), F.col("ask").try_cast("double").alias("ask"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return ticks.filter(F.col("bid").isNotNull() & F.col("ask").isNotNull())


def read_ticks_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """``timestamp``, ``bid`` or ``price``, optional ``ask``; duplicate times raise ``ValueError``."""
    raw = _csv(spark, path)
    named = raw.toDF(*[_plain(c) for c in raw.columns])
    bid = "bid" if "bid" in named.columns else "price"
    ask = F.col("ask").try_cast("double") if "ask" in named.columns else F.lit(None).cast("double")
    ticks = _timed(named.withColumnRenamed("timestamp", "ts")).select(
        F.lit(symbol).alias("symbol"), "ts", F.col(bid).try_cast("double").alias("bid"), ask.alias("ask"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return dedupe(ticks, "reject")


def read_dataset_csv(spark: SparkSession, path: str, symbol: str, expected_rows: int | None = None) -> DataFrame:
    """Typed dataset with a ``datetime`` column; Spark splits the file, no chunk size is needed.

    Prices, volumes, order of time and the expected row count are checked.
    """
    raw = _placed(_csv(spark, path))
    numbered = raw.toDF(*[_plain(c) for c in raw.columns]).withColumn("symbol", F.lit(symbol))
    bars = _timed(canonicalize(_numbers(numbered, ("open", "high", "low", "close", "volume"))))
    bars = dedupe(require_valid(bars, check_volume="volume" in bars.columns), "reject")
    if not order_violations(bars, "_seq", lead=_PLACE[:2]).isEmpty():
        raise ValueError("times do not increase")
    bars = bars.drop(*_PLACE)
    if expected_rows is not None:
        found = bars.count()
        if found != expected_rows:
            raise ValueError(f"expected {expected_rows} rows, found {found}")
    return bars


def load_dataset(
    spark: SparkSession, path: str, symbol: str, timeframe: str, policy: str = "reject", version: str = "1", source: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prepared bars and their one-row-per-symbol summary with the content hash."""
    raw = _placed(_csv(spark, path))
    raw = raw.withColumn("_seq", F.struct(*_PLACE)).drop(*_PLACE[:2])
    named = raw.toDF(*[_plain(c) for c in raw.columns])
    bars = canonicalize(_numbers(named, ("open", "high", "low", "close", "volume", "tick_volume")).withColumn("symbol", F.lit(symbol)))
    bars = require_valid(_timed(bars))
    bars = dedupe(bars, policy, order="_seq").drop("_seq")
    summary = dataset_summary(bars, timeframe, source or path, version=version, policy=policy)
    return bars, summary.join(content_hash(bars, f"{symbol}|{timeframe}|{version}"), F.lit(True))


_CORRUPT = "_corrupt"


def read_log(spark: SparkSession, path: str, newest: int | None = None, stream: bool = False) -> DataFrame:
    """JSON-lines log or memory events; unreadable lines are skipped. ``newest`` keeps the last rows by time."""
    schema = StructType(
        [*LOG.fields, StructField("metadata", MapType(StringType(), StringType())), StructField(_CORRUPT, StringType())]
    )
    reader = (spark.readStream if stream else spark.read).schema(schema).option("mode", "PERMISSIVE")
    rows = reader.option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    good = rows.filter(F.col(_CORRUPT).isNull() & F.coalesce("timestamp", "level", "event", "message").isNotNull()).drop(_CORRUPT)
    return good.orderBy(F.desc("timestamp")).limit(newest) if newest else good


def read_state_map(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """Rows of a persisted ``id -> record`` JSON document, with the id as ``id``."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", MapType(StringType(), record))
    return text.select(F.explode(parsed).alias("id", "_r")).select("id", "_r.*")
