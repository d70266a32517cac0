"""Readers and writers: a given table goes out to files in the shared folder and comes back through the reader."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tapeline.plans.catalog.common import DAILY_SQL, HOURLY_SQL, daily, hourly, register, table
from tapeline.session import ensure_checkpoint_dir
from tapeline.sources import files, sinks

_PRICES = ("open", "high", "low", "close")


def scratch(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/exports/{uuid.uuid4().hex}"


def _through_files(rows: DataFrame, out: DataFrame, read, sep: str = ",") -> DataFrame:
    """Write ``out`` (with symbol) as a folder of CSV files per symbol, in order of time from file to file, and read every folder.

    One job writes all symbols in ranges of time, so a symbol with most of the rows has many files.
    """
    folder = scratch(rows.sparkSession)
    symbols = sorted(r.symbol for r in rows.select("symbol").distinct().collect())  # few by nature: the readers take one at a time
    ranged = out.repartitionByRange("symbol", "_at").withColumn("_part", F.array_position(F.array(*map(F.lit, symbols)), F.col("symbol")))
    lines = ranged.sortWithinPartitions("_part", "_at").drop("symbol", "_at")
    lines.write.partitionBy("_part").option("header", True).option("sep", sep).option("emptyValue", "").csv(folder)
    return reduce(DataFrame.unionByName, [read(f"{folder}/_part={i}", symbol) for i, symbol in enumerate(symbols, 1)])


def _clock(pattern: str):
    return F.date_format("ts", pattern)


def _bars_csv(s, d):
    """Times as epoch seconds, as plain text in two formats."""
    bars = hourly(s, d)
    kind = F.hour("ts") % 3
    text = F.when(kind == 0, F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).when(kind == 1, _clock("yyyy-MM-dd HH:mm:ss")).otherwise(_clock("yyyy.MM.dd HH:mm"))
    out = sinks.csv_columns(bars).select("symbol", F.col("ts").alias("_at"), text.alias("timestamp"), *_PRICES, "volume")
    back = _through_files(bars, out, lambda path, symbol: files.read_bars_csv(s, path, symbol))
    return back.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in (*_PRICES, "volume")])


_BARS_OUT = "symbol, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in (*_PRICES, "volume"))
register("source_bars_csv", _bars_csv, f"WITH {HOURLY_SQL} SELECT {_BARS_OUT} FROM b")


def _terminal_bars(s, d):
    bars = daily(s, d)
    out = bars.select(
        "symbol", F.col("ts").alias("_at"), _clock("yyyy.MM.dd").alias("<DATE>"), _clock("HH:mm:ss").alias("<TIME>"),
        *[F.col(c).alias(f"<{c.upper()}>") for c in _PRICES], F.col("volume").alias("<TICKVOL>"),
    )
    back = _through_files(bars, out, lambda path, symbol: files.read_terminal_bars(s, path, symbol, newest=100), "\t")
    return back.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in (*_PRICES, "volume")])


register("source_terminal_bars", _terminal_bars, f"WITH {DAILY_SQL} SELECT {_BARS_OUT} FROM b WHERE pos >= total - 100")


def _terminal_ticks(s, d):
    """Every tenth tick has no ask and is skipped."""
    events = table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    out = events.select(
        "symbol", F.struct("ts", "event_id").alias("_at"), _clock("yyyy.MM.dd").alias("<DATE>"), _clock("HH:mm:ss").alias("<TIME>"),
        F.col("value").alias("<BID>"), F.when(F.col("event_id") % 10 > 0, F.col("value") + 0.5).alias("<ASK>"),
    )
    back = _through_files(events, out, lambda path, symbol: files.read_terminal_ticks(s, path, symbol), "\t")
    return back.groupBy("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count("*").alias("ticks"), F.round(F.sum("bid"), 4).alias("bids"), F.round(F.sum("ask"), 4).alias("asks")
    )


register(
    "source_terminal_ticks",
    _terminal_ticks,
    """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, count(*) AS ticks, round(sum(value), 4) AS bids, round(sum(value + 0.5), 4) AS asks
    FROM events WHERE event_id % 10 > 0 GROUP BY 1, 2""",
)


def _ticks_csv(s, d):
    bars = hourly(s, d)
    out = bars.select("symbol", F.col("ts").alias("_at"), _clock("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("close").alias("price"))
    back = _through_files(bars, out, lambda path, symbol: files.read_ticks_csv(s, path, symbol))
    return back.select("symbol", "ts", F.round("bid", 6).alias("bid"), F.col("ask").isNull().alias("no_ask"))


register("source_ticks_csv", _ticks_csv, f"WITH {HOURLY_SQL} SELECT symbol, ts, round(close, 6) AS bid, true AS no_ask FROM b")


def _dataset_csv(s, d):
    bars = daily(s, d)
    out = bars.select("symbol", F.col("ts").alias("_at"), _clock("yyyy-MM-dd HH:mm:ss").alias("datetime"), *_PRICES, "volume")
    back = _through_files(bars, out, lambda path, symbol: files.read_dataset_csv(s, path, symbol))
    return back.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in (*_PRICES, "volume")])


register("source_dataset_csv", _dataset_csv, f"WITH {DAILY_SQL} SELECT {_BARS_OUT} FROM b")


def _loaded(s, d):
    """Each bar twice; the later line of the file counts. The summary describes what is left."""
    bars = daily(s, d)
    twice = bars.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = twice.select(
        "symbol", F.struct("_copy", "ts").alias("_at"), _clock("yyyy-MM-dd").alias("time"), "open", "high", "low", "close", (F.col("volume") + F.col("_copy")).alias("tick_volume")
    )
    summaries = []

    def read(path, symbol):
        rows, summary = files.load_dataset(s, path, symbol, "1d", policy="last")
        summaries.append(summary)
        return rows

    rows = _through_files(bars, out, read)
    about = summaries[0]
    for more in summaries[1:]:
        about = about.unionByName(more)
    told = about.select("symbol", "row_count", F.length("content_hash").alias("hash_length"))
    return rows.join(told, "symbol").select("symbol", "ts", F.round("close", 6).alias("close"), "volume", "row_count", "hash_length")


register(
    "source_load_dataset",
    _loaded,
    f"WITH {DAILY_SQL} SELECT symbol, ts, round(close, 6) AS close, volume + 1 AS volume, total AS row_count, 64 AS hash_length FROM b",
)


def _log(s, d):
    """Events as JSON lines with a broken line beside each hundredth."""
    events = table(s, d, "events")
    folder = scratch(s)
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit("INFO").alias("level"), F.col("event_type").alias("event"),
        F.col("event_id").cast("string").alias("message"), F.create_map(F.lit("value"), F.col("value").cast("string")).alias("metadata"),
    ))
    events.select(F.when(F.col("event_id") % 100 == 0, F.concat(line, F.lit("\n{\"timestamp\": "))).otherwise(line)).write.text(folder)
    rows = files.read_log(s, folder)
    return rows.groupBy("level", "event").agg(
        F.count("*").alias("lines"), F.min("timestamp").alias("first"), F.round(F.sum(F.col("metadata")["value"].cast("double")), 4).alias("total")
    )


register(
    "source_log",
    _log,
    """SELECT 'INFO' AS level, event_type AS event, count(*) AS lines, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, round(sum(value), 4) AS total
    FROM events GROUP BY event_type""",
)

_STATE = StructType([StructField("name", StringType()), StructField("customers", LongType()), StructField("balance", DoubleType())])


def _state_maps(s, d):
    """One state document per nation, keyed by market segment."""
    folder = scratch(s)
    sums = table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    record = F.struct(F.concat(F.lit("n"), "c_nationkey").alias("name"), "customers", "balance")
    documents = sums.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", record)))).alias("value"))
    documents.select("value", F.col("c_nationkey").alias("n")).write.partitionBy("n").text(folder)
    return files.read_state_map(s, f"{folder}/*", _STATE).select("id", "name", "customers", F.round("balance", 2).alias("balance"))


register(
    "source_state_maps",
    _state_maps,
    """SELECT c_mktsegment AS id, 'n' || c_nationkey AS name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey, c_mktsegment""",
)


def _registry(s, d):
    """Two runs are appended to an experiment store that is split by symbol; the best record of each symbol is read back."""
    folder = scratch(s)
    for run, field in ((1, "high"), (2, "close")):
        sums = daily(s, d).groupBy("symbol").agg(F.max(field).alias("score"), F.count("*").alias("bars"))
        sinks.append_table(sums.withColumn("run", F.lit(run)), folder, "symbol")
    rows = sinks.read_table(s, folder)
    best = rows.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.max_by("run", F.struct("score", -F.col("run"))).alias("run"), F.max("score").alias("score"), F.count("*").alias("records"))
    return best.select("symbol", "run", F.round("score", 4).alias("score"), "records")


register(
    "sink_registry",
    _registry,
    f"WITH {DAILY_SQL} SELECT symbol, CASE WHEN max(high) >= max(close) THEN 1 ELSE 2 END AS run, round(max(high), 4) AS score, 2::BIGINT AS records FROM b GROUP BY symbol",
)
