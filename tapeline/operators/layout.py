"""Positions and time chunks: how an ordered series is spread over tasks.

A window partitioned by symbol alone puts a whole series into one task, and a hot symbol may hold a third of all
rows. Ordered operators therefore run over ``(symbol, chunk)``: every chunk holds a fixed number of consecutive core
rows plus copies of the ``lookback`` rows before it and the ``lookahead`` rows after it. Frames of known length then
never leave a chunk, and any number of them share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec
from pyspark.sql import functions as F

from tapeline.session import chunk_rows, materialize

POS, TOTAL, CHUNK, CORE, SLOT = "_pos", "_total", "_chunk", "_core", "_slot"
BUCKET_ROWS = 4096  # unique timestamps per position bucket: bounds the rows of one ranking window


def epoch_seconds(ts: Column | str) -> Column:
    """Wall-clock seconds since 1970, without any time-zone conversion."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), col.cast("timestamp_ntz"))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, fan: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` per key over an integer ``order`` column, in two levels.

    The first level sums inside ranges of ``fan`` order values, the second over the ranges, so that no window
    partition is longer than ``fan`` rows or the series length divided by ``fan``.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.floor(F.col(order) / fan))
    inner = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    tops = tops.select(*keys, "_range", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(tops, keys + ["_range"]).withColumn(out, F.col("_before") + F.col("_local")).drop(
        "_range", "_before", "_local"
    )


def fitted_width(count, width: int, rows: int = BUCKET_ROWS) -> int:
    """Width of time buckets in seconds at which no bucket holds more than about four times ``rows`` rows.

    ``count(width)`` gives the largest number of rows in a bucket. Bars of the stated cadence fit at once; denser ticks narrow
    the buckets. Rows of one second are not split: they are ordered together.
    """
    while width > 1 and (most := count(width)) > 4 * rows:
        width = max(1, min(width // 2, width * rows // most))
    return width


def with_positions(
    df: DataFrame,
    seconds: float,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    total: bool = True,
) -> DataFrame:
    """Zero-based row number ``_pos`` (and series length ``_total``) per key, without a window over the whole key.

    ``seconds`` is the usual distance of two rows. Rows are ranked inside time buckets of ``seconds * 4096``, or narrower ones
    where rows are denser than stated, and the bucket offsets come from one row per bucket.
    """
    keys = list(keys)
    tables: dict[int, DataFrame] = {}

    def largest(width: int) -> int:
        seen = Observation()  # the largest bucket is found while the counts are written
        found = df.groupBy(*keys, F.floor(epoch_seconds(ts) / width).alias("_bucket")).agg(F.count("*").alias("_n"))
        tables[width] = materialize(found.observe(seen, F.max("_n").alias("most")))
        return seen.get["most"] or 0

    width = fitted_width(largest, max(1, int(seconds * BUCKET_ROWS)))
    if width not in tables:
        largest(width)
    counts = tables[width]
    bucketed = df.withColumn("_bucket", F.floor(epoch_seconds(ts) / width))
    offsets = running_total(counts, keys, "_bucket", "_n", "_offset")
    if total:
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias(TOTAL))
        offsets = offsets.join(sizes, keys)
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie))
    ranked = bucketed.withColumn("_rank", rank)
    placed = ranked.join(offsets.drop("_n"), keys + ["_bucket"])
    return placed.withColumn(POS, F.col("_offset") + F.col("_rank") - 1).drop("_bucket", "_rank", "_offset")


@dataclass(frozen=True)
class Laid:
    """A series cut into chunks; columns may be added, rows may not."""

    df: DataFrame
    keys: tuple[str, ...]
    rows: int
    lookback: int
    lookahead: int

    def by_chunk(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(POS)

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.by_chunk().rowsBetween(first, last)

    def prefix(self, last: int = 0) -> WindowSpec:
        return self.by_chunk().rowsBetween(Window.unboundedPreceding, last)

    def suffix(self, first: int = 0) -> WindowSpec:
        return self.by_chunk().rowsBetween(first, Window.unboundedFollowing)

    @property
    def span(self) -> int:
        return self.rows + self.lookback + self.lookahead

    def on(self, df: DataFrame) -> Laid:
        return replace(self, df=df)

    def add(self, cols: dict[str, Column]) -> Laid:
        return self.on(self.df.withColumns(cols))

    def drop(self, *names: str) -> Laid:
        return self.on(self.df.drop(*names))

    def core(self, keep: Sequence[str] = ()) -> DataFrame:
        """The series again: chunk copies and layout columns removed."""
        hidden = [c for c in (POS, TOTAL, CHUNK, CORE, SLOT) if c not in keep]
        return self.df.filter(F.col(CORE)).drop(*hidden)


def lay_out(
    df: DataFrame,
    seconds: float,
    lookback: int = 0,
    lookahead: int = 0,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    rows: int | None = None,
) -> Laid:
    """Cut ``df`` into chunks of ``rows`` core rows with the stated overlap."""
    size = rows or max(chunk_rows(df.sparkSession), 4 * max(lookback, lookahead))
    placed = df if POS in df.columns else with_positions(df, seconds, keys, ts, tie)
    return spread(placed, size, lookback, lookahead, keys)


def spread(placed: DataFrame, size: int, lookback: int, lookahead: int, keys: Sequence[str]) -> Laid:
    """Assign positioned rows to chunks and copy the overlap rows."""
    placed = placed.drop(CHUNK, CORE, SLOT)
    own = F.floor(F.col(POS) / size)
    if lookback or lookahead:
        first = F.greatest(F.floor((F.col(POS) - lookahead) / size), F.lit(0))
        last = F.least(F.floor((F.col(POS) + lookback) / size), F.floor((F.col(TOTAL) - 1) / size))
        placed = placed.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    else:
        placed = placed.withColumn(CHUNK, own)
    placed = placed.withColumns(
        {CORE: F.col(CHUNK) == own, SLOT: F.col(POS) - F.greatest(F.col(CHUNK) * size - lookback, F.lit(0))}
    )
    return Laid(placed, tuple(keys), size, lookback, lookahead)
