"""As-of joins: the newest right row at or before each left row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.layout import epoch_seconds, fitted_width
from tapeline.session import materialize


def asof_join(
    left: DataFrame,
    right: DataFrame,
    columns: Sequence[str],
    seconds: float,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    strict: bool = False,
    rows: int = 4096,
) -> DataFrame:
    """Add ``columns`` of the newest ``right`` row at or before (``strict``: before) each left row.

    Of right rows with equal times the one with the largest ``columns``, compared in order, counts.
    Both sides are merged inside time buckets of ``rows * seconds``, or narrower ones where rows are denser, so no task holds a
    whole key. A bucket inherits the last right row of earlier buckets through one summary row per bucket.
    """
    keys = list(keys)
    both = left.select(*keys, ts).unionByName(right.select(*keys, ts))

    def largest(width: int) -> int:
        sizes = both.groupBy(*keys, F.floor(epoch_seconds(ts) / width).alias("_b")).agg(F.count("*").alias("n"))
        return sizes.agg(F.max("n")).first()[0] or 0

    width = fitted_width(largest, max(1, int(seconds * rows)), rows)
    payload = F.struct(*[F.col(c) for c in columns])
    bucket = F.floor(epoch_seconds(ts) / width)
    lefts = left.withColumns({"_bucket": bucket, "_side": F.lit(0 if strict else 1), "_pick": F.lit(None)})
    rights = right.select(
        *keys, ts, bucket.alias("_bucket"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_pick")
    )
    lefts = lefts.withColumn("_pick", F.lit(None).cast(rights.schema["_pick"].dataType)).withColumn("_left", F.lit(True))
    merged = lefts.unionByName(rights.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_bucket").orderBy(ts, "_side", "_pick").rowsBetween(Window.unboundedPreceding, 0)
    local = merged.withColumn("_seen", F.last("_pick", ignorenulls=True).over(order)).filter("_left")

    tops = rights.groupBy(*keys, "_bucket").agg(F.max_by("_pick", F.struct(ts, "_pick")).alias("_top"))
    tops = materialize(tops)
    spine = lefts.select(*keys, "_bucket").distinct().join(tops, [*keys, "_bucket"], "full")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = spine.select(*keys, "_bucket", F.last("_top", ignorenulls=True).over(earlier).alias("_carry"))
    joined = local.join(carry, [*keys, "_bucket"], "left").withColumn("_hit", F.coalesce("_seen", "_carry"))
    return joined.select(*[c for c in left.columns], *[F.col(f"_hit.{c}").alias(c) for c in columns])
