"""Dataset preparation: names, time stamps, validation, duplicates, summaries, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.schema import REQUIRED_BAR_COLUMNS

# Column names that stand for a canonical one.
ALIASES = {"time": "ts", "timestamp": "ts", "datetime": "ts", "tick_volume": "volume"}
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def canonicalize(df: DataFrame) -> DataFrame:
    """Canonical names and order: symbol (if any), ts, open, high, low, close, volume (if any), extras by name."""
    renames: dict[str, str] = {}
    for name in df.columns:
        target = ALIASES.get(name.lower(), name.lower() if name.lower() in (*REQUIRED_BAR_COLUMNS, "volume", "ts", "symbol") else name)
        if target in renames.values():
            raise ValueError(f"two columns for {target!r}")
        renames[name] = target
    missing = [c for c in ("ts", *REQUIRED_BAR_COLUMNS) if c not in renames.values()]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    named = df.withColumnsRenamed(renames)
    lead = [c for c in ("symbol", "ts", *REQUIRED_BAR_COLUMNS, "volume") if c in named.columns]
    return named.select(*lead, *sorted(c for c in named.columns if c not in lead))


def parse_timestamp(col: Column) -> Column:
    """Timestamp of a string in one of several formats; a trailing Z or offset is taken as it stands, not converted."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "")
    whole = F.regexp_replace(F.trim(col.cast("string")), r"(Z|[+-]\d{2}:\d{2})$", "")
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS]
    # all digits (with a fraction): seconds since 1970; eight digits and fewer are no time of a market
    seconds = F.when(text.rlike(r"^\d{9,}$"), F.timestamp_seconds(F.trim(col.cast("string")).try_cast("double")).cast("timestamp_ntz"))
    return F.coalesce(seconds, whole.try_cast("timestamp_ntz"), *tries)


def has_zone(col: Column) -> Column:
    return F.trim(col.cast("string")).rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.trim(col.cast("string")).rlike(":")


def normalize_ts(df: DataFrame, column: str = "ts") -> DataFrame:
    """``ts`` without zone from strings, epoch seconds or dates, and ``ts_problem`` for rows that cannot be used.

    Mixing values with and without a zone is a problem of the whole table; it is reported by ``mixed_zones``.
    """
    kind = df.schema[column].dataType.typeName()
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        parsed = F.timestamp_seconds(F.col(column)).cast("timestamp_ntz")
    elif kind == "string":
        parsed = parse_timestamp(F.col(column))
    else:
        parsed = F.col(column).cast("timestamp_ntz")
    out = df.withColumn("_ts", parsed)
    problem = F.when(F.col(column).isNull(), "missing timestamp").when(F.col("_ts").isNull(), "unreadable timestamp")
    return out.withColumn("ts_problem", problem).drop(column).withColumnRenamed("_ts", "ts")


def mixed_zones(df: DataFrame, column: str) -> DataFrame:
    """One row: whether strings with and without a zone occur together."""
    zoned = F.count_if(has_zone(F.col(column)))
    return df.agg(((zoned > 0) & (zoned < F.count(column))).alias("mixed"))


def bar_violations(check_volume: bool = False) -> Column:
    """Array of broken rules of a bar row."""
    o, h, lo, c = (F.col(n) for n in REQUIRED_BAR_COLUMNS)
    rules = [F.when(F.col(n).isNull() | F.isnan(n), f"{n} missing") for n in REQUIRED_BAR_COLUMNS]
    rules += [F.when(F.abs(F.col(n)) == float("inf"), f"{n} infinite") for n in REQUIRED_BAR_COLUMNS]
    rules += [F.when(F.col(n) <= 0, f"{n} not positive") for n in REQUIRED_BAR_COLUMNS]
    rules += [F.when(h < F.greatest(o, c, lo), "high too low"), F.when(lo > F.least(o, c, h), "low too high")]
    if check_volume:
        v = F.col("volume")
        rules += [F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), "volume invalid")]
    return F.array_compact(F.array(*rules))


def validate_bars(df: DataFrame, check_volume: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their ``violations``."""
    marked = df.withColumn("violations", bar_violations(check_volume))
    good = marked.filter(F.size("violations") == 0).drop("violations")
    return good, marked.filter(F.size("violations") > 0)


def require_valid(df: DataFrame, check_volume: bool = False) -> DataFrame:
    """The table, or ``ValueError`` when a row breaks a rule or the table is empty."""
    good, bad = validate_bars(df, check_volume)
    broken = bad.select(F.array_join("violations", ", ").alias("v")).limit(1).collect()
    if broken:
        raise ValueError(f"invalid bars: {broken[0].v}")
    if good.isEmpty():
        raise ValueError("the dataset is empty")
    return df


def duplicates(df: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def dedupe(df: DataFrame, policy: str = "reject", order: str = "seq", keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """One row per key: the first or last by ``order``; ``reject`` raises when a key occurs twice.

    An aggregate with partial results instead of a ranking window: many copies of one key do not meet in one task.
    """
    if policy == "reject":
        if not duplicates(df, keys).isEmpty():
            raise ValueError("duplicate timestamps")
        return df
    if policy not in ("first", "last"):
        raise ValueError(f"unknown policy {policy!r}")
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if policy == "first" else F.max_by
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def dataset_summary(
    df: DataFrame, timeframe: str, source: str, timezone: str = "UTC", version: str = "1", policy: str = "reject"
) -> DataFrame:
    """Period and row count per symbol with the labels of the dataset."""
    kind = "volume" if "volume" in df.columns else "none"
    return df.groupBy("symbol").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("row_count")).withColumns(
        {
            "timeframe": F.lit(timeframe), "source": F.lit(source), "timezone": F.lit(timezone), "version": F.lit(version),
            "volume_type": F.lit(kind), "duplicate_policy": F.lit(policy),
        }
    )


def content_hash(df: DataFrame, metadata: str = "") -> DataFrame:
    """One row ``content_hash``: a three-level tree over row digests, closed with column names and metadata.

    A row belongs to the leaf named by the first six digits of its own digest and to the branch named by the first
    three, so the result does not depend on row order or partitioning, and no task sees more than one leaf or branch.
    """
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}), 256)
    # equal rows are counted first, so many copies do not make a leaf long
    counted = df.select(row.alias("_d")).groupBy("_d").agg(F.count("*").alias("_c"))

    def folded(rows: DataFrame, key: Column, line: Column) -> DataFrame:
        digest = F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ""), 256)
        return rows.groupBy(key.alias("_k")).agg(digest.alias("_h"))

    leaves = folded(counted, F.substring("_d", 1, 6), F.concat_ws(":", "_d", "_c"))
    branches = folded(leaves, F.substring("_k", 1, 3), F.concat("_k", "_h"))
    whole = F.array_join(F.sort_array(F.collect_list(F.concat("_k", "_h"))), "")
    return branches.agg(F.sha2(F.concat_ws("|", F.lit(",".join(names)), F.lit(metadata), whole), 256).alias("content_hash"))


def order_violations(df: DataFrame, seq: str = "seq", rows: int = 4096, keys: Sequence[str] = ("symbol",), lead: Sequence[str] = ()) -> DataFrame:
    """Rows whose timestamp does not exceed that of the row before them in file order.

    ``seq`` is the order inside a block of a file, and the columns ``lead`` (file, start of the block) order the blocks. Rows are
    compared inside ranges of ``seq``; each range also knows the last row before it.
    """
    keys = list(keys)
    ranged = df.withColumn("_range", F.struct(*lead, F.floor(F.col(seq) / rows).alias("_step")))
    inside = Window.partitionBy(*keys, "_range").orderBy(seq)
    tops = ranged.groupBy(*keys, "_range").agg(F.max_by("ts", seq).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_range")
    carry = tops.select(*keys, "_range", F.lag("_last").over(over).alias("_before"))
    joined = ranged.withColumn("_prev", F.lag("ts").over(inside)).join(carry, [*keys, "_range"])
    previous = F.coalesce("_prev", "_before")
    return joined.filter(previous >= F.col("ts")).withColumn("previous_ts", previous).drop("_range", "_prev", "_before")


def check_expectations(df: DataFrame, rows: int | None = None, start: str | None = None, end: str | None = None) -> None:
    """Raise ``ValueError`` when row count or period differ from what is expected."""
    got = df.agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    for label, want, have in (("rows", rows, got.n), ("start", start, got.a), ("end", end, got.b)):
        if want is not None and str(have) != str(want):
            raise ValueError(f"{label}: expected {want}, found {have}")


def align(features: DataFrame, target: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Join of features and target that must match row by row."""
    keys = list(keys)
    lost = features.select(*keys).exceptAll(target.select(*keys)).limit(1).count()
    extra = target.select(*keys).exceptAll(features.select(*keys)).limit(1).count()
    if lost or extra:
        raise ValueError("features and target hold different rows")
    return features.join(target, keys)


def output_checks(df: DataFrame, features: Sequence[str], seq: str | None = None) -> DataFrame:
    """One row: infinite values, time stamps that are not unique, features that are no numbers and, with ``seq``, rows out of order."""
    infinite = sum((F.count_if(F.abs(F.col(f)) == float("inf")) for f in features[1:]), F.count_if(F.abs(F.col(features[0])) == float("inf")))
    bad = df.agg(infinite.alias("infinite_values"))
    copies = duplicates(df).agg(F.count("*").alias("duplicate_times"))
    numeric = {"byte", "short", "integer", "long", "float", "double", "decimal"}
    other = sum(df.schema[f].dataType.typeName() not in numeric for f in features)
    out = bad.join(copies, F.lit(True)).withColumn("not_numeric", F.lit(other))
    return out if seq is None else out.join(order_violations(df, seq).agg(F.count("*").alias("out_of_order")), F.lit(True))

