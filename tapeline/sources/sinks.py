"""Writers: fixed-format CSV, manifests, append-only registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.quality import content_hash


def csv_columns(df: DataFrame) -> DataFrame:
    """Floating-point columns as text with ten decimals; null and nan become empty."""
    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            text = F.format_string("%.10f", F.round(c, 10))
            c = F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(text)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    csv_columns(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def manifest(spark: SparkSession, fields: dict[str, object], artifacts: dict[str, DataFrame]) -> DataFrame:
    """One row ``manifest``: JSON with sorted keys, holding the given fields and one content hash per artifact."""
    row = spark.range(1).select(F.lit(None).cast("string").alias("_"))
    hashes = {}
    for name, df in artifacts.items():
        hashes[name] = f"_hash_{name}"
        row = row.join(content_hash(df, name).withColumnRenamed("content_hash", f"_hash_{name}"), F.lit(True))
    entries = {k: F.lit(v) for k, v in fields.items()}
    entries["artifacts"] = F.struct(*[F.col(c).alias(n) for n, c in sorted(hashes.items())])
    body = F.struct(*[entries[k].alias(k) for k in sorted(entries)])
    return row.select(F.to_json(body).alias("manifest"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)


def append_table(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Append to a parquet registry: experiments, memory events, models, best sweep results."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def memory_event(spark: SparkSession, event: str, message: str, metadata: dict[str, str], timestamp: str) -> DataFrame:
    pairs = [x for k, v in sorted(metadata.items()) for x in (F.lit(k), F.lit(str(v)))]
    meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return spark.range(1).select(
        F.lit(timestamp).alias("timestamp"), F.lit(event).alias("event"), F.lit(message).alias("message"), meta.alias("metadata")
    )


def model_record(
    spark: SparkSession, name: str, target: str, horizon: int, version: str, dataset_hash: str, train_period: tuple[str, str], path: str,
    status: str = "CANDIDATE",
) -> DataFrame:
    """Registry row of a trained model."""
    values = {
        "name": name, "target": target, "horizon": horizon, "version": version, "dataset_hash": dataset_hash, "train_start": train_period[0],
        "train_end": train_period[1], "path": path, "status": status,
    }
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
