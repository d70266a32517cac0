"""Session settings the operators read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS_KEY = "spark.tapeline.chunkRows"
DEFAULT_CHUNK_ROWS = 4096


def chunk_rows(spark: SparkSession) -> int:
    """Core rows per time chunk; every ordered operator is parallel over chunks of this size."""
    return int(spark.conf.get(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; fall back to a scratch folder only on a local master."""
    ctx = spark.sparkContext
    if ctx.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    if shared:
        ctx.setCheckpointDir(shared)
    elif ctx.master.startswith("local"):
        ctx.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table once below the shared checkpoint folder and read it back.

    Used for small tables (chunk summaries, bucket offsets, events) that later stages join: it cuts the lineage, keeps
    nested operators from running each other's plans again and again, and gives the planner the true size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = 8, name: str = "tapeline") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
