"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each result
is written as Parquet in the shared folder and read again as the next stage's input. Repeated rows and missing ids are told
apart by id and text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import decontaminate, jaccard_join, languages
from tapeline.llm.catalog import tokenizer_path
from tapeline.llm.common import materialize, table
from tapeline.llm.packing import pack
from tapeline.llm.repeats import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; what it rejects goes."""
    judged = languages.predict(docs.select(*COLUMNS), languages.fit(docs))
    return judged.filter(~F.col("rejected")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of near duplicates: shingles of five words, similarity of 0.8."""
    return jaccard_join.representatives(docs.select(*COLUMNS), words=5, percent=80).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere; n_chars follows the text."""
    cut = remove_repeats(docs.select(*COLUMNS)).withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    found = decontaminate.leaks(keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(materialize(found.select(F.col("doc_id").alias("_row")).distinct()), "_row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences."""
    placed = pack(docs, tokenizer_path("byte_bpe_50k.json"), leading_space=True, with_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", recognised_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL cannot state the stages; tests/llm/test_pipeline.py checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
