"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import jaccard_join, languages, quality, toxicity
from tapeline.llm.alignment import align_documents
from tapeline.llm.common import held_out, table
from tapeline.llm.decontaminate import leaks
from tapeline.llm.html_text import extract
from tapeline.llm.packing import pack
from tapeline.llm.repeats import remove_repeats
from tapeline.llm.substrings import remove_sequences
from tapeline.llm.token_files import read_token_files, write_token_files
from tapeline.llm.warc import read_archives, write_archives
from tapeline.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package is found on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, tokenizer_path("word_bpe_49k.json"), leading_space=False))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), leading_space=True, with_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = languages.predict(docs.select("doc_id", "text", held_out().alias("held_out")), languages.fit(docs))
    return judged.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), with_words=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES["op1_token_files"] = op1_token_files
QUERIES["op2_packing"] = op2_packing
QUERIES["op3_warc"] = op3_warc
QUERIES["op4_toxicity"] = op4_toxicity
QUERIES["op5_languages"] = op5_languages
QUERIES["op8_quality"] = op8_quality
QUERIES["op9_html_text"] = op9_html_text
QUERIES["op10_jaccard_join"] = op10_jaccard_join
QUERIES["op6_repeats"] = op6_repeats
QUERIES["op7_decontamination"] = op7_decontamination
QUERIES["op11_substrings"] = op11_substrings
QUERIES["op12_alignment"] = op12_alignment
QUERIES["op13_whitening"] = op13_whitening
