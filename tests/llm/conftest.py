from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from a list of texts, or of (doc_id, text) pairs, spread over several partitions."""

    def make(texts, extra=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            clash = ("start", "score", "ids", "group", "key", "n", "rank", "kept", "component_id", "sequence_id", "title", "path")
            df = df.select("*", *[F.lit("clash").alias(c) for c in clash])
        return df

    return make


AWKWARD = ["", None, "a", "the same row", "the same row", " ".join(f"word{i % 977}" for i in range(30_000)), "Zoë\tsaid\n\nno.  Twice!", " lead", "trail ", "ǅ 東京 ́x"]
