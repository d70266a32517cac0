from __future__ import annotations

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tapeline.llm.catalog import tokenizer_path
from tapeline.llm.common import materialize, table
from tests.llm.conftest import AWKWARD, DOCS
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_repeats import brute as repeats

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    before, kept = rows(docs), {}
    state = docs
    for name, stage in pipeline.STAGES[:-1]:
        state = materialize(stage(spark, state, SF))
        assert tuple(state.columns) == pipeline.COLUMNS and state.dtypes == docs.select(*pipeline.COLUMNS).dtypes
        kept[name] = rows(state)
    assert len(kept["language"]) > 0.98 * len(before) and all(before[d] == r for d, r in kept["language"].items())
    ids = sorted(kept["language"])
    want = {c for _, _, c in components(ids, [kept["language"][i]["text"] for i in ids], 80, 5)}
    assert set(kept["near_duplicates"]) == want
    ids = sorted(want)
    told = repeats([kept["near_duplicates"][i]["text"] for i in ids])
    for i, (n, gone, _, _) in zip(ids, told):
        r = kept["repeats"][i]
        assert n - gone - 8 * 200 <= len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])
        assert gone or r["text"] == before[i]["text"]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    hit = {i for i, r in kept["repeats"].items() if any(t in r["text"] for t in items)}
    assert hit <= set(kept["repeats"]) - set(kept["benchmark"]) and len(kept["benchmark"]) >= len(kept["repeats"]) - len(hit) - 3
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    placed = pipeline.packed(spark, state, SF).collect()
    sizes: dict = {}
    for r in placed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: 1 + len(plain.encode(r["text"], add_special_tokens=False).ids) for i, r in kept["benchmark"].items()}
    assert sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "start", "length").collect())) == sorted((r["doc_id"], r["start"], r["length"]) for r in placed)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_awkward_rows(spark, docs_of, name, stage):
    item = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    texts = [*AWKWARD, item, "le " * 90, "x" * 450, "x" * 450]
    docs = docs_of([*enumerate(texts), (3, "the same row"), (None, "the same row"), (None, "about " + item)], extra=True)
    out = stage(spark, docs, SF).collect()
    if name != "packing":
        assert len(out) <= docs.count()
    if name == "benchmark":
        assert not any(item in (r["text"] or "") for r in out) and len(out) == docs.count() - 2
    if name == "near_duplicates":
        assert sum(r["text"] == "the same row" for r in out) == 1
    if name == "repeats":
        assert len(out) == docs.count() and np.sum([r["text"] == "" for r in out]) >= 3
    assert stage(spark, spark.createDataFrame([], DOCS), SF).count() == 0
