from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tapeline.llm import repeats
from tapeline.llm.common import table
from tapeline.llm.repeats import merged, remove_repeats, runs
from tests.llm.conftest import AWKWARD


def brute(texts, least=200):
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + least] for d in datas for i in range(len(d) - least + 1))
    out = []
    for d in datas:
        gone = merged([(i, i + least) for i in range(len(d) - least + 1) if count[d[i : i + least]] > 1])
        kept, at = b"", 0
        for lo, hi in gone:
            kept, at = kept + d[at:lo], hi
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect())


@pytest.mark.parametrize("segment", [100, 1 << 20])
def test_runs_cover_every_window_once(monkeypatch, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rng = random.Random(1)
    for n, letters in ((0, 9), (199, 9), (200, 9), (3000, 26), (2500, 1), (2000, 2)):
        data = bytes(rng.randrange(97, 97 + letters) for _ in range(n))
        starts = [s for _, lo, size in runs(data) for a, k in zip(lo, size) for s in range(a, a + k - 199)]
        assert sorted(starts) == list(range(n - 199)) if n >= 200 else starts == []


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.select("doc_id", "text").collect()
    assert got(remove_repeats(docs)) == sorted((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))


@pytest.mark.parametrize("local", [2000, 1])
def test_shared_passages(spark, docs_of, monkeypatch, local):
    """Passages of lengths around the threshold in other surroundings, periodic texts, copies and overlaps."""
    monkeypatch.setattr(repeats, "LOCAL_GROUP", local)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [noise(n) for n in (150, 185, 199, 200, 201, 230, 400, 900)]
    texts = []
    for i in range(60):
        t = noise(rng.randrange(0, 300))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            t += p[cut if rng.random() < 0.5 else 0 : len(p) - (cut if rng.random() < 0.5 else 0)] + noise(rng.randrange(0, 80))
        texts.append(t)
    texts += ["x" * 199, "x" * 200, "y" * 201, "ab" * 400, "ab" * 99 + "abc" * 80, *AWKWARD, texts[3], passages[3], passages[7][:350] + passages[7][100:500]]
    assert got(remove_repeats(docs_of(texts, extra=True), with_text=False)) == sorted((i, *b) for i, b in enumerate(brute(texts)))


def test_repeated_ids_kept_text_and_no_rows(spark, docs_of):
    long = "é" * 30 + "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(1, long), (1, long), (2, "short"), (None, "none"), (2, "other text"), (3, "ü" + long[:250])]
    df = remove_repeats(docs_of(rows), 50)
    out = sorted(((r["doc_id"] or 0, r["n_removed"], r["kept_text"]) for r in df.collect()))
    want = [(d or 0, b[1]) for (d, _), b in zip(rows, brute([t for _, t in rows], 50))]
    assert [o[:2] for o in out] == sorted(want)
    assert {o[2] for o in out if o[0] == 2} == {"short", "other text"} and [o[2] for o in out if o[0] == 3] == ["ü"]
    assert "lang" in df.columns and remove_repeats(docs_of([])).count() == 0


def test_repeated_rows_without_id_have_bounded_spans(spark):
    """A thousand equal rows tell each span once, so that no row carries the spans of all copies."""
    from pyspark.sql import functions as F

    from tapeline.llm.repeats import remove_repeats, repeated_spans

    text = " ".join(f"word{i}" for i in range(200))
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(5)
    spans = repeated_spans(docs.select(F.lit(1).cast("long").alias("row"), "text")).collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) < len(text) / 10
    assert {(r["n_removed"], r["n_spans"]) for r in remove_repeats(docs).collect()} == {(len(text), 1)}
