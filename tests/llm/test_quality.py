from __future__ import annotations

import math
import re
from collections import Counter

import pytest
import xxhash

from tapeline.llm import quality
from tapeline.llm.common import table
from tests.llm.conftest import AWKWARD

SF = "/root/testdata/sf0.01"
U64 = 1 << 64


def signed(x):
    return x - U64 if x >= 1 << 63 else x


def chained(*words):
    """Spark's xxhash64 over several columns: the hash of one is the seed of the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed)


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [chained(w) % quality.BUCKETS for w in words] + [chained(*p) % quality.BUCKETS for p in zip(words, words[1:])]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table_against_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect()}
    assert {d: tuple(r[c] for c in COUNTS) for d, r in got.items()} == {d: brute(t) for d, t in texts.items()}
    corpus, target = Counter(range(quality.BUCKETS)), Counter(range(quality.BUCKETS))
    for d, t in texts.items():
        found = grams(t)
        corpus.update(found)
        if marks.get(d) == 1:
            target.update(found)
    shift = math.log(corpus.total()) - math.log(target.total())
    for d, t in list(texts.items())[::9]:
        found = grams(t)
        want = sum(math.log(target[b] / corpus[b]) + shift for b in found) / len(found)
        assert got[d]["score"] == pytest.approx(want, abs=1e-5)
    kept = [r["kept"] for r in got.values() if not r["base_failed"] and marks.get(r["doc_id"]) == 1]
    poor = [r["kept"] for r in got.values() if marks.get(r["doc_id"]) == 0]
    assert sum(kept) / len(kept) > 0.97 and sum(poor) / len(poor) < 0.2
    assert not any(r["kept"] for r in got.values() if r["base_failed"])


@pytest.mark.parametrize("known", [True, False])
def test_awkward_rows(spark, docs_of, known):
    texts = AWKWARD + ["a b c a b c", "x\n\nx\n \nx\n", "\x0b\x1c\xa0 #$|", "a a a a", "a b c d a b c"]
    labels = spark.createDataFrame([(2, 1), (5, 1), (5, 0), (6, None), (None, 1)] if known else [], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.assess(docs_of(texts, extra=True), labels).collect()}
    assert {d: tuple(r[c] for c in COUNTS) for d, r in rows.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert all(math.isfinite(r["score"]) and r["kept"] is not None for r in rows.values())
    assert quality.assess(docs_of([]), labels).count() == 0


def test_every_trusted_document_counts(spark):
    """Where all documents are trusted, target and corpus are the same, however many there are; rows without id count as untrusted."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('style', id % 700, ' word', id % 11) AS text")
    assert quality.ratios(docs, docs) == pytest.approx([0.0] * quality.BUCKETS, abs=1e-12)
    more = docs.unionByName(spark.createDataFrame([(None, "style1 word1")] * 3, "doc_id long, text string"))
    table = quality.ratios(more, more)
    corpus, target = Counter(range(quality.BUCKETS)), Counter(range(quality.BUCKETS))
    for i in range(60_000):
        target.update(grams(f"style{i % 700} word{i % 11}"))
    corpus.update(target)
    corpus.subtract(range(quality.BUCKETS))
    for _ in range(3):
        corpus.update(grams("style1 word1"))
    shift = math.log(corpus.total()) - math.log(target.total())
    b = chained("style1") % quality.BUCKETS
    assert table[b] == pytest.approx(math.log(target[b] / corpus[b]) + shift, abs=1e-9)
