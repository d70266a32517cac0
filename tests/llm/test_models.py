from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tapeline.llm import languages, toxicity
from tapeline.llm.common import table
from tapeline.llm.subwords import Scorer, grams_of, laid_grams, train, words_of
from tests.llm.conftest import AWKWARD

SF = "/root/testdata/sf0.01"


def apart(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_unseen_misspellings_share_the_class():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abdeglnorstu") for _ in range(6)) for _ in range(300)]
    windows = [[rng.choice(plain) for _ in range(8)] + (["wretched"] if i % 2 else []) for i in range(800)]
    model = train(windows, np.arange(800) % 2, ["0", "1"])
    odds = {w: s[0, 1] - s[0, 0] for w, s in zip(("wretchedd", "wretchd", "garden"), Scorer(model).scores([["wretchedd"], ["wretchd"], ["garden"]]))}
    assert min(odds["wretchedd"], odds["wretchd"]) > odds["garden"] + 1


def test_words_and_rows():
    assert words_of("Ärger, d'été_2 x" + "y" * 70)[:4] == ["ärger", "d", "été", "x" + "y" * 59]
    assert len(grams_of("ab")) == 1 + 3 + 2 + 1
    assert words_of("² ½ Ⅳ ① 3 _") == [] and words_of("m²x ªb") == ["m", "x", "ªb"]


def test_rows_of_many_words_at_once():
    """Scoring takes the rows of all new words together; a call for each word took most of op4's time."""
    rng = random.Random(2)
    words = ["a", "ab", "東京", "ǅx", "été", "ªb", "x" * 60, "\U0001d4b3" * 60, *("".join(rng.choice("abcdéß東") for _ in range(rng.randrange(1, 61))) for _ in range(3000))]
    flat, starts, sizes = laid_grams(words)
    each = [grams_of(w) for w in words]
    assert flat.tolist() == sum(each, []) and sizes.tolist() == list(map(len, each)) and starts.tolist() == np.cumsum([0, *sizes[:-1]]).tolist()
    assert len(laid_grams([])[0]) == 0
    model = train([[w] for w in words], np.arange(len(words)) % 2, ["0", "1"])
    worst = toxicity.WorstWindow(model, limit=50)
    odds = {w: s[0, 1] - s[0, 0] for w, s in zip(words, Scorer(model).scores([[w] for w in words]))}
    for many in ([words[:9], [], ["a", "a"]], [words[i : i + 7] for i in range(0, 3000, 7)]):
        want = [max(float(odds[w]) for w in t) + worst.bias if t else -np.inf for t in many]
        assert worst.of(many).tolist() == want


def test_ascii_words_are_those_of_the_pattern():
    text = "".join(map(chr, range(128))) + " It's X_ray 9to5 " + "Q" * 130
    assert words_of(text) == [w for w in words_of(text + " é") if w != "é"]


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents")
    model = languages.fit(docs)
    rows = languages.predict(docs, model).collect()
    out = [r for r in rows if apart(r["doc_id"]) and r["lang_pred"] != "und"]
    assert len(rows) == docs.count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == apart(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.9


def test_one_toxic_word_in_long_documents(spark, docs_of):
    """Labelled documents are read whole: one toxic word among 1,500 is learned and found in held-out documents."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abdeglnorstu") for _ in range(rng.randrange(4, 9))) for _ in range(3000)]
    rows, marks = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(1500)]
        if i % 2:
            words[rng.randrange(1500)] = rng.choice(["wretchfiend", "vilemonger"])
        rows.append((i, " ".join(words)))
        marks.append((i, i % 2))
    docs, labels = docs_of(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = [r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in out]) >= 0.95


def test_repeated_ids_are_learned_from_once(spark, docs_of):
    docs = docs_of([(3, f"calm river {i}") for i in range(300)] + [(i, "vile tree" if i % 2 else "calm tree") for i in range(4, 80)])
    labels = spark.createDataFrame([(3, 0)] + [(i, i % 2) for i in range(4, 80)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 376 and all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] > 3)


def test_held_out_labels_are_not_read(spark, docs_of):
    """Labels of held-out documents may say anything without changing a score."""
    rng = random.Random(4)
    docs = docs_of([" ".join(rng.choice(["vile" if i % 2 else "calm", "tree", "house", "river"]) for _ in range(30)) for i in range(80)])
    marks = [(i, i % 2) for i in range(80)]
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - t if flip and apart(i) else t) for i, t in marks], "doc_id long, toxic int")
        scores.append(sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, labels)).collect())))
    assert scores[0] == scores[1]


@pytest.mark.parametrize("known", [True, False])
def test_awkward_rows(spark, docs_of, known):
    docs = docs_of(AWKWARD + [None, "12 34 %%"], extra=True)
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, None), (None, 1), (5, 1), (6, 0), (7, 0), (8, 1)] if known else [], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(AWKWARD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (0, 1, len(AWKWARD), len(AWKWARD) + 1)} == {0.0}
    got = languages.predict(docs, languages.fit(docs if known else docs.filter("false"))).collect()
    assert all((r["lang_pred"], r["rejected"]) == ("und", True) for r in got if r["doc_id"] in (0, 1, len(AWKWARD), len(AWKWARD) + 1))
    assert got[0]["path"] == "clash" and (known or {r["lang_pred"] for r in got} == {"und"})
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
