from __future__ import annotations

import random

import numpy as np
import pytest

from tapeline.llm import decontaminate
from tapeline.llm.common import table
from tapeline.llm.decontaminate import WordHashes, common_length, leaks, read_items, verdict
from tests.llm.conftest import AWKWARD

SF = "/root/testdata/sf0.01"
BENCH = "item_id long, text string, answered string"


def found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def plain_common(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_common_length():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)) for _ in range(2))
        assert common_length(a, b) == plain_common(a, b)


def test_copies_in_the_whole_table(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items, texts = bench.collect(), docs.select("doc_id", "text").collect()
    want = {(d["doc_id"], i["item_id"]) for i in items for d in texts if i["text"] in (d["text"] or "")}
    got = found(leaks(docs, bench))
    assert want <= got and len(got - want) <= len(want) // 10 and len(want) > 5


def test_search_against_every_window(spark, docs_of):
    """Copies at any place and paraphrases, against the check run on every window of every document."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(1500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randrange(12, 60)) + ". " + text(rng.randrange(4, 9)) + ".") for i in range(20)]
    docs = []
    for i in range(150):
        body = text(rng.randrange(0, 200)).split()
        if i % 3:
            piece = items[rng.randrange(20)][1].split()
            for _ in range(rng.randrange(0, 5) if i % 3 == 2 else 0):
                piece[rng.randrange(len(piece))] = rng.choice(words)
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = piece
        docs.append(" ".join(body).upper() if i % 5 == 0 else " ".join(body))
    hashes, read = WordHashes(), read_items(items)
    want = set()
    for d, t in enumerate(docs):
        own = hashes.of(t)
        for item in read:
            n = len(item.words)
            if np.isin(item.words, own).mean() >= 0.6 and any(verdict(item, own[s : s + n + 24]) for s in range(0, max(1, len(own)), 6)):
                want.add((d, item.item_id))
    got = found(leaks(docs_of(docs, extra=True), spark.createDataFrame([(*r, "clash") for r in items], BENCH)))
    assert len(want) > 80 and len(want - got) <= len(want) // 50 and len(got - want) <= 1


def test_paraphrases_need_the_answer():
    item = read_items([(1, "one two three four five six seven eight nine ten. The answer is forty two")])[0]
    hashes = WordHashes()
    assert verdict(item, hashes.of("one x three four y six seven z nine ten the answer is forty two"))[1]
    assert verdict(item, hashes.of("one two three four five six seven eight nine no reply of this kind")) is None
    assert verdict(item, hashes.of("one two three four five six seven eight nine ten the answer is")) is not None


@pytest.mark.parametrize("at_once", [2, 2000])
def test_awkward_rows(spark, docs_of, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item, ""), (1, item, ""), (2, None, None), (3, "", ""), (None, "x " + item, ""), (4, "too short", "")], BENCH)
    docs = docs_of([*AWKWARD, item, item, "a b c " * 50 + item], extra=True)
    got = [(r["doc_id"], r["item_id"]) for r in leaks(docs, bench).collect()]
    n = len(AWKWARD)
    assert {(n, 1), (n + 1, 1), (n + 2, 1)} <= set(got) and {d for d, _ in got} == {n, n + 1, n + 2}
    assert leaks(docs, bench.filter("false")).count() == 0 and leaks(docs_of([]), bench).count() == 0


def test_words_of_any_script():
    of = lambda t: WordHashes().of(t).tolist()
    plain = of("Alpha don t beta gamma delta epsilon zeta")
    assert of("“Alpha” don’t—beta…gamma «delta» epsilon zeta") == plain == of("alpha_don't beta-gamma, delta (epsilon) zeta.")
    assert of("Zoë naïve 東京、大阪。") == [*of("zoë"), *of("naïve"), *of("東 京 大 阪")] and len(of("हिन्दी भाषा")) == 2 and len(of("한국어 문장")) == 2
    assert len(of("ภาษาไทย")) > 4 and of("xภาษาไทย")[1:] == of("ภาษาไทย") and of("") == of("—。…") == []


def test_copies_in_scripts_without_spaces(spark, docs_of):
    rng = random.Random(3)
    signs = [chr(0x4E00 + 7 * i) for i in range(1200)]
    text = lambda n: "".join(rng.choice(signs) + ("，" if rng.random() < 0.08 else "") for _ in range(n))
    items = [(i, text(rng.randrange(24, 60)) + "。" + text(rng.randrange(4, 9)) + "。", "") for i in range(12)]
    docs, want = [], set()
    for i in range(90):
        body = text(rng.randrange(40, 400))
        if i % 3:
            k, at = rng.randrange(12), rng.randrange(len(body))
            body = body[:at] + items[k][1] + body[at:]
            want.add((i, k))
        docs.append(body)
    assert found(leaks(docs_of(docs), spark.createDataFrame(items, BENCH))) == want


def test_typographic_copies(spark, docs_of):
    item = "it's a well-known \"rule\" - don't ask why, just-in-time beats well-meant plans; that's what we've seen so far. So isn't it clear?"
    curly = item.replace("'", "’").replace(' "', " “").replace('"', "”").replace(" - ", " — ").replace("-", "‑").replace(" ", " ")
    rng = random.Random(5)
    filler = [" ".join(f"w{rng.randrange(500)}" for _ in range(150)) for _ in range(30)]
    got = found(leaks(docs_of([*filler, filler[0] + " " + curly + " " + filler[1]]), spark.createDataFrame([(1, item, "")], BENCH)))
    assert got == {(30, 1)}


def test_short_items_are_found_exactly(spark, docs_of):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=1 + i % 7)), "") for i in range(3, 40)]
    items += [(50, "What is 3 + 4? 7", ""), (51, "what is 3 4 7", ""), (52, "二加三等于五", ""), (53, "?!", ""), (54, "unheard", "")]
    bodies = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(80)]
    bodies += ["So: what is 3 + 4? (7)", "what is 3", "4 7", "答案：二加三等于五。", "二加三", "等于五", "w0 what is x 3 4 7", None, ""]
    hashes = WordHashes()
    plain = lambda t: " " + " ".join(map(str, hashes.of(t or "").tolist())) + " "
    want = sorted((d, i) for d, t in enumerate(bodies) for i, x, _ in items if plain(x).strip() and plain(x) in plain(t))
    rows = leaks(docs_of(bodies, extra=True), spark.createDataFrame(items, BENCH)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == want and {(80, 50), (80, 51), (83, 52)} <= set(want)
    assert all(r["common_words"] == r["item_words"] < 8 and r["answered"] and r["similarity"] == 1.0 for r in rows)
