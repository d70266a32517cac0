from __future__ import annotations

import random

import numpy as np
import pytest

from tapeline.llm import jaccard_join
from tapeline.llm.common import table
from tapeline.llm.components import components
from tapeline.llm.jaccard_join import Shingler, join, linked, representatives, signatures, size_classes
from tests.llm.conftest import AWKWARD


def plain_sets(texts, words=3):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(ids, texts, percent=90, words=3):
    sets, root = plain_sets(texts, words), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * min(len(sets[i]), len(sets[j])) >= percent * max(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))]


@pytest.mark.parametrize("percent, share", [(90, 9), (80, 4), (85, 6)])
def test_linked_sets_share_a_signature(percent, share):
    rng = np.random.default_rng(8)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        gone, new = int(rng.integers(0, n // share + 2)), int(rng.integers(0, n // share + 2))
        a, b = np.unique(base), np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        if linked(a, b, percent) and not np.array_equal(a, b):
            tried += 1
            assert set(signatures(a, percent)) & set(signatures(b, percent))
    assert tried > 500


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(2)
    seen, shared = {}, 0
    for i in range(20_000):
        for x in signatures(np.unique(rng.integers(0, 2**63, int(rng.integers(250, 350))).astype(np.uint64))).tolist():
            shared += seen.setdefault(x, i) != i
    assert shared == 0


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_size_classes_reach_every_partner(percent):
    ends, *_ = size_classes(percent)
    at = lambda n: int(np.searchsorted(ends, n, "right")) - 1
    for b in range(1, 5000):
        a = -(-percent * b // 100)
        assert at(b) - at(a) <= 1 and (at(a) == at(b) or (ends[at(b)] - 1) * 100 >= percent * b)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 2000 + i) for i in range(300)] + [(5000, 5001), (5001, 5000), (7, 7)] + [(9000, 8999)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()))
    want = {c: 0 for c in chain} | {n: 1000 for n in (1000, *range(2000, 2300))} | {5000: 5000, 5001: 5000, 9000: 8999, 8999: 8999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(tuple, join(docs).collect())) == sorted(brute([r[0] for r in rows], [r[1] for r in rows]))


@pytest.mark.parametrize("seed, group", [(1, 256), (2, 3)])
def test_families_of_edited_copies(spark, docs_of, monkeypatch, seed, group):
    """Copies with more and fewer edits, so that links run over some copies and not over others."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(25):
            copy = list(base)
            if rng.random() < 0.4:  # shortened copies: all their shingles are in the base
                at = rng.randrange(len(copy))
                del copy[at : at + rng.randint(0, len(copy) // 7)]
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    assert sorted(map(tuple, join(docs_of(texts)).collect())) == sorted(brute(range(len(texts)), texts))


def test_awkward_rows(spark, docs_of):
    texts = AWKWARD + ["A b", "a B", "one", "ONE", "\x0b\x1c", "É a b", "é a b", None]
    got = sorted(map(tuple, join(docs_of(texts, extra=True)).collect()))
    assert got == sorted(brute(range(len(texts)), texts))
    rows = [(5, "x y z"), (5, "x y z"), (None, "x y z"), (7, "other text here"), (7, "x y z"), (None, "alone")]
    got = sorted(map(tuple, join(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (7, 1, 7), (7, 1, 5), (None, 1, None)], key=str)
    kept = representatives(docs_of([*rows, (8, ""), (8, ""), (9, None)], extra=True))
    assert sorted(((r["doc_id"], r["text"], r["path"]) for r in kept.collect()), key=str) == sorted(
        [(5, "x y z", "clash"), (7, "other text here", "clash"), (None, "alone", "clash"), (8, "", "clash"), (9, None, "clash")], key=str
    )
    assert join(docs_of([])).count() == 0 and representatives(docs_of([])).count() == 0


def test_short_texts():
    s = Shingler()
    assert [len(s.shingles(t)) for t in ("", " ", "a", "a b", "a b c", "a b c a b c")] == [0, 0, 1, 1, 1, 3]


def test_near_copies_without_id(spark, docs_of):
    """A set that only rows without id have is compared like any other, by hubs and in opened groups."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(25):
        base = rng.choices(words, k=120)
        for k in range(4):
            text = base[: 60 + 15 * k] + [f"new{i}x{k}"] + base[60 + 15 * k :] if k else base
            rows.append((i if k == 0 and i % 5 else None, " ".join(text)))
    table = docs_of(rows)
    got = sorted(((r["doc_id"], r["component_id"]) for r in join(table).collect()), key=str)
    want = sorted(((d, i // 4 if (i // 4) % 5 else None) for i, (d, _) in enumerate(rows)), key=str)
    assert got == want
    assert sorted((r["doc_id"] for r in representatives(table).collect()), key=str) == sorted((i if i % 5 else None for i in range(25)), key=str)


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    linked_pairs = 0
    for _ in range(1500):
        n = int(rng.integers(1, 900))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        gone, new = (int(rng.integers(0, n // share + 2)) for share in rng.choice([2, 9], 2))
        a, b = np.unique(base), np.unique(np.concatenate([base[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        one, other = jaccard_join.folded([jaccard_join.sketch(a), jaccard_join.sketch(b)])
        assert np.abs(one - other).sum() <= len(np.setxor1d(a, b))
        if linked(a, b, 80):
            linked_pairs += 1
            assert jaccard_join.may_link(one, len(a), other[None], np.array([len(b)]), 80)[0]
    assert linked_pairs > 300


def test_texts_with_a_common_passage_are_not_compared_by_text(spark, docs_of, monkeypatch):
    """Unrelated texts around one passage share signatures; their sketches keep their texts from being fetched."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=40)
    texts = [" ".join(rng.choices(words, k=80) + passage + rng.choices(words, k=80)) for _ in range(200)]
    asked = []
    texts_of = jaccard_join._texts_of

    def counted(docs, members, nodes, words):
        asked.append(nodes.select("node").distinct().count())
        return texts_of(docs, members, nodes, words)

    monkeypatch.setattr(jaccard_join, "_texts_of", counted)
    got = sorted(map(tuple, join(docs_of(texts), 5, 80).select("doc_id", "component_id").collect()))
    assert got == [(i, i) for i in range(200)]
    assert sum(asked) < 20


@pytest.mark.parametrize("group", [256, 4])
def test_links_beside_the_hubs(spark, docs_of, monkeypatch, group):
    """Links between members of a bucket that do not link with its hub are found, also over several groups."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(5):
        base = rng.choices(words, k=160)
        for _ in range(8):  # branches of one base that part, each with a near copy of its own
            branch = list(base)
            for at in rng.sample(range(160), rng.randint(2, 9)):
                branch[at] = rng.choice(words)
            texts.append(" ".join(branch))
            branch[rng.randrange(160)] = rng.choice(words)
            texts.append(" ".join(branch))
    got = sorted(map(tuple, join(docs_of(texts), 5, 80).collect()))
    assert got == sorted(brute(range(len(texts)), texts, 80, 5))


def test_near_pairs_of_a_large_bucket_grow_with_its_members(spark, monkeypatch):
    """All members may link: the edges that are made stay about as many as members, not as pairs of groups."""
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    made = []
    sections = jaccard_join._near_in_sections

    def counted(*args):
        edges = jaccard_join.materialize(sections(*args))
        made.append(edges.count())
        return edges

    monkeypatch.setattr(jaccard_join, "_near_in_sections", counted)
    cells = bytes([7] * 16)
    for n in (60, 480):
        made.clear()
        rows = spark.createDataFrame([(sig, i, i) for sig in (1, 2) for i in range(n) if sig == 1 or i], "sig long, node long, component long")
        shapes = spark.createDataFrame([(i, 112, cells) for i in range(n)], "node long, size long, sketch binary")
        blobs = jaccard_join._near_in_buckets(rows, shapes, 80).collect()
        assert sorted(map(tuple, blobs)) == [(i, 0) for i in range(n)]
        assert sum(made) <= 3 * n


@pytest.mark.parametrize("seed", [1, 2])
def test_blobs_against_brute_force(spark, monkeypatch, seed):
    """Blobs are what pairs of one bucket and different components connect, however many rounds they take."""
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "GROWTH", 3)
    rng = np.random.default_rng(seed)
    n, starts = 260, rng.integers(0, 14, (9, 16))
    cells = np.abs(starts[rng.integers(0, 9, n)] + rng.integers(-2, 3, (n, 16))).astype(np.uint8)
    size, component = cells.sum(axis=1).astype(int), rng.integers(0, 150, n)
    buckets = {1: range(0, 200), 2: range(100, n), 3: rng.choice(n, 30, replace=False).tolist(), 4: [3, 250]}
    near = set()
    for members in buckets.values():
        for a in members:
            may = jaccard_join.may_link(cells[a].astype(int), size[a], cells.astype(int), size, 80)
            near |= {(a, b) for b in members if may[b] and component[a] != component[b]}
    root = list(range(n))
    for _ in range(n):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame([(s, int(i), int(component[i])) for s, members in buckets.items() for i in members], "sig long, node long, component long")
    shapes = spark.createDataFrame([(i, int(size[i]), cells[i].tobytes()) for i in range(n)], "node long, size long, sketch binary")
    got = jaccard_join._near_in_buckets(rows, shapes, 80)
    want = sorted((i, root[i]) for i in {a for a, _ in near})
    assert len(set(root)) < n and len({r for _, r in want}) > 3
    assert sorted(map(tuple, got.collect())) == want
