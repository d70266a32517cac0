from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tapeline.llm import packing
from tapeline.llm.catalog import tokenizer_path
from tapeline.llm.packing import best_pattern, column_generation, pack, solve
from tests.llm.conftest import AWKWARD


def test_knapsack_against_every_multiset():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(2, 12), 4, replace=False))
        prices, room = rng.random(4), 13
        best = max(sum(c * p for c, p in zip(t, prices)) for t in itertools.product(*[range(room // s + 1) for s in sizes]) if sum(c * s for c, s in zip(t, sizes)) <= room)
        value, counts = best_pattern(prices, sizes, room)
        assert value == pytest.approx(best) and counts @ prices == pytest.approx(best) and counts @ sizes <= room


def test_linear_program_reaches_a_known_optimum():
    # lengths 3, 4, 5 of 9: 45 threes with 45 fours and fives fill without waste
    sizes, demand = np.array([3, 4, 5]), np.array([30.0, 60.0, 60.0])
    patterns, amounts = column_generation(sizes, demand, 9)
    assert np.allclose(amounts @ patterns, demand) and (patterns @ sizes <= 9).all()
    assert amounts.sum() == pytest.approx(70, rel=2e-3)


@pytest.mark.parametrize("n", [0, 1, 7, 400, 20_000])
def test_plan_covers_every_piece_once(n):
    rng = np.random.default_rng(n)
    kinds = np.minimum(rng.lognormal(3.6, 1, n).astype(int) + 1, 256)
    values, counts = np.unique(kinds, return_counts=True)
    plan = solve(dict(zip(values.tolist(), counts.tolist())), 2048, 8)
    fill, seen = np.zeros(max(plan.sequences, 1), int), set()
    for kind, count in zip(values.tolist(), counts.tolist()):
        sequence, order = plan.locate(kind, np.arange(count))
        np.add.at(fill, sequence, 8 * kind)
        seen |= set(zip(sequence.tolist(), order.tolist()))
    assert len(seen) == n and fill.max(initial=0) <= 2048
    if n >= 400:
        assert fill.sum() / (2048 * plan.sequences) > 0.97


def test_pieces_of_whole_documents(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 8)
    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, "the same row"), (None, "no id"), (40, "a <|endoftext|> b")] + [(50 + i, "copy " * 30) for i in range(60)]
    got = pack(docs_of(rows, extra=True).drop("sequence_id"), path).collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"} <= set(got[0].asDict())
    want = []
    for doc_id, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    whole: dict = {}
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        if r["start"] == 0:
            whole.setdefault(r["doc_id"], []).append(ids)
        else:
            at = [i for i, w in enumerate(whole[r["doc_id"]]) if len(w) == r["start"]][0]
            whole[r["doc_id"]][at] = np.concatenate([whole[r["doc_id"]][at], ids])
    assert sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, xs in whole.items() for x in xs), key=str) == sorted(want, key=str)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_no_documents(spark, docs_of):
    assert pack(docs_of([]), tokenizer_path("byte_bpe_50k.json")).count() == 0
