"""Alignment against a plain reading of the rule: byte ranges of whole-text tokens, all overlapping pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow.dataset as ds
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeline.llm import alignment
from tapeline.llm.alignment import PieceCache, align_documents
from tapeline.llm.catalog import tokenizer_path
from tests.llm.conftest import AWKWARD

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = ["two  spaces", " ", "  ", "   end  ", "tab\tand\nline\n", "it's <|endoftext|> </s> <s> <unk> <0x41> x", "a▁b", "▁", "naïve ﬁne ½ é 　x", "null\0byte", "東京 は 大きい 🙂🙂", "x" * 300, "aaa bbb " * 50, "1234 5.67,8", " nb ", "The end."]


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def reference(rows):
    plain, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    plain.encode_special_tokens = True
    letters = {c: b for b, c in alignment.byte_letters().items()}
    name = {i: t for t, i in plain.get_vocab().items()}
    found = []
    for doc_id, text in rows:
        want = b" " + (text or "").encode()
        a = [(i, bytes(letters[c] for c in name[i])) for i in plain.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text or "") for p in [model.id_to_piece(i)]]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            found.append((doc_id, 0, 0, [], []))
            continue
        a, b = ranges(a), ranges(b)
        links, k = [], 0
        for i, lo, hi in a:
            while b[k][2] <= lo:
                k += 1
            for j, at, end in b[k:]:
                if at >= hi:
                    break
                links.append((i, j))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        cells = {e: ([], []) for e in ends}
        for side, tokens in ((0, a), (1, b)):
            at = 0
            for i, _, e in tokens:
                while ends[at] < e:
                    at += 1
                cells[ends[at]][side].append(str(i))
        groups = ["|".join(",".join(side) for side in cells[e]) for e in ends]
        found.append((doc_id, len(a), len(b), groups, links))
    count = Counter(p for *_, links in found for p in set(links))
    best: dict = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def given():
    t = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_documents_both_ways(spark, docs_of, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED_PAIRS", 50)
    rows = [(i, t) for i, t in enumerate(AWKWARD + ODD)] + [(3, "the same row"), (3, "the same row"), (None, "no id"), (None, None)] + [(1000 + i, t) for i, t in given()[:120]]
    want = sorted(reference(rows), key=str)
    for most in (10**9, 0):
        got = align_documents(docs_of(rows, extra=True), A, B, broadcast_pairs=most)
        assert {"lang", "start", "score", "rank"} <= set(got.columns)
        assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == want


def test_written_groups_are_the_digested_ones(docs_of):
    rows = align_documents(docs_of(["an unbelievable thing", "", None, "a▁b"]), A, B, with_groups=True).collect()
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")
    assert sum(r.n_a > 0 for r in rows) == 1


def test_no_documents(docs_of):
    assert align_documents(docs_of([]), A, B).count() == 0
    assert [tuple(r)[1:5] for r in align_documents(docs_of([None, ""]), A, B).select(COLUMNS).collect()] == [(0, 0, 0, 0)] * 2


def test_cached_pieces_are_those_of_the_model():
    model, rng = sentencepiece.SentencePieceProcessor(model_file=B), random.Random(5)
    many = [t or "" for t in AWKWARD] + ODD + ["".join(rng.choice("ab  \n▁é's.") for _ in range(rng.randrange(30))) for _ in range(3000)]
    cache = PieceCache(B, limit=40)
    assert cache.cuttable
    got = [x for i in range(0, len(many), 50) for x in cache.encode(many[i : i + 50])]
    assert [g.tolist() for g in got] == [model.encode(t) for t in many]


def test_windows_are_forgotten_without_loss(docs_of):
    pair = alignment.Aligner(A, B, windows=5)
    many = [t for _, t in given()[:40] if t]
    assert list(pair.documents(many)) == list(alignment.Aligner(A, B).documents(many)) and len(pair.known) < 10_000
