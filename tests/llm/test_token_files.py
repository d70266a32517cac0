from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from tapeline.llm import token_files
from tapeline.llm.catalog import tokenizer_path
from tapeline.llm.common import TokenCache
from tapeline.llm.token_files import TokenFile, TokenWriter, read_token_files, write_token_files
from tests.llm.conftest import AWKWARD


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_round_trip_and_random_access(monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, top, n) for top, n in ((256, 700), (50_000, 1500), (2**32, 90), (9, 0), (70_000, 1))]
    sink = Sized()
    writer = TokenWriter(sink)
    for i, ids in enumerate(docs):
        writer.add(None if i == 0 else i, ids.astype(np.uint32))
    writer.close()
    file = TokenFile(sink)
    flat = np.concatenate(docs)
    assert [file.token(i) for i in range(len(flat))] == flat.tolist()
    read = list(file.documents())
    assert [d for d, _, _ in read] == [None, 1, 2, 3, 4]
    assert [np.concatenate([*p, []]).astype(np.int64).tolist() for _, _, p in read] == [d.tolist() for d in docs]
    with pytest.raises(IndexError):
        file.token(len(flat))
    sink.seek(0)
    with pytest.raises(ValueError):
        TokenFile(Sized(sink.getvalue()[:-3]))


@pytest.mark.parametrize("name, leading", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_cached_ids_are_those_of_the_library(name, leading):
    path = tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    tricky = ["<|ENDOFTEXT|> a<|endoftext|>b <|startoftext|> c", "a <|b", " a b", " a", " ", " a  b", "a  b", "a \n b", "x  y", "it's  'S it'S", "\x1c a", "a\0 b c", "<|endoftext|> x", "e ́x", "ΑΣ ΑΣ.", "\t\t", "İstanbul Ünal ÀÉß, Straße_x ²³ (½) µm", "à́, ñ̃.", "don't… —x— “q”", "ABC!!! $$$ x%%% |"]
    many = [t or "" for t in AWKWARD] + tricky
    cache = TokenCache(path, leading, limit=3)
    assert cache.direct
    many += ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    got = [x for i in range(0, len(many), 7) for x in cache.encode(many[i : i + 7])]
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in many]
    plain.encode_special_tokens = True
    got = TokenCache(path, leading, special_text=True).encode(many)
    assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in many]


def test_files_hold_every_document(spark, docs_of):
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i * 3, t) for i, t in enumerate(AWKWARD)] + [(6, "repeated id"), (None, "no id"), (400, "a <|endoftext|> b")] + [(9, f"one id {i}") for i in range(40)]
    got = read_token_files(write_token_files(docs_of(rows, extra=True), path)).collect()
    want, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark, docs_of):
    assert read_token_files(write_token_files(docs_of([]), tokenizer_path("word_bpe_49k.json"))).count() == 0


def test_words_of_letters_are_learned_without_the_splitter(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    cache, plain = TokenCache(path, False), Tokenizer.from_file(path)
    text = "Plain words of LETTERS only s t re dont"
    want = plain.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("tapeline.llm.common._PARTS", {False: Unused()})
    assert cache.encode([text])[0].tolist() == want


class Unused:
    def findall(self, text):
        raise AssertionError(f"{text!r} went through the splitter")
