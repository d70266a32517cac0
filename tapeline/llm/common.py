"""Helpers shared by the corpus operators: tables, the shared folder, Arrow batches and cached tokenization."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.session import ensure_checkpoint_dir, materialize

__all__ = ["TokenCache", "batches", "byte_letters", "held_out", "materialize", "rows_of", "shared_folder", "table", "text_column", "texts", "token_cache"]

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Letters, digits, ASCII punctuation without the apostrophe, and a line feed between two of them: every splitter of the public
#: vocabularies cuts between these and nowhere inside (single digits where white space is dropped).
_WORD = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
_MARKS = r"[!-&(-/:-@\[-`{-~]+"
_PARTS = {True: re.compile(rf" ?{_WORD}| ?[0-9]+| ?{_MARKS}|\n(?=\S)"), False: re.compile(rf"{_WORD}|[0-9]|{_MARKS}")}
_PROBES = (" word", "word", "Ünal", "x", "...", " qzxv", "!?", " .", "7")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}/{uuid.uuid4().hex}"


def text_column(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the documents that no model may learn from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def rows_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    """A record batch from columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def batches(source: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows, so that a batch of long texts stays small in Python."""
    for batch in source:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class TokenCache:
    """Ids of texts by a public tokenizer, with the ids of pieces between spaces kept from text to text.

    ``leading_space`` states how the tokenizer splits text. False: white space is dropped, so a text is the sequence of its
    words. True: a single space belongs to the word after it, so a text can be cut before every single space that has no
    white space beside it. Both cuts lie between two pre-tokens, so the ids are those of the whole text; so do the cuts
    between letters, digits and ASCII punctuation that new pieces get. What is one pre-token goes to the library's merge model
    directly, if that gives the ids of the whole tokenizer for some probes; all else goes through the tokenizer. A cache of
    more than ``limit`` pieces becomes the old one, from which pieces in use are taken over.

    A text that holds the string of a special token goes whole through the tokenizer, which gives it the special id; with
    ``special_text`` these strings are ordinary text.
    """

    def __init__(self, path: str, leading_space: bool, limit: int = 300_000, special_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        # their first two characters are enough to tell the few texts that need care
        self.marks = () if special_text else tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.leading_space = leading_space
        self.limit = limit
        self.known: dict = {}
        self.old: dict = {}
        self._letters = byte_letters()
        self._tokenize = self.tokenizer.model.tokenize
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self._code = "I" if self.wide else "H"
        probes = _PROBES if leading_space else [p.strip() for p in _PROBES]
        plain = [array(self._code, self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in probes]
        self.direct = [self._merged(p if leading_space else p.lower()) for p in probes] == plain

    def _pieces(self, text: str) -> list:
        if not self.leading_space:
            return text.encode().translate(_LOWER).split() if text else []
        if re.search(r"\s\s", text) or text[-1:].isspace() or (text[:1].isspace() and text[0] != " "):
            return re.split(r"(?<=\S)(?= \S)", text)
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else re.split(r"(?<=\S)(?= \S)", text)

    def _merged(self, text: str) -> bytes:
        """Ids of one pre-token by the merge model."""
        shown = "\u0120" + text[1:] if text[:1] == " " and text.isascii() else text.encode().decode("latin-1").translate(self._letters)
        return array(self._code, [t.id for t in self._tokenize(shown)]).tobytes()

    def _learn(self, new: list) -> None:
        known, whole, merged = self.known, [], self._merged
        split, words = _PARTS[self.leading_space].findall, self.leading_space
        letters, code, tokenize = self.direct and not words, self._code, self._tokenize
        for piece in new:
            if letters and piece.isalpha():  # ASCII letters are one pre-token and stand for themselves
                known[piece] = array(code, [t.id for t in tokenize(piece.decode())]).tobytes()
                continue
            text = piece if words else piece.decode()
            parts = split(text) if self.direct else ()
            if len(parts) == 1 and len(parts[0]) == len(text):
                known[piece] = merged(text if words else text.lower())
            elif parts and sum(map(len, parts)) == len(text):
                ids = b""
                for part in parts:
                    key = part if words else part.encode()
                    if (got := known.get(key)) is None:
                        got = known[key] = merged(part if words else part.lower())
                    ids += got
                known[piece] = ids
            else:
                whole.append(piece)
        asked = whole if self.leading_space else [p.decode() for p in whole]
        for piece, got in zip(whole, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)):
            known[piece] = array(self._code, got.ids).tobytes()

    def encode(self, many: Sequence[str]) -> list[np.ndarray]:
        """Ids of every text, as little-endian unsigned integers."""
        kind = "<u4" if self.wide else "<u2"
        special = {i for i, t in enumerate(many) if t and any(m in t for m in self.marks)}
        cut = [self._pieces(t) if t and i not in special else [] for i, t in enumerate(many)]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = [p for p in set().union(*cut) if p not in known]
        if old:
            found = [p for p in new if p in old]
            known.update(zip(found, map(old.__getitem__, found)))
            new = [p for p in new if p not in known]
        self._learn(new)
        get = known.__getitem__
        out = [np.frombuffer(b"".join(map(get, p)), kind) for p in cut]
        for i in special:
            out[i] = np.array(self.tokenizer.encode(many[i], add_special_tokens=False).ids, kind)
        return out


_CACHES: dict = {}


def token_cache(path: str, leading_space: bool, special_text: bool = False) -> TokenCache:
    """One cache per Python worker; the tokenizer is read from ``path``, which every executor must have."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, leading_space, special_text)
    if key not in _CACHES:
        _CACHES[key] = TokenCache(path, leading_space, special_text=special_text)
    return _CACHES[key]
