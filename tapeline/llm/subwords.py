"""A linear softmax over averaged subword embeddings, trained in numpy.

A word is the bag of its character n-grams (with word marks) and of itself, each hashed to a row of an embedding table; the
word's vector is their mean and a window's vector the mean of its words. Misspelled and unseen words share most n-grams with
known ones. Embeddings and softmax are trained jointly by stochastic gradient descent with per-row step sizes. The model is
linear in the word vectors, so scoring needs one row of class scores per word, kept per Python worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, rows_of, texts

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
GRAMS = (2, 3, 4, 5)
BATCH = 2048
LEARNED = 20_000  # words whose rows are taken at once
LONGEST_WORD = 60  # longer runs of letters are cut into words of this length
_SAMPLE_UNITS = 1 << 20
_ASCII = bytes(c if chr(c).isalpha() else 32 for c in bytes(range(128)).lower()).ljust(256)  # letters in lower case, all else a space


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (the Unicode categories of letters; other word characters part them)."""
    if text.isascii():
        found = text.encode().translate(_ASCII).decode().split()
    else:
        found = LETTERS.findall(text.lower())
        if not all(map(str.isalpha, found)):
            found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    if found and max(map(len, found)) > LONGEST_WORD:
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def grams_of(word: str) -> list[int]:
    """Rows of a word: itself and its marked n-grams."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode()) % BUCKETS]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


@cache
def _crc_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each byte adds (by exclusive or) to a crc32 when 0 to ``size`` - 1 bytes follow it, and the crc32 of that many zeros."""
    zeros = [zlib.crc32(bytes(n)) for n in range(size + 1)]
    adds = [[zlib.crc32(bytes([b]) + bytes(n)) ^ zeros[n + 1] for b in range(256)] for n in range(size)]
    return np.array(adds, np.uint32), np.array(zeros, np.uint32)


def _crcs(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of many slices of ``data``."""
    out = np.zeros(len(at), np.uint32)
    adds, zeros = _crc_tables(-(-int(sizes.max(initial=1)) // 64) * 64)
    for n in np.flatnonzero(np.bincount(sizes)).tolist():
        mine = np.flatnonzero(sizes == n)
        first, crc = at[mine], np.full(len(mine), zeros[n])
        for j in range(n):
            crc ^= adds[n - 1 - j][data[first + j]]
        out[mine] = crc
    return out


def laid_grams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams_of`` many words, end to end, with the start and count of each word's rows."""
    marked = [f"<{w}>".encode() for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    word = np.repeat(np.arange(len(words)), lengths)[chars]
    n_chars = np.bincount(word, minlength=len(words))
    nth = np.arange(len(chars)) - (np.cumsum(n_chars) - n_chars)[word]
    left, ends = n_chars[word] - nth, np.append(chars, len(data))
    sizes = 1 + sum(np.maximum(n_chars - n + 1, 0) for n in GRAMS)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.int32)
    out[starts] = _crcs(data, np.cumsum(lengths) - lengths, lengths) % BUCKETS
    at = starts + 1
    for n in GRAMS:
        k = np.flatnonzero(left >= n)
        out[at[word[k]] + nth[k]] = _crcs(data, chars[k], ends[k + n] - chars[k]) % BUCKETS
        at = at + np.maximum(n_chars - n + 1, 0)
    return out, starts, sizes


@dataclass
class Bag:
    """Words by number, with their rows laid end to end."""

    index: dict = field(default_factory=dict)
    rows: list = field(default_factory=list)

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        for start in range(0, len(new), LEARNED):
            part = new[start : start + LEARNED]
            flat, starts, _ = laid_grams(part)
            self.index.update(zip(part, range(len(self.rows), len(self.rows) + len(part))))
            self.rows += np.split(flat, starts[1:])

    def numbers(self, words: Sequence[str]) -> np.ndarray:
        """Numbers of words that were learned."""
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))


def _laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


@dataclass
class Model:
    """``rows``: class scores of every embedding row. ``pad``: words a window counts as having at least."""

    labels: list
    rows: np.ndarray
    bias: np.ndarray
    pad: int

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Mean class scores of the n-grams of every word."""
        flat, starts, sizes = laid_grams(words)
        return np.add.reduceat(self.rows[flat], starts, axis=0) / sizes[:, None]


def train(windows: Sequence[Sequence[str]], target: np.ndarray, labels: list, pad: int = 1, dim: int = 12, epochs: int = 4, rate: float = 0.5, seed: int = 7, least_steps: int = 400, docs: np.ndarray | None = None, least_docs: int = 4) -> Model:
    """Fit by minibatches of 512 windows; ``target`` holds the class number of every window. Few windows are gone over more often.

    With ``docs``, the document of every window, only rows met in ``least_docs`` documents learn, so that a model does not
    remember single documents by their rare n-grams.
    """
    rng, bag, k = np.random.default_rng(seed), Bag(), len(labels)
    bag.learn(chain.from_iterable(windows))
    numbers = [bag.numbers(w) for w in windows]
    # rows start at zero, so n-grams never seen in training say nothing; the softmax starts at random
    table = np.zeros((BUCKETS, dim), np.float32)
    out, bias = rng.normal(0, 1, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    seen_table, seen_out, seen_bias = np.full(BUCKETS, 1e-4, np.float32), np.full((dim, k), 1e-4, np.float32), np.full(k, 1e-4, np.float32)
    learns = np.ones(BUCKETS, np.float32)
    if docs is not None:
        met, order = np.zeros(BUCKETS, np.int64), np.argsort(docs, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(docs[order])) + 1):
            own = np.unique(np.concatenate([numbers[i] for i in part]))
            if len(own):
                met[np.unique(np.concatenate([bag.rows[w] for w in own]))] += 1
        learns = (met >= least_docs).astype(np.float32)
    usable = np.array([i for i, n in enumerate(numbers) if len(n)], np.int64)
    steps = -(-len(usable) // BATCH)
    for _ in range(max(epochs, -(-least_steps // max(steps, 1)) if steps else 0)):
        rng.shuffle(usable)
        for start in range(0, len(usable), BATCH):
            mine = usable[start : start + BATCH]
            parts = [numbers[i] for i in mine]
            lengths = np.array([len(p) for p in parts])
            words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            flat, starts, sizes = _laid([bag.rows[w] for w in words])
            vectors = np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None].astype(np.float32)
            scale = (1 / np.maximum(lengths, pad)).astype(np.float32)[:, None]
            ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            hidden = np.add.reduceat(vectors[inverse], ends, axis=0) * scale
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(mine)), target[mine]] -= 1
            p /= len(mine)
            to_hidden, to_out, to_bias = p @ out.T * scale, hidden.T @ p, p.sum(axis=0)
            to_words = np.zeros_like(vectors)
            spread = np.repeat(to_hidden, lengths, axis=0)
            for j in range(dim):
                to_words[:, j] = np.bincount(inverse, spread[:, j], len(words))
            to_words /= sizes[:, None]
            rows, at = np.unique(flat, return_inverse=True)
            per_row = np.repeat(to_words, sizes, axis=0)
            step = np.stack([np.bincount(at, per_row[:, j], len(rows)) for j in range(dim)], axis=1).astype(np.float32) * learns[rows, None]
            seen_table[rows] += (step**2).mean(axis=1) * dim
            table[rows] -= rate * step / np.sqrt(seen_table[rows])[:, None]
            seen_out += to_out**2
            out -= rate * to_out / np.sqrt(seen_out)
            seen_bias += to_bias**2
            bias -= rate * to_bias / np.sqrt(seen_bias)
    return Model(list(labels), (table @ out).astype(np.float32), bias, pad)


class Scorer:
    """Class scores of texts; scores of words are kept up to ``limit`` words."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        self.index: dict[str, int] = {}
        self.known = np.zeros((0, len(model.labels)), np.float32)

    def scores(self, many: Sequence[list[str]]) -> list[np.ndarray]:
        """One row of class scores per word of every text."""
        if len(self.index) > self.limit:
            self.index, self.known = {}, self.known[:0]
        new = sorted(w for w in set().union(*many) if w not in self.index)
        for start in range(0, len(new), LEARNED):
            part = new[start : start + LEARNED]
            self.known = np.concatenate([self.known, self.model.word_scores(part)])
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
        get = self.index.__getitem__
        return [self.known[np.fromiter(map(get, w), np.int64, len(w))] for w in many]


WINDOW = pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("nth", pa.int32()), ("words", pa.string())])


@dataclass
class Sample:
    """Windows of sampled documents, in a fixed order; ``share`` is the sampled share of every label."""

    doc: np.ndarray
    label: np.ndarray
    windows: list[list[str]]
    share: dict[str, float]


def draw(marks: DataFrame, per_label: int, most_labels: int = 1000) -> tuple[DataFrame, dict[str, float]]:
    """About ``per_label`` rows of every label of ``marks`` (doc_id, label, ...) by a hash of the id, and the share drawn."""
    marks = marks.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    counts = marks.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    share = {r["label"]: min(1.0, per_label / r["n"]) for r in counts}
    if not share:
        return marks.filter("false"), {}
    limit = F.create_map(*[F.lit(x) for k, s in share.items() for x in (k, int(s * _SAMPLE_UNITS))])
    return marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLE_UNITS)) < limit[F.col("label")]), share


def sample_windows(drawn: DataFrame, share: dict[str, float], width: int, per_doc: int | None) -> Sample:
    """Windows of ``width`` words of the drawn documents (doc_id, text, label). Of each document at most ``per_doc``, evenly
    spaced over the whole text; without that bound, all different ones. Of rows with one id the text that sorts first is read,
    so the documents are bounded by the rows drawn per label and the count of labels."""
    if not share:
        return Sample(np.zeros(0, np.int64), np.zeros(0, object), [], {})

    def cut(source):
        for batch in batches(source, 256):
            rows: list[list] = [[], [], [], []]
            for doc_id, label, text in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), texts(batch)):
                words = words_of(text)
                windows = [" ".join(words[i : i + width]) for i in range(0, len(words), width)]
                if per_doc is None:
                    windows = list(dict.fromkeys(windows))
                elif len(windows) > per_doc:
                    windows = [windows[i] for i in np.unique(np.linspace(0, len(windows) - 1, per_doc).astype(int))]
                for i, window in enumerate(windows):
                    for column, value in zip(rows, (doc_id, label, i, window)):
                        column.append(value)
            yield rows_of(WINDOW, rows)

    chosen = drawn.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("_first"))
    found = chosen.select("doc_id", F.col("_first.label").cast("string").alias("label"), "_first.text").mapInArrow(cut, "doc_id long, label string, nth int, words string")
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("nth", "ascending"), ("words", "ascending")])
    windows = [w.split() for w in got["words"].to_pylist()]
    return Sample(got["doc_id"].to_numpy(), np.array(got["label"].to_pylist(), dtype=object), windows, share)


def for_calibration(doc_id: int) -> bool:
    """A quarter of the sampled documents calibrates and is not fitted."""
    return zlib.crc32(f"calibrate {doc_id}".encode()) % 4 == 0
