"""Benchmark decontamination by latent semantic retrieval.

Documents are read as blocks of ``BLOCK`` words. A randomised singular value decomposition of the TF-IDF matrix of all blocks
over hashed words, in one distributed pass (Nystroem form: the matrix times its transpose times a random basis), gives a latent
space. A benchmark item is compared by cosine with every window of blocks of about its length; what comes near is checked on
the words themselves: the longest common subsequence with the item, and for looser likenesses that of its answer.
Items of a few words are too small for cosines; they are found where their words stand side by side in the same order.

Document frequencies, the decomposition and the search cover all blocks of all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, rows_of, text_column, texts

FEATURES = 4096
RANK = 64
BLOCK = 12
SKIP = 16  # leading components left out: they tell languages and frequent words, which all passages share
NEAR = 0.42  # least cosine of a candidate
SAME = 0.8  # share of an item's words in common order that makes a copy
LIKE = 0.6  # the same for a paraphrase, whose answer must be there
LEAST_WORDS = 8  # items with fewer words are found as exact word sequences only
ITEMS_AT_ONCE = 2000  # items compared in one pass over the documents; more take more passes
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M")
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, bopomofo and Chinese characters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3007\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_OTHER = re.compile(rf"[^\x00-\x7f\w{_MARKS}]+")
_ALONE = re.compile(rf"[{_UNSPACED}][{_MARKS}]*")
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 14  # words handled at once: their vectors stay in the cache


class WordHashes:
    """32-bit hashes of the words of texts in lower case.

    Words are runs of letters, digits and combining marks of any script; a character of a script without spaces is a word.
    """

    def __init__(self, limit: int = 200_000):
        self.limit, self.known = limit, {}

    def of(self, text: str) -> np.ndarray:
        text = text.lower()
        if not text.isascii():
            text = _ALONE.sub(r" \g<0> ", _OTHER.sub(" ", text))
        words = text.encode().translate(_SPACES).split()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh32_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        if len(known) > self.limit:
            self.known = {}
        return out


def _word_table(docs: DataFrame) -> DataFrame:
    """doc_id and word hashes of every row; written once and read by all passes."""
    shape = pa.schema([("doc_id", pa.int64()), ("words", pa.binary())])

    def run(source):
        hashes = WordHashes()
        for batch in batches(source, 256):
            yield rows_of(shape, [batch.column("doc_id"), [hashes.of(t).tobytes() for t in texts(batch)]])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words binary"))


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint32) for w in batch.column("words").to_pylist()]


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of about ``_CHUNK`` words and the starts of their blocks; long documents are cut between blocks."""
    parts, starts, held = [], [], 0
    for batch in batches(source, 512):
        for words in _arrays(batch):
            for at in range(0, len(words), _CHUNK // BLOCK * BLOCK):
                piece = words[at : at + _CHUNK // BLOCK * BLOCK]
                parts.append((piece % FEATURES).astype(np.uint16))
                starts.append(np.arange(0, len(piece), BLOCK) + held)
                held += len(piece)
                if held >= _CHUNK:
                    yield np.concatenate(parts), np.concatenate(starts)
                    parts, starts, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(starts)


def document_frequencies(words: DataFrame) -> tuple[int, np.ndarray]:
    """Blocks in all, and blocks that hold each feature."""

    def run(source):
        total, count = 0, np.zeros(FEATURES, np.int64)
        for ids, starts in _chunks(source):
            sizes = np.diff(np.append(starts, len(ids)))
            place = np.arange(len(ids)) - np.repeat(starts, sizes)
            grid = np.full((len(starts), BLOCK), FEATURES, np.uint16)  # one row per block, sorted to find repeats
            grid[np.repeat(np.arange(len(starts)), sizes), place] = ids
            grid.sort(axis=1)
            fresh = np.ones(grid.shape, bool)
            fresh[:, 1:] = grid[:, 1:] != grid[:, :-1]
            count += np.bincount(grid[fresh], minlength=FEATURES + 1)[:FEATURES]
            total += len(starts)
        at = np.flatnonzero(count)
        yield rows_of(pa.schema([("feature", pa.int32()), ("n", pa.int64())]), [np.append(at, -1), np.append(count[at], total)])

    sums = words.select("words").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(FEATURES), 0
    for r in sums:
        if r["feature"] < 0:
            total = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return total, out


def sketch_rows(source: Iterator[pa.RecordBatch], weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features met and their rows of (A^T A basis), A being the weighted blocks of ``source``."""
    weighted = (weights[:, None] * basis).astype(np.float32)
    out = np.zeros((FEATURES, basis.shape[1]))
    for ids, starts in _chunks(source):
        projected = np.add.reduceat(weighted[ids], starts, axis=0)
        block = np.zeros(len(ids), np.int64)
        block[starts[1:]] = 1
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], np.cumsum(block)[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        out[ids[first]] += np.add.reduceat(projected[block], first, axis=0)
    out *= weights[:, None]
    at = np.flatnonzero(np.abs(out).sum(axis=1))
    return at, out[at]


def latent_map(words: DataFrame, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """FEATURES x (rank - SKIP): what each word adds to the whitened latent vector of its passage."""
    total, count = document_frequencies(words)
    weights = np.where(count > 0, np.log((1 + total) / (1 + count)), 0.0)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(FEATURES, rank)))[0]

    def run(source):
        at, rows = sketch_rows(source, weights, basis)
        yield rows_of(pa.schema([("feature", pa.int32()), *[(f"v{j}", pa.float64()) for j in range(rank)]]), [at, *rows.T])

    names = [f"v{j}" for j in range(rank)]
    parts = words.select("words").mapInArrow(run, "feature int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    product = np.zeros((FEATURES, rank))
    for r in sums.collect():  # FEATURES rows at most
        product[r["feature"]] = r[1:]
    return whitened(product, basis, weights)


def whitened(product: np.ndarray, basis: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Right singular vectors and values from the sketch, as the map from words to whitened coordinates."""
    shift = 1e-9 * np.linalg.norm(product) + 1e-12
    product = product + shift * basis
    core = basis.T @ product
    factor = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(len(core)))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(factor, product.T).T, full_matrices=False)
    vectors, values = vectors[:, SKIP:], values[SKIP:]
    return (weights[:, None] * vectors / np.maximum(values, 1e-6 * values.max() + 1e-12)).astype(np.float32)


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray
    blocks: int


def read_items(rows: Sequence[tuple[int | None, str | None]]) -> list[Item]:
    """Items with words; the answer is the last sentence or line, or the whole of an item of one sentence."""
    hashes, out = WordHashes(), []
    for item_id, text in rows:
        words = hashes.of(text or "")
        if not len(words):
            continue
        sentences = [h for s in re.split(r"[.!?\n。！？｡]+", text) if len(h := hashes.of(s))]
        out.append(Item(item_id, words, sentences[-1], -(-(len(words) + BLOCK // 2) // BLOCK)))
    return out


def common_length(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    places: dict[int, int] = {}
    for j, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(item)) - 1
    state = full
    for w in region.tolist():
        if hit := state & places.get(w, 0):
            state = ((state + hit) | (state - hit)) & full
    return len(item) - state.bit_count()


def verdict(item: Item, region: np.ndarray) -> tuple[int, bool] | None:
    """Common words and whether the answer is there, if the region holds the item or a paraphrase with its answer."""
    if np.isin(item.words, region).mean() < LIKE:
        return None
    common = common_length(item.words, region)
    if common < LIKE * len(item.words):
        return None
    answered = common_length(item.answer, region) >= SAME * len(item.answer)
    return (common, answered) if common >= SAME * len(item.words) or answered else None


class Searcher:
    def __init__(self, items: list[Item], latent: np.ndarray):
        self.items, self.latent = items, latent
        self.by_blocks: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            self.by_blocks.setdefault(item.blocks, []).append(i)
        z = np.stack([latent[item.words % FEATURES].sum(axis=0) for item in items]) if items else np.zeros((0, latent.shape[1]))
        self.vectors = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)).astype(np.float32)
        self.tables = {}
        for blocks, mine in self.by_blocks.items():
            sizes = np.array([len(items[i].words) for i in mine])
            table = np.full((len(mine), sizes.max()), FEATURES + 1, np.uint16)
            for row, i in zip(table, mine):
                row[: len(items[i].words)] = items[i].words % FEATURES
            self.tables[blocks] = (table, sizes)

    def candidates(self, docs: Sequence[np.ndarray]) -> Iterator[tuple[int, int, int, float]]:
        """Document, item, first word and cosine of the windows that come near an item and have enough of its words."""
        words, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
        ends = np.cumsum(lengths)
        starts = [np.arange(end - n, end, BLOCK) for end, n in zip(ends, lengths)]
        per_doc = np.array([len(s) for s in starts])
        at, features = np.concatenate(starts), (words % FEATURES).astype(np.uint16)
        if not len(at):
            return
        step = _CHUNK // BLOCK  # blocks whose words are looked up at once
        edges = np.append(at, len(words))
        sums = [np.add.reduceat(self.latent[features[edges[i] : edges[min(i + step, len(at))]]], at[i : i + step] - at[i], axis=0) for i in range(0, len(at), step)]
        total = np.concatenate([np.zeros((1, self.latent.shape[1])), np.cumsum(np.concatenate(sums), axis=0, dtype=np.float64)])
        doc = np.repeat(np.arange(len(docs)), per_doc)
        last = np.repeat(np.cumsum(per_doc), per_doc)
        block = np.arange(len(at))
        head = np.zeros(len(at), bool)
        head[(np.cumsum(per_doc) - per_doc)[per_doc > 0]] = True
        for blocks, mine in self.by_blocks.items():
            first = block[head | (block + blocks <= last)]  # a document shorter than the window is one
            z = total[np.minimum(first + blocks, last[first])] - total[first]
            near = (z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)).astype(np.float32) @ self.vectors[mine].T
            windows, found = np.nonzero(near >= NEAR)
            for i in range(0, len(windows), 4096):
                w, k = first[windows[i : i + 4096]], found[i : i + 4096]
                low = (ends - lengths)[doc[w]]
                for j in np.flatnonzero(self._enough(features, at[w], low, ends[doc[w]], blocks, k)):
                    yield int(doc[w[j]]), mine[k[j]], int(at[w[j]] - low[j]), float(near[windows[i + j], k[j]])

    def _enough(self, features: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, blocks: int, which: np.ndarray) -> np.ndarray:
        """Whether the region around a window has enough of the item's words, by their features: a bound, so nothing is lost."""
        at = first[:, None] - BLOCK + np.arange((blocks + 2) * BLOCK)
        region = np.where((at >= low[:, None]) & (at < high[:, None]), features[np.clip(at, 0, len(features) - 1)], FEATURES)
        table, sizes = self.tables[blocks]
        item = table[which]
        present = np.zeros(item.shape, bool)
        for column in range(region.shape[1]):
            present |= item == region[:, column, None]
        return present.sum(axis=1) >= LIKE * sizes[which]

    def matches(self, docs: Sequence[np.ndarray]) -> list[dict[int, tuple[float, int, bool]]]:
        """Best (cosine, common words, answered) of every item that each document holds."""
        out: list[dict[int, tuple[float, int, bool]]] = [{} for _ in docs]
        for d, i, first, near in self.candidates(docs):
            item, best = self.items[i], out[d]
            region = docs[d][max(0, first - BLOCK) : first + (item.blocks + 1) * BLOCK]
            if (i not in best or best[i][1] < len(item.words)) and (found := verdict(item, region)):
                best[i] = max(best.get(i, (0.0, 0, False)), (near, *found), key=lambda x: (x[1], x[2], x[0]))
        return out


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words."""
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        total = (total ^ words[k : k + len(total)]) * _MIX
        total ^= total >> np.uint64(31)
    return total


class SequenceSearcher:
    """Finds items as contiguous word sequences."""

    def __init__(self, items: list[Item]):
        self.items, self.by_length = items, {}
        lengths = np.array([len(item.words) for item in items])
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            hashes = np.concatenate([sequence_hashes(items[i].words, n) for i in mine])
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[order], mine[order])

    def matches(self, docs: Sequence[np.ndarray]) -> list[dict[int, tuple[float, int, bool]]]:
        """(1.0, words, True) of every item that each document holds."""
        out: list[dict[int, tuple[float, int, bool]]] = [{} for _ in docs]
        if not self.items:
            return out
        words, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
        for n, (keys, mine) in self.by_length.items():
            hashes = sequence_hashes(words, n)
            low = np.searchsorted(keys, hashes, "left")
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes)
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc]
            for d, k in np.unique(np.stack([doc[inside], low[at[inside]]]), axis=1).T.tolist():
                first = keys[k]
                while k < len(keys) and keys[k] == first:  # items with the same words
                    out[d][int(mine[k])] = (1.0, n, True)
                    k += 1
        return out


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("common_words", pa.int64()), ("answered", pa.bool_()), ("similarity", pa.float64())]
)
FOUND_DDL = "doc_id long, item_id long, item_words long, common_words long, answered boolean, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, common_words, answered and similarity of every document that holds a benchmark item.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text). Null and empty texts hold nothing, items without words are nowhere.
    Items of fewer than ``LEAST_WORDS`` words are found as exact word sequences, with similarity 1. Repeated rows are reported
    as often as they occur. Other columns are ignored.
    The items are the stated queries: they are compared with all documents in blocks of ``ITEMS_AT_ONCE``.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    words = _word_table(slim)
    latent, out = latent_map(words), words.sparkSession.createDataFrame([], FOUND_DDL)
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text")
    block: list = []
    for row in asked.toLocalIterator():
        block.append(tuple(row))
        if len(block) == ITEMS_AT_ONCE:
            out, block = out.unionByName(_search(words, read_items(block), latent)), []
    return out.unionByName(_search(words, read_items(block), latent)) if block else out


def _search(words: DataFrame, items: list[Item], latent: np.ndarray) -> DataFrame:
    long = [item for item in items if len(item.words) >= LEAST_WORDS]
    short = [item for item in items if len(item.words) < LEAST_WORDS]

    def run(source):
        searchers = [s for s in (Searcher(long, latent), SequenceSearcher(short)) if s.items]
        for batch in batches(source, 256):
            rows: list[list] = [[] for _ in FOUND]
            docs, ids = _arrays(batch), batch.column("doc_id").to_pylist()
            for searcher in searchers:
                for doc_id, mine in zip(ids, searcher.matches(docs)):
                    for i, (near, common, answered) in mine.items():
                        item = searcher.items[i]
                        for column, value in zip(rows, (doc_id, item.item_id, len(item.words), common, answered, near)):
                            column.append(value)
            yield rows_of(FOUND, rows)

    return words.mapInArrow(run, FOUND_DDL)
