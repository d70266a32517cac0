"""Alignment of the token sequences that two tokenizers give for the same text.

Both tokenizers run over the whole text first. A place where both sequences have a token end and both next tokens begin with a
space is an anchor; anchors cut a document into windows, mostly of one word. A window is known by its two tuples of ids, and
what lies inside, its groups and links, does not depend on where it stands, so every worker keeps the windows it has met and
aligns only new ones. Bytes are compared window by window: a document counts only if both sequences spell out its text.

How many documents hold a linked pair of ids is counted in two steps, first inside tasks. The counts come back to the documents
as a broadcast if there are at most ``BROADCAST_PAIRS`` of them, else by a join.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import batches, byte_letters, materialize, rows_of, text_column, texts, token_cache

SPACE = "▁"  # stands for a space in pieces
BROADCAST_PAIRS = 2_000_000  # 26 bytes each
KEPT_WINDOWS = 300_000  # per worker, twice
LONG_WINDOW = 128  # bytes of ids; longer windows are aligned each time
END = b"\xff\xff"  # no id; stands between the two sides of a window
COUNTED_PAIRS = 1 << 20  # pairs a task holds before it passes its counts on


class PieceCache:
    """Ids of whole texts by a piece vocabulary, with the ids of the words met so far.

    No piece has a space after another character (checked), so merges never cross the end of a word and a text can be cut
    before every run of spaces. Texts that hold the sign for a space, and all texts if the vocabulary lacks the property, are
    encoded whole.
    """

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuttable = not any(SPACE in n.lstrip(SPACE) for n in self.names)
        self.space = self.model.piece_to_id(SPACE)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def bytes_of(self) -> list[bytes]:
        """What every piece stands for."""
        return [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(self.names)]

    def _words(self, text: str) -> list[str]:
        """The text, with the space that the model puts before it, cut before every run of spaces. Of each run one space is left
        out, since the model adds it again; only a run at the end of the text is told whole."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, spaces = [], 0
        for word in words:
            if word:
                out.append(" " * spaces + word)
                spaces = 0
            else:
                spaces += 1
        return [*out, " " * spaces] if spaces else out

    def encode(self, many: Sequence[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(many) if not self.cuttable or SPACE in t}
        cut = [self._words(t) if t and i not in whole else [] for i, t in enumerate(many)]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = [w for w in set().union(*cut) if w not in known]
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in known]
        asked = [w if w.strip(" ") else w[1:] for w in new]
        for word, ids in zip(new, self.model.encode(asked, num_threads=1)):
            known[word] = array("H", ids if word != " " else [self.space]).tobytes()
        get = known.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), "<u2") for words in cut]
        for i in whole:
            out[i] = np.array(self.model.encode(many[i]), "<u2")
        return out


class Aligner:
    """Both tokenizers and the windows met so far; one per Python worker."""

    def __init__(self, path_a: str, path_b: str, windows: int = KEPT_WINDOWS):
        self.a, self.b = token_cache(path_a, leading_space=True, special_text=True), PieceCache(path_b)
        raw = {letter: bytes([value]) for value, letter in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab()
        if max(vocabulary.values()) > 0xFFFE or len(self.b.names) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = b"".join(raw.get(c, c.encode()) for c in token)
        self.bytes_b = self.b.bytes_of()
        self.size_a, self.size_b = (np.array([len(t) for t in side]) for side in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in side]) for side in (self.bytes_a, self.bytes_b))
        self._told = [[np.array([b"%d%c" % (i, ord(end)) for i in range(len(side))], object) for end in ends] for side, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))]
        # a byte-level vocabulary that changes no text spells it out always
        steps = json.loads(self.a.tokenizer.to_str())
        self.lossless = steps["normalizer"] is None and steps["pre_tokenizer"]["type"] == "ByteLevel" and not steps["pre_tokenizer"]["add_prefix_space"] and all(c in vocabulary for c in raw)
        self.limit = windows
        self.known: dict = {}
        self.old: dict = {}

    def align(self, windows: Sequence[bytes]) -> list[tuple[bytes, bytes | None]]:
        """Written groups and linked pairs of every window (``a ids, END, b ids``); the pairs are None if the sides' bytes differ.

        The windows are laid end to end. Both sides of a window have the same size, so ends stay comparable across windows: every
        stretch between two neighbouring ends is one link, every end of both sides closes a group.
        """
        numbers = np.frombuffer(b"".join([w + END for w in windows]), "<u2")
        stops = numbers == 0xFFFF
        part = np.cumsum(stops)
        mine_a, mine_b = ~stops & (part % 2 == 0), ~stops & (part % 2 == 1)
        a, b = numbers[mine_a], numbers[mine_b]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        window_a, window_b = part[mine_a] // 2, part[mine_b] // 2
        ends = np.union1d(end_a, end_b)
        at = np.searchsorted(end_a, ends)
        pairs = (a[at].astype(np.uint32) << 16) | b[np.searchsorted(end_b, ends)]
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        told = np.empty(len(a) + len(b), object)
        last_a, last_b = np.append(np.diff(group_a), 1) > 0, np.append(np.diff(group_b), 1) > 0
        told[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, self._told[0][1][a], self._told[0][0][a])
        told[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(last_b, self._told[1][1][b], self._told[1][0][b])
        told = told.tolist()
        spelt_a, spelt_b = (b"".join(map(names.__getitem__, ids.tolist())) for names, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        n = np.arange(1, len(windows) + 1)
        next_a = np.searchsorted(window_a, n)
        tokens = (next_a + np.searchsorted(window_b, n)).tolist()
        links, sizes = (4 * np.searchsorted(window_a[at], n)).tolist(), end_a[next_a - 1].tolist()
        pairs, alike, out = pairs.tobytes(), spelt_a == spelt_b, []
        t = k = s = 0
        for t1, k1, s1 in zip(tokens, links, sizes):
            out.append((b"".join(told[t:t1])[:-1], pairs[k:k1] if alike or spelt_a[s:s1] == spelt_b[s:s1] else None))
            t, k, s = t1, k1, s1
        return out

    def windows(self, a: np.ndarray, b: np.ndarray, size: int) -> list[bytes]:
        """The windows between anchors, none if the sequences do not have ``size`` bytes."""
        from_a, from_b = self.size_a[a], self.size_b[b]
        if from_a.sum() != size or from_b.sum() != size:
            return []
        from_a, from_b = np.cumsum(from_a) - from_a, np.cumsum(from_b) - from_b
        first_a, first_b = np.flatnonzero(self.spaced_a[a]), np.flatnonzero(self.spaced_b[b])
        at_a, at_b = from_a[first_a], np.append(from_b[first_b], -1)
        near = np.searchsorted(at_b[:-1], at_a)
        shared = (at_b[near] == at_a) & (at_a > 0)
        cuts_a, cuts_b = (2 * first_a[shared]).tolist(), (2 * first_b[near[shared]]).tolist()
        all_a, all_b = a.tobytes(), b.tobytes()
        return [all_a[i:j] + END + all_b[k:m] for i, j, k, m in zip([0, *cuts_a], [*cuts_a, len(all_a)], [0, *cuts_b], [*cuts_b, len(all_b)])]

    def documents(self, many: Sequence[str]) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
        """n_a, n_b, n_groups, n_links, written groups and linked pairs of every text; zeros and nothing for texts that the two
        sequences do not spell out."""
        spelt = [b" " + t.encode() if t else b"" for t in many]
        ids_a, ids_b = self.a.encode([f" {t}" if t else "" for t in many]), self.b.encode(many)
        cut = [self.windows(a, b, len(raw)) if raw else [] for a, b, raw in zip(ids_a, ids_b, spelt)]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = [w for w in set().union(*cut) if w not in known]
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in known]
        known.update(zip(new, self.align(new) if new else []))
        for a, b, raw, windows in zip(ids_a, ids_b, spelt, cut):
            found = list(zip(*map(known.__getitem__, windows)))
            if not found or None in found[1] or not (self.lossless or b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw):
                yield 0, 0, 0, 0, b"", b""
            else:
                groups, pairs = b";".join(found[0]), b"".join(found[1])
                yield len(a), len(b), groups.count(b";") + 1, len(pairs) // 4, groups, pairs
        for w in new:
            if len(w) > LONG_WINDOW:
                del known[w]


_ALIGNERS: dict = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _pressed(pairs: bytes, packer: zstd.ZstdCompressor) -> bytes:
    """Different pairs, ascending as differences, and how often each is linked."""
    keys, times = np.unique(np.frombuffer(pairs, "<u4"), return_counts=True)
    return packer.compress(np.diff(keys, prepend=np.uint32(0)).tobytes() + times.astype("<u4").tobytes())


def _unpressed(data: bytes, opener: zstd.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(opener.decompress(data), "<u4")
    half = len(numbers) // 2
    return np.cumsum(numbers[:half], dtype=np.uint32), numbers[half:].astype(np.int64)


_TOLD = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_TOLD_DDL = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def link(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, with the numbers of ``Aligner.documents``, the digest of the written groups, a row number,
    the pressed links and, if asked for, the groups as text."""
    own = [c for c in docs.columns if c not in {"text", "row", "links", "groups", "n_best", "count_sum", *dict(_TOLD)}]
    rows = docs.select(*own, text_column().alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in own)
    shape = pa.schema([*_TOLD, ("row", pa.int64()), ("links", pa.binary()), *[("groups", pa.string())] * with_groups])

    def run(source):
        pair, packer, number = aligner(path_a, path_b), zstd.ZstdCompressor(level=1), TaskContext.get().partitionId() << 40
        for batch in batches(source, 256):
            columns: list[list] = [[] for _ in shape]
            for n_a, n_b, n_groups, n_links, groups, pairs in pair.documents(texts(batch)):
                digest = hashlib.sha256(groups).hexdigest() if n_a else ""
                values = (n_a, n_b, n_groups, n_links, digest, number, _pressed(pairs, packer), groups.decode())
                number += 1
                for column, value in zip(columns, values):
                    column.append(value)
            told = rows_of(shape, columns)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *told.columns], names=[*own, *shape.names])

    return rows.mapInArrow(run, f"{fields}{_TOLD_DDL}, row long, links binary" + ", groups string" * with_groups)


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair (a id << 16 | b id) and n: in how many rows of ``linked`` the two are linked."""
    shape = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(source):
        opener = zstd.ZstdDecompressor()
        keys, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches(source, 512):
            met = [_unpressed(x, opener)[0] for x in batch.column("links").to_pylist()]
            part, times = np.unique(np.concatenate(met), return_counts=True)
            both, back = np.unique(np.concatenate([keys, part]), return_inverse=True)
            keys, n = both, np.bincount(back, np.concatenate([n, times]), len(both)).astype(np.int64)
            if len(keys) > COUNTED_PAIRS:
                yield rows_of(shape, [keys, n])
                keys, n = keys[:0], n[:0]
        yield rows_of(shape, [keys, n])

    return linked.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _lookup(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, ascending, with their counts and whether the count is the highest of the a id."""
    arrow = counts.toArrow()
    pairs, n = (arrow.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
    most = np.maximum.reduceat(n, first) if len(n) else n
    return pairs.astype(np.uint32), n, n == np.repeat(most, np.diff(first, append=len(n)))


def _scored_by_broadcast(linked: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    table = linked.sparkSession.sparkContext.broadcast(_lookup(counts))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in linked.schema if f.name in kept)

    def score(source):
        pairs, n, best = table.value
        opener = zstd.ZstdDecompressor()
        for batch in batches(source, 512):
            met = [_unpressed(x, opener) for x in batch.column("links").to_pylist()]
            at = np.searchsorted(pairs, np.concatenate([m[0] for m in met]))
            times = np.concatenate([m[1] for m in met])
            ends = np.cumsum([len(m[0]) for m in met])
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (best[at] * times, n[at] * times)] if len(pairs) else [np.zeros(1, np.int64)] * 2
            told = [pa.array(np.diff(s[ends], prepend=0).astype(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *told], names=[*kept, "n_best", "count_sum"])

    return linked.select(*kept, "links").mapInArrow(score, f"{fields}, n_best long, count_sum long")


def _scored_by_join(linked: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    shape = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])

    def spread(source):
        opener = zstd.ZstdDecompressor()
        for batch in batches(source, 64):
            rows = batch.column("row").to_pylist()
            met = [_unpressed(x, opener) for x in batch.column("links").to_pylist()]
            yield rows_of(shape, [np.repeat(rows, [len(m[0]) for m in met]), np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met])])

    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))  # pairs of one a id are at most the other vocabulary
    table = materialize(counts.withColumn("best", F.col("n") == most))
    links = linked.select("row", "links").mapInArrow(spread, "row long, pair long, times long")
    best, n = F.when(F.col("best"), F.col("times")).otherwise(0), F.col("n") * F.col("times")
    sums = links.join(table, "pair").groupBy("row").agg(F.sum(best).alias("n_best"), F.sum(n).alias("count_sum"))
    told = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return linked.select("row", *kept).join(sums, "row", "left").select(*kept, *told)


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The columns of ``docs`` but text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum and, if asked for, groups.

    Tokenizer a gets a space and the text, tokenizer b the text, before which it puts a space itself; strings of special tokens are
    plain text. A text that is null or empty, or that one of the sequences does not spell out byte by byte, has no tokens: zeros
    and empty strings. n_best counts the links whose pair is in as many documents as any pair of its a id, count_sum adds up
    these counts over the links. Repeated rows are documents of their own. Columns with the names of results are replaced.
    """
    linked = materialize(link(docs, path_a, path_b, with_groups))
    counts = materialize(pair_counts(linked))
    kept = [c for c in linked.columns if c not in ("row", "links")]
    scored = _scored_by_broadcast if counts.count() <= broadcast_pairs else _scored_by_join
    return scored(linked, counts, kept)
