"""Token-id files with random access: directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the lowest chunk of every id; a continuation bit
per entry says whether the id has a further chunk in the next level, at the position given by the number of
continuation bits before it. A rank directory keeps that number for every 512th bit, so the id at any position is read
with one directory entry and at most 64 bytes of bitmap per level, without decoding a block.

A file: magic; segments of at most ``SEGMENT`` ids; a footer with the segment offsets and the documents. Documents
may run over a segment's end. A segment, level by level: chunks (one byte each), bitmap, rank directory (unsigned 32-bit).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, rows_of, shared_folder, text_column, texts, token_cache

MAGIC = b"TLDAC\x00\x00\x01"
SEGMENT = 1 << 21
RANK_BITS = 512
END_ID = 1


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Chunks, continuation bitmap and rank directory of every level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        out.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            return out
        rest = rest[more] >> 8


def decode_levels(levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids of a segment from the chunks and bitmaps of its levels."""
    out = levels[0][0].astype(np.uint32)
    at = None
    for depth, (chunks, bits) in enumerate(levels):
        if depth:
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * depth)
        more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
        at = more if at is None else at[more]
    return out


class TokenWriter:
    """Writes one file; ids are held for one segment at most."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = []
        self.segments: list[tuple[int, int]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.total)
        self.total += len(ids)
        while self.held + len(ids) >= SEGMENT:
            room = SEGMENT - self.held
            self.pending.append(ids[:room])
            self._flush()
            ids = ids[room:]
        self.pending.append(ids)
        self.held += len(ids)

    def _flush(self) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        self.pending, self.held = [], 0
        if not len(ids):
            return
        levels = encode_levels(ids)
        self.segments.append((self.at, len(ids)))
        self._put(np.array([len(levels), *[len(c) for c, _, _ in levels]], "<u8").tobytes())
        for level in levels:
            for part in level:
                self._put(part)

    def close(self) -> None:
        self._flush()
        n, null = len(self.doc_ids), [d is None for d in self.doc_ids]
        footer = np.array([n, self.total, len(self.segments)], "<u8").tobytes()
        footer += np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(null, np.uint8).tobytes()
        footer += np.array(self.starts, "<u8").tobytes() + np.array(self.segments, "<u8").tobytes()
        self._put(footer + np.array([len(footer)], "<u8").tobytes() + MAGIC)


class TokenFile:
    """Reads a file by seeking: the footer once, then single ids or whole segments."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if self._read(0, 8) != MAGIC or self._read(size - 8, 8) != MAGIC:
            raise ValueError("not a token file, or cut short")
        length = int(np.frombuffer(self._read(size - 16, 8), "<u8")[0])
        footer = self._read(size - 16 - length, length)
        n, self.total, k = (int(x) for x in np.frombuffer(footer, "<u8", 3))
        self.doc_ids = np.frombuffer(footer, "<i8", n, 24)
        self.null = np.frombuffer(footer, np.uint8, n, 24 + 8 * n).astype(bool)
        self.starts = np.frombuffer(footer, "<u8", n, 24 + 9 * n).astype(np.int64)
        self.segments = np.frombuffer(footer, "<u8", 2 * k, 24 + 17 * n).reshape(-1, 2).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.segments[:, 1])]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _levels(self, segment: int) -> list[tuple[int, int, int]]:
        """Entries, place of the chunks and place of the bitmap of every level."""
        at = int(self.segments[segment, 0])
        depth = int(np.frombuffer(self._read(at, 8), "<u8")[0])
        sizes = np.frombuffer(self._read(at + 8, 8 * depth), "<u8")
        at, out = at + 8 + 8 * depth, []
        for n in map(int, sizes):
            blocks = -(-(-(-n // 8)) // (RANK_BITS // 8))
            out.append((n, at, at + n))
            at += n + blocks * (RANK_BITS // 8) + 4 * blocks
        return out

    def token(self, i: int) -> int:
        """The id at position ``i`` of the file."""
        if not 0 <= i < self.total:
            raise IndexError(i)
        segment = int(np.searchsorted(self.firsts, i, "right")) - 1
        j, value = i - int(self.firsts[segment]), 0
        for depth, (n, chunks, bitmap) in enumerate(self._levels(segment)):
            value |= self._read(chunks + j, 1)[0] << (8 * depth)
            block, inside = divmod(j, RANK_BITS)
            bits = int.from_bytes(self._read(bitmap + block * (RANK_BITS // 8), RANK_BITS // 8), "little")
            if not bits >> inside & 1:
                return value
            blocks = -(-(-(-n // 8)) // (RANK_BITS // 8))
            directory = bitmap + blocks * (RANK_BITS // 8)
            before = int(np.frombuffer(self._read(directory + 4 * block, 4), "<u4")[0])
            j = before + (bits & ((1 << inside) - 1)).bit_count()
        raise ValueError("an id continues beyond the last level")

    def segment(self, k: int) -> np.ndarray:
        """All ids of segment ``k``."""
        parts = []
        for n, chunks, bitmap in self._levels(k):
            data = np.frombuffer(self._read(chunks, n), np.uint8)
            parts.append((data, np.frombuffer(self._read(bitmap, -(-n // 8)), np.uint8)))
        return decode_levels(parts)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """Id, start and id pieces of every document in file order; one or two segments are in memory."""
        ends = np.concatenate([self.starts[1:], [self.total]]) if len(self.starts) else []
        held, k, first = np.zeros(0, np.uint32), -1, 0
        for i, (start, end) in enumerate(zip(self.starts, ends)):
            pieces, at = [], int(start)
            while at < end:
                while k < 0 or at >= first + len(held):
                    k += 1
                    held, first = self.segment(k), int(self.firsts[k])
                upto = min(int(end), first + len(held))
                pieces.append(held[at - first : upto - first])
                at = upto
            yield None if self.null[i] else int(self.doc_ids[i]), int(start), pieces


MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, leading_space: bool = False, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one file per range of ids; returns the manifest.

    Files cover disjoint id ranges in ascending order: shard, path, n_docs, n_tokens, first_token. A null text is empty, a
    null id sorts first, rows with equal ids are ordered by text. Other columns are ignored. Each attempt of a task writes
    a file of its own and the manifest names only those of committed tasks, so lost executors leave no trace in the result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token_files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shape = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(source):
        from pyspark import TaskContext

        cache, out, path = token_cache(tokenizer, leading_space), None, ""
        for batch in batches(source, 256):
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                path = f"{root}/{uuid.uuid4().hex}.dac"
                sink = store.open_output_stream(path)
                out = TokenWriter(sink)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), cache.encode(texts(batch))):
                out.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
        if out is not None:
            out.close()
            sink.close()
            yield rows_of(shape, [[TaskContext.get().partitionId()], [path.rsplit("/", 1)[1]], [len(out.doc_ids)], [out.total]])

    manifest = materialize(ordered.mapInArrow(write, MANIFEST))
    # one row per file, whatever the size of the corpus; a file holds a whole range partition
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns(
        {"path": F.concat(F.lit(f"{folder}/"), "path"), "first_token": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))}
    )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of the ids of every document, from the files."""
    files = max(1, manifest.count())

    def read(source):
        for batch in source:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                store, root = fs.FileSystem.from_uri(path)
                with store.open_input_file(root) as handle:
                    rows: list[list] = [[], [], [], []]
                    for doc_id, start, pieces in TokenFile(handle).documents():
                        crc = n = 0
                        for ids in pieces:
                            crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                        for column, value in zip(rows, (doc_id, base + start, n, crc)):
                            column.append(value)
                        if len(rows[0]) == 4096:
                            yield rows_of(DIGEST, rows)
                            rows = [[], [], [], []]
                    yield rows_of(DIGEST, rows)

    spread = manifest.select("path", "first_token").repartition(files)
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
