"""Exact removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes are told apart only through their first ``least`` bytes, by most-significant-digit passes: after the last pass, groups
of equal suffixes are the repeated windows. Two things keep the passes small.

- The first digit of a window is the ``GRAM`` bytes at its anchor, the place in the window where the hash of ``GRAM`` bytes is
  smallest (leftmost of equals). The anchor depends on the window's bytes alone, so equal windows have equal first digits, and
  neighbouring windows mostly share their anchor: one row per run of windows replaces about eighty suffixes.
- A group of one needs no further pass. After the first pass only anchors met elsewhere are left. The second digit is the whole
  stretch of bytes that a run covers: where all stretches of a group, or two of them, are equal, their windows repeat. Only the
  stretches left over, those at the ends of a shared passage, are compared window by window in the last pass.

The result is exact: no window is judged by a sample or a hash of less than 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, rows_of, text_column, texts

LEAST = 200
GRAM = 32
SEGMENT = 1 << 20  # window starts handled at once
LOCAL_GROUP = 2000  # stretches of a group that one task compares; larger groups are compared through a shuffle of windows
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256).astype(np.uint64)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at every place, by doubling."""
    h, width = _BYTE[data], 1
    for step in _STEP[: GRAM.bit_length() - 1]:
        h = h[: len(h) - width] * step + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * _STEP[0]
    return h ^ (h >> np.uint64(29))


def runs(data: bytes, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor digit, first byte and length of every stretch: a run of windows with one anchor. Stretches overlap."""
    whole = np.frombuffer(data, np.uint8)
    places = least - GRAM + 1
    low = np.uint64((1 << 21) - 1)
    for start in range(0, len(whole) - least + 1, SEGMENT):
        hashes = gram_hashes(whole[start : start + SEGMENT + least - 1])
        packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= places:
            packed = np.minimum(packed[: len(packed) - width], packed[width:])
            width *= 2
        if rest := places - width:
            packed = np.minimum(packed[: len(packed) - rest], packed[rest:])
        anchors = (packed & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchors) - 1]])
        yield hashes[anchors[first]], start + first, last - first + least


_RUNS = pa.schema([("g", pa.int64()), ("ctx", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("size", pa.int32())])


def _anchors(rows: DataFrame, least: int) -> DataFrame:
    def scan(source):
        for batch in batches(source, 256):
            columns: list[list] = [[], [], [], [], []]
            for row, text in zip(batch.column("row").to_pylist(), texts(batch)):
                data = text.encode()
                for g, lo, size in runs(data, least):
                    ends = (lo + size).tolist()
                    ctx = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(lo.tolist(), ends)], np.uint64)
                    for column, part in zip(columns, (g.view(np.int64), ctx.view(np.int64), np.full(len(g), row), lo, size)):
                        column.append(part)
            if columns[0]:
                yield rows_of(_RUNS, [np.concatenate(c) for c in columns])

    return rows.select("row", "text").mapInArrow(scan, "g long, ctx long, row long, lo long, size int")


def _packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The rows with their text as a zstd frame, for joins that move whole texts."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(source):
        packer = zstd.ZstdCompressor(level=3)
        for batch in batches(source, 256):
            frames = pa.array([packer.compress(t.encode()) for t in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], frames], names=[*keep, "packed"])

    return rows.select(*keep, "text").mapInArrow(run, f"{fields}, packed binary")


_CONTEXT = pa.schema(
    [("g", pa.int64()), ("stretches", pa.int64()), ("times", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())]
)
_CONTEXT_DDL = "g long, stretches long, times long, row long, lo long, bytes binary"
_SPANS = pa.schema([("row", pa.int64()), ("lo", pa.int64()), ("size", pa.int32()), ("ctx", pa.int64())])
_SPANS_DDL = "row long, lo long, size int, ctx long"


def compare(stretches: list[tuple[int, int, int, bytes]], least: int) -> Iterator[tuple[int, int, int]]:
    """Last pass inside one group: (row, first byte, length) of the repeated parts of stretches that occur once.

    ``stretches``: times, row, first byte and bytes of the different stretches of a group.
    """
    count: dict[bytes, int] = {}
    for times, _, _, data in stretches:
        for j in range(len(data) - least + 1):
            window = data[j : j + least]
            count[window] = count.get(window, 0) + times
    for times, row, lo, data in stretches:
        if times == 1:
            yield from _joined(row, lo, [j for j in range(len(data) - least + 1) if count[data[j : j + least]] > 1], least)


def _joined(row: int, lo: int, starts: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    i = 0
    while i < len(starts):
        k = i
        while k + 1 < len(starts) and starts[k + 1] == starts[k] + 1:
            k += 1
        yield row, lo + starts[i], starts[k] - starts[i] + least
        i = k + 1


def _resolve(stretches: DataFrame, least: int) -> DataFrame:
    """Repeated parts of the stretches that occur once, in groups with several different stretches."""

    def local(source):
        held, group, out = [], None, [[], [], []]

        def finish():
            for found in compare(held, least):
                for column, value in zip(out, found):
                    column.append(value)

        for batch in batches(source, 4096):
            for g, times, row, lo, data in zip(*(batch.column(n).to_pylist() for n in ("g", "times", "row", "lo", "bytes"))):
                if g != group:
                    finish()
                    held, group = [], g
                held.append((times, row, lo, data))
            if out[0]:
                yield rows_of(_SPANS, [*out, [None] * len(out[0])])
                out = [[], [], []]
        finish()
        yield rows_of(_SPANS, [*out, [None] * len(out[0])])

    shape = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("times", pa.int64()), ("row", pa.int64()), ("lo", pa.int64())])

    def windows(source):
        for batch in batches(source, 64):
            columns: list[list] = [[], [], [], [], []]
            for times, row, lo, data in zip(*(batch.column(n).to_pylist() for n in ("times", "row", "lo", "bytes"))):
                for j in range(len(data) - least + 1):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(data[j : j + least]), ">i8")
                    for column, value in zip(columns, (int(digest[0]), int(digest[1]), times, row, lo + j)):
                        column.append(value)
            yield rows_of(shape, columns)

    small = stretches.filter(F.col("stretches") <= LOCAL_GROUP)
    found = small.repartition("g").sortWithinPartitions("g").mapInArrow(local, _SPANS_DDL)
    large = stretches.filter(F.col("stretches") > LOCAL_GROUP)
    if large.isEmpty():
        return found
    # a group without bound is never in one task: its windows are counted, with partial counts before the shuffle
    exploded = materialize(large.mapInArrow(windows, "high long, low long, times long, row long, lo long"))
    twice = exploded.groupBy("high", "low").agg(F.sum("times").alias("n")).filter(F.col("n") > 1).select("high", "low")
    ones = exploded.filter(F.col("times") == 1).join(twice, ["high", "low"])
    return found.unionByName(ones.select("row", "lo", F.lit(least).cast("int").alias("size"), F.lit(None).cast("long").alias("ctx")))


def repeated_spans(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """row and spans (lo, size, ctx) of the repeated windows; ``rows`` has row and text. Spans may overlap.

    ``ctx`` is the hash of the span's bytes where the span is a whole stretch.
    """
    anchors = materialize(_anchors(rows, least))
    groups = anchors.groupBy("g").agg(F.count("*").alias("n"), (F.min("ctx") == F.max("ctx")).alias("alike")).filter(F.col("n") > 1)
    # written first: a join of two plain exchanges is one whose large partitions Spark splits, and a common phrase is one group
    second = materialize(anchors.join(materialize(groups.select("g", "alike")), "g"))
    apart = second.filter(~F.col("alike"))
    kinds = apart.groupBy("g", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("row", "lo", "size")).alias("at"))
    kinds = materialize(kinds.select("g", "ctx", "times", "at.*"))
    several = kinds.filter(F.col("times") > 1).select("g", "ctx")
    whole = second.filter("alike").select("row", "lo", "size", "ctx").unionByName(apart.join(several, ["g", "ctx"]).select("row", "lo", "size", "ctx"))
    counts = kinds.groupBy("g").agg(F.count("*").alias("stretches"), F.min("times").alias("least"))
    # groups all of whose stretches repeat need no last pass
    asked = kinds.join(counts.filter(F.col("least") == 1).select("g", "stretches"), "g")
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("g", "stretches", "times", "lo", "size")).alias("asked"))

    def fetch(source):
        unpack = zstd.ZstdDecompressor()
        for batch in batches(source, 64):
            columns: list[list] = [[] for _ in _CONTEXT]
            for row, packed, wanted in zip(*(batch.column(n).to_pylist() for n in ("row", "packed", "asked"))):
                data = unpack.decompress(packed)
                for r in wanted:
                    for column, value in zip(columns, (r["g"], r["stretches"], r["times"], row, r["lo"], data[r["lo"] : r["lo"] + r["size"]])):
                        column.append(value)
            yield rows_of(_CONTEXT, columns)

    moved = _packed(rows, ["row"]).join(asked, "row").select("row", "packed", "asked")
    # repeated rows have one key; the stretches of one are enough
    stretches = materialize(moved.mapInArrow(fetch, _CONTEXT_DDL)).dropDuplicates(["g", "row", "lo"])
    parts = _resolve(materialize(stretches), least)
    # as a set: repeated rows have one key and tell the same spans
    return whole.unionByName(parts).groupBy("row").agg(F.collect_set(F.struct("lo", "size", "ctx")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (first byte, end) of the bytes covered; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_ADDED = pa.schema(
    [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)


def remove_repeats(docs: DataFrame, least: int = LEAST, with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` but text, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    Every byte covered by a ``least``-byte string of the UTF-8 text that also starts elsewhere, in the same or another row, is
    removed; strings are judged on the input. A null text is empty. Repeated rows repeat each other. ``kept_text`` leaves out
    characters that a removal cut through. Columns with the names of results are replaced; equal ids with other texts are
    told apart by the text.
    """
    own = [c for c in docs.columns if c not in {"text", "row", "packed", "spans", *_ADDED.names}]
    rows = docs.select(*own, text_column().alias("text"))
    rows = rows.withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    spans = materialize(repeated_spans(rows.select("row", "text"), least))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in own)
    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"

    def cut(source):
        unpack = zstd.ZstdDecompressor()
        for batch in batches(source, 256):
            columns: list[list] = [[] for _ in _ADDED]
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
                data = unpack.decompress(packed)
                # a span of another row with the same key would not have these bytes
                mine = [(s["lo"], s["lo"] + s["size"]) for s in found or [] if s["ctx"] is None or np.uint64(xxhash.xxh3_64_intdigest(data[s["lo"] : s["lo"] + s["size"]])).astype(np.int64) == s["ctx"]]
                gone, kept, at = merged(mine), [], 0
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                rest = b"".join(kept)
                values = (len(data), len(data) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if with_text else None)
                for column, value in zip(columns, values):
                    column.append(value)
            told = rows_of(_ADDED, columns)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in own], *told.columns], names=[*own, *_ADDED.names])

    joined = _packed(rows, [*own, "row"]).join(spans, "row", "left").select(*own, "packed", "spans")
    out = joined.mapInArrow(cut, f"{fields}, {added}")
    return out if with_text else out.drop("kept_text")
