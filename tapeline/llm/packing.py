"""Packing documents into training sequences as a cutting-stock problem solved by column generation.

A document's tokens are cut into full sequences and a tail. Only the histogram of tail lengths (in classes of ``GRAIN``
tokens, so at most ``capacity / GRAIN`` numbers whatever the corpus) reaches the driver. There a linear program over
patterns, ways to fill one sequence with classes, is solved: the restricted program is kept as a basis, an unbounded
knapsack over the dual prices finds the pattern with the best reduced cost, and the basis changes until none improves.
The fractional solution is rounded, what is left is packed the same way by hand, and every class gets an ordered list
of places. Pieces are ranked within their class and the piece of rank r takes place r.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, rows_of, text_column, texts, token_cache

CAPACITY = 2048
GRAIN = 8
END_ID = 1
RANK_ROWS = 8192  # pieces per ranking window, on average


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of items of highest price whose sizes fit, as counts per item."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")  # sizes ascend
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := fits[room]:
            gain = prices[:k] + value[room - sizes[:k]]
            at = int(gain.argmax())
            if gain[at] > value[room] + 1e-12:
                value[room], choice[room] = gain[at], at
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(value[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and fractional multiplicities that cover ``demand`` with the fewest sequences.

    Revised simplex over the columns found so far: the basis starts with one pattern per class that repeats the class. The
    search ends when no pattern has a better reduced cost, or when the objective is within ``gap`` of a lower bound (the
    tokens over the capacity, or the objective over the best pattern's price). Every basis covers the demand exactly.
    """
    m = len(sizes)
    repeat = capacity // sizes
    patterns = np.diag(repeat).astype(float)
    inverse = np.diag(1.0 / repeat)
    amounts = demand / repeat
    least, step = float(demand @ sizes) / capacity, 0
    while amounts.sum() > (1 + gap) * least:
        prices = inverse.sum(axis=0)  # every column costs one sequence
        value, column = best_pattern(prices, sizes, capacity)
        least = max(least, amounts.sum() / value)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        patterns[leave] = column
        amounts = amounts - ratios[leave] * direction
        amounts[leave] = ratios[leave]
        amounts = np.maximum(amounts, 0)
        row = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, row)
        inverse[leave] = row
        step += 1
        if step % 500 == 0:  # wipe out rounding noise
            inverse = np.linalg.inv(patterns.T)
            amounts = np.maximum(inverse @ demand, 0)
    return patterns.astype(np.int64), amounts


def rounded(patterns: np.ndarray, amounts: np.ndarray, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Whole multiplicities: floors, then single uses by falling fraction where all items are still there, then a greedy fill
    of the rest, at most about one sequence per class."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[int, np.ndarray]] = []
    for pattern, amount in zip(patterns, amounts):
        used = pattern > 0
        times = min(int(amount + 1e-6), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times:
            out.append((times, pattern))
            left -= times * pattern
    for k in np.argsort(-(amounts % 1), kind="stable"):
        if amounts[k] % 1 > 0.05 and patterns[k].any() and (left >= patterns[k]).all():
            out.append((1, patterns[k]))
            left -= patterns[k]
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            take = min(int(left[k]), room // int(sizes[k]))
            pattern[k], room = take, room - take * int(sizes[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((times, pattern))
        left -= times * pattern
    return out


@dataclass(frozen=True)
class Plan:
    """For every class the ends of its runs of places, and what a run consists of: first sequence, pieces per sequence and
    place of the first of them. Size: patterns x classes in a pattern, at most a few thousand rows for any corpus."""

    ends: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    per: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    sequences: int

    def locate(self, kind: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order within it of the pieces of class ``kind`` with these ranks."""
        ends = self.ends[kind]
        run = np.searchsorted(ends, ranks, "right")
        inside = ranks - np.concatenate([[0], ends[:-1]])[run]
        copy, nth = np.divmod(inside, self.per[kind][run])
        return self.first[kind][run] + copy, self.place[kind][run] + nth


def solve(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> Plan:
    """``histogram``: pieces by class; class c has pieces of (c - 1) * grain + 1 to c * grain tokens."""
    classes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    full = -(-capacity // grain)
    demand = np.array([histogram[c] for c in classes], np.int64)
    uses: list[tuple[int, np.ndarray]] = []
    inner = classes < full
    if inner.any():
        sizes, wanted = classes[inner], demand[inner]
        patterns, amounts = column_generation(sizes, wanted.astype(float), capacity // grain)
        for times, pattern in rounded(patterns, amounts, sizes, wanted, capacity // grain):
            uses.append((times, np.append(pattern, 0) if not inner.all() else pattern))
    if not inner.all():
        uses.append((int(demand[-1]), np.append(np.zeros(inner.sum(), np.int64), 1)))
    runs: dict[int, list] = {int(c): [] for c in classes}
    sequence = 0
    for times, pattern in uses:
        place = 0
        for k in np.flatnonzero(pattern):
            runs[int(classes[k])].append((times * int(pattern[k]), sequence, int(pattern[k]), place))
            place += int(pattern[k])
        sequence += times
    table = {c: np.array(r, np.int64).reshape(-1, 4) for c, r in runs.items()}
    return Plan(
        {c: np.cumsum(t[:, 0]) for c, t in table.items()}, {c: t[:, 1] for c, t in table.items()}, {c: t[:, 2] for c, t in table.items()},
        {c: t[:, 3] for c, t in table.items()}, sequence,
    )


PIECES = "doc_id long, piece_key long, start long, length long, doc_tokens long, ids_crc32 long"


def cut(docs: DataFrame, tokenizer: str, leading_space: bool = True, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: full ones and a tail per document; ids, if asked for, as little-endian unsigned 32-bit.

    ``piece_key`` numbers the rows of a task, so that equal rows are dealt apart.
    """
    kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
    shape = pa.schema(list(zip(("doc_id", "piece_key", "start", "length", "doc_tokens", "ids_crc32", "ids"), kinds)))

    def run(source):
        cache, number = token_cache(tokenizer, leading_space), 0
        for batch in batches(source, 128):
            rows: list[list] = [[] for _ in shape]
            whole = texts(batch)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), cache.encode(whole)):
                ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
                number += 1
                for start in range(0, len(ids), capacity):
                    data = ids[start : start + capacity].tobytes()
                    for column, value in zip(rows, (doc_id, number, start, len(data) // 4, len(ids), zlib.crc32(data), data)):
                        column.append(value)
            yield rows_of(shape, rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, leading_space: bool = True, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = True) -> DataFrame:
    """Place every piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids.

    A null text is the empty document (its end id alone). Repeated rows are documents of their own. A sequence holds at most
    ``capacity`` tokens; padding is what its pieces leave over. Other columns are ignored.

    Length classes are hot keys (copies, full pieces), so ranks are taken in parts of about ``RANK_ROWS`` rows: one window
    per (class, part) and a running sum over the counts of the parts.
    """
    pieces = materialize(cut(docs, tokenizer, leading_space, capacity, with_ids=with_ids))
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    plan = solve(histogram, capacity, grain)
    parts = max(1, sum(histogram.values()) // RANK_ROWS)
    salted = classed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece_key", "start"), F.lit(parts)))
    counts = materialize(salted.groupBy("_class", "_part").agg(F.count("*").alias("_n")))
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "piece_key"))
    slim = [c for c in salted.columns if c != "piece_key"]
    ranked = salted.withColumn("_rank", inside).join(offsets, ["_class", "_part"])
    ranked = ranked.select(*slim, (F.col("_before") + F.col("_rank") - 1).alias("_rank")).drop("_part")
    kept = [f for f in ranked.schema if not f.name.startswith("_")]
    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def place(source):
        for batch in source:
            kinds, ranks = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_class", "_rank"))
            sequence, order = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
            for kind in np.unique(kinds):
                mine = kinds == kind
                sequence[mine], order[mine] = plan.locate(int(kind), ranks[mine])
            columns = [batch.column(f.name) for f in kept] + [pa.array(sequence), pa.array(order)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["sequence_id", "_order"])

    placed = ranked.mapInArrow(place, f"{named}, sequence_id long, _order long")
    ahead = Window.partitionBy("sequence_id").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_order")
