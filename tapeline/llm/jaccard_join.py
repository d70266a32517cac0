"""Links between documents whose sets of word shingles have a Jaccard similarity of at least 0.9, and their components.

The join works on groups of similar documents and a token-group matrix.

1. Documents with the same set are one node from the start.
2. Similar documents come together by partitioned signatures. Two sets of sizes a <= b that link differ in at most
   (a + b) / 19 shingles, so if the shingles are dealt by hash into one part more than that, one part is equal in both; with
   some parts more, one that is not empty. Sets of similar size deal alike, so linked sets share a signature: no link is lost.
3. In every signature bucket the members are compared with one hub (the member that shares most), which is linear in the
   bucket. Linked members form components; most buckets then lie inside one component and are done.
4. In all other buckets the sketches of the members are compared, in rounds that skip what is connected by then. A sketch counts a set's shingles in cells dealt by hash; two
   sketches never differ by more than the sets do, so pairs that differ too much have no link, and sets that have only a
   passage in common part here without their texts. Hubs are compared by sketch first, too.
5. What may still link is partitioned into groups of similar documents: those that such pairs connect, of about the same
   size, at most about ``GROUP`` in a group. A group keeps the union of its shingles and, as a token-group matrix, which
   members have each. A document can link with a member only if at least 0.9 of its shingles are in the union; groups
   below that bound stay closed. In an opened group the matrix gives the overlap with every member at once.

Sets are taken from whole texts each time they are needed; what is shuffled are hashes, sketches and, for documents that may
link, texts.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import _LOWER, batches, materialize, rows_of, text_column, texts
from tapeline.llm.components import components

WORDS = 3
PERCENT = 90
GROUP = 256  # documents in a group
FIRST = 4  # buckets of a document that are compared before all of them are
GROWTH = 8  # how many times as many documents the sections of a bucket hold from round to round
CELLS = 16  # the fewest cells of a sketch
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sets of hashed word shingles of whole texts; hashes of words are kept up to ``limit`` words."""

    def __init__(self, words: int = WORDS, limit: int = 200_000):
        self.words, self.limit, self.known = words, limit, {}

    def word_hashes(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) > self.limit:
            self.known = {}
        return out

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingles; with fewer words than a shingle has, the whole sequence is one; without words none."""
        h, k = self.word_hashes(text), self.words
        if not len(h):
            return h
        if len(h) < k:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
        n = len(h) - k + 1
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = mixed(total * _MIX[0] + h[i : i + n] + _MIX[2])
        return np.unique(total)


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of the set, signed."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 11))))


@cache
def size_classes(percent: int) -> tuple[list[int], list[int], list[int]]:
    """Lower ends of the size classes, the parts dealt in each scheme and how many of them may be empty.

    Scheme s serves sets of class s and the larger ones they may link with. Classes are a few times the tolerance wide, fewer
    where the tolerance is large, since the parts of the smallest sets of a class would else hold too few shingles.
    """
    ends, parts, spare, ratio = [1], [], [], (percent / 100) ** (3 if percent >= 90 else 1.5)
    while ends[-1] < 1 << 40:
        least = ends[-1]
        ends.append(max(least + 1, int(least / ratio)))
        most = ends[-1] - 1
        larger = most * 100 // percent
        n = (most + larger) * (100 - percent) // (100 + percent) + 1
        empty = 0
        for _ in range(50):  # as many empty parts as the smallest sets rarely exceed
            mean = (n + empty) * math.exp(-least / (n + empty))
            wanted = math.ceil(mean + 4 * math.sqrt(mean)) if mean > 1e-6 else 0
            if wanted <= empty or wanted > n:
                break
            empty = wanted
        parts.append(n + empty)
        spare.append(empty)
    return ends, parts, spare


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set: of the parts in its own scheme and, where a set of the class below may link, in that scheme.

    A set with no more empty parts than the scheme allows for does not sign them: more parts than that are equal in both sets of
    a link, so one of them is not empty. Only if both sets have more empty parts may all equal parts be empty; those sign all.
    """
    ends, parts, spare = size_classes(percent)
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    own, out = int(np.searchsorted(ends, n, "right")) - 1, []
    schemes = [own]
    if own and (ends[own] - 1) * 100 >= percent * n:
        schemes.append(own - 1)
    for s in schemes:
        if parts[s] > 1:  # with one part only equal sets link
            sums = np.zeros(parts[s], np.uint64)
            dealt = ((shingles >> np.uint64(20)) % np.uint64(parts[s])).astype(np.int64)
            np.add.at(sums, dealt, mixed(shingles))
            signed = mixed(mixed(sums + _MIX[3]) + np.arange(parts[s], dtype=np.uint64) * _MIX[4] + np.uint64(s * int(_MIX[0]) % (1 << 64)))
            full = np.bincount(dealt, minlength=parts[s]) > 0
            out.append(signed[full] if parts[s] - full.sum() <= spare[s] else signed)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = int(np.isin(a, b, assume_unique=True).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each cell, at most 255: two to four a cell, a power of two of cells."""
    cells = max(CELLS, 1 << (max(len(shingles) - 1, 0) // 4).bit_length())
    counts = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows with the number of cells of the shortest."""
    cells = min(map(len, sketches))
    return np.stack([np.frombuffer(s, np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.int32) for s in sketches])


def may_link(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link with one: sketches differ by no more than the sets, and linked sets differ in a bounded share."""
    return (100 + percent) * np.abs(others - one).sum(axis=1) <= (100 - percent) * (size + sizes)


def _documents(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row, n_shingles, node (null for empty sets) and sketch of every row."""
    shape = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(source):
        shingler = Shingler(words)
        for batch in batches(source, 256):
            sets = [shingler.shingles(t) for t in texts(batch)]
            yield rows_of(shape, [batch.column("doc_id"), batch.column("row"), [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets], [sketch(s) if len(s) else None for s in sets]])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, node long, sketch binary")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """sig and node of every set, once for the equal sets of a task."""
    shape = pa.schema([("sig", pa.int64()), ("node", pa.int64())])

    def run(source):
        shingler, seen = Shingler(words), set()
        for batch in batches(source, 256):
            nodes, sigs = [], [np.zeros(0, np.int64)]
            for shingles in map(shingler.shingles, texts(batch)):
                if len(shingles) and (node := node_of(shingles)) not in seen:
                    seen.add(node)
                    signed = signatures(shingles, percent)
                    sigs.append(signed)
                    nodes.append(np.full(len(signed), node, np.int64))
            yield rows_of(shape, [np.concatenate(sigs), np.concatenate(nodes or sigs)])

    return docs.mapInArrow(run, "sig long, node long")


def _texts_of(docs: DataFrame, members: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and text of one document per node of ``nodes``; written once."""
    shape = pa.schema([("node", pa.int64()), ("text", pa.string())])
    one = materialize(members.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")))

    def run(source):
        shingler = Shingler(words)
        for batch in batches(source, 512):
            whole, nodes = texts(batch), batch.column("node").to_pylist()
            mine = [i for i, t in enumerate(whole) if len(s := shingler.shingles(t)) and node_of(s) == nodes[i]]
            yield rows_of(shape, [[nodes[i] for i in mine], [whole[i] for i in mine]])

    # rows of one key bring all their texts; the set's name tells which is meant
    found = docs.join(one, "row").select("node", "text").mapInArrow(run, "node long, text string")
    return materialize(found).dropDuplicates(["node"])


def _near(pairs: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that may link by their sketches."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        for batch in batches(source, 2048):
            rows: list[list] = [[], []]
            for a, b, m, n, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "m", "n", "left", "right"))):
                one, other = folded([left, right])
                if may_link(one, m, other[None], np.array([n]), percent)[0]:
                    rows[0].append(a)
                    rows[1].append(b)
            yield rows_of(shape, rows)

    both = pairs.join(shapes.toDF("a", "m", "left"), "a").join(shapes.toDF("b", "n", "right"), "b")
    return both.select("a", "b", "m", "n", "left", "right").mapInArrow(run, "a long, b long")


def near_edges(members: list[tuple[int, int, int, int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """Edges that connect whatever blobs are connected by pairs of different components that may link: fewer than there are blobs.

    ``members``: side (as in ``open_groups``), node, component, blob, size and sketch. Members of a blob are connected already.
    """
    cells = folded([m[5] for m in members])
    side, node, component, size = (np.array([m[i] for m in members], np.int64) for i in (0, 1, 2, 4))
    blob = np.unique(np.array([m[3] for m in members], np.int64), return_inverse=True)[1]
    group = np.flatnonzero(side > 0)
    cells_of, size_of, component_of, blob_of = cells[group], size[group], component[group], blob[group]
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for i in np.flatnonzero(side != 1).tolist():
        meant = (component_of != component[i]) & (blob_of != blob[i])
        for j in group[may_link(cells[i], size[i], cells_of, size_of, percent) & meant].tolist():
            a, b = find(int(blob[i])), find(int(blob[j]))
            if a != b:
                root[a] = b
                out.append((int(node[i]), int(node[j])))
    return out


def _near_in_buckets(rows: DataFrame, shapes: DataFrame, percent: int) -> DataFrame | None:
    """node and blob of the members of buckets that may link, None if none may; ``rows``: sig, node, component.

    A blob is what pairs that may link connect. Buckets with the same members are one. Comparing all groups of a large bucket
    at once would find the same connections once for every two groups, so blobs are found in rounds: first every node in its
    ``FIRST`` largest buckets only, then all buckets, each cut at random into sections of about ``GROUP`` members and, round by round,
    ``GROWTH`` times as many, until a section is the whole bucket. A round compares only what earlier ones have not
    connected, so it adds edges in proportion to the members. The last round meets every pair of different blobs.
    """
    h = F.xxhash64("node")
    sets = rows.groupBy("sig").agg(F.count("*").alias("all"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, "node")).alias("y"))
    sets = materialize(sets.groupBy("all", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "all"))
    kept = rows.join(sets, "sig")
    most = sets.agg(F.max("all")).first()[0]
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("all"), "sig"))
    own = kept.withColumn("nth", nth).filter(F.col("nth") <= FIRST).drop("nth")
    rounds, seen = [(own, GROUP)], 0
    while seen < most:
        now = GROUP if not seen else seen * GROWTH
        rounds.append((kept.filter(F.col("all") > seen), now))  # smaller buckets have been compared whole
        seen = now
    blobs = None
    for i, (part, most) in enumerate(rounds):
        section = F.pmod(F.xxhash64("node", F.lit(i)), F.ceil(F.col("all") / most))
        told = part.withColumn("key", F.xxhash64("sig", section))
        told = told.withColumn("blob", F.col("node")) if blobs is None else told.join(blobs, "node", "left").withColumn("blob", F.coalesce("blob", "node"))
        edges = materialize(_near_in_sections(told.select("key", "node", "component", "blob"), shapes, percent))
        if not edges.isEmpty():
            every = edges if blobs is None else edges.unionByName(blobs.toDF("a", "b"))
            blobs = components(every).select("node", F.col("component").alias("blob"))
    return blobs


def _near_in_sections(rows: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the blobs of every section that may link; ``rows``: key, node, component and blob.

    A section without two blobs or two components has nothing to find. The members of its largest blob are dealt into groups of about
    ``GROUP``, the others likewise; the others' groups meet each other and those of the blob, which do not meet each other. So a
    task holds the sketches of two groups whatever the size of the section.
    """
    counts = rows.groupBy("key", "blob").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "blob")).alias("top"), F.sum("n").alias("all"), F.min("low").alias("low"), F.max("high").alias("high"))
    rest = F.col("all") - F.col("top.n")
    tops = tops.filter((rest > 0) & (F.col("low") != F.col("high")))
    tops = materialize(tops.select("key", "all", F.col("top.blob").alias("main"), F.ceil(F.col("top.n") / GROUP).alias("n_main"), F.ceil(rest / GROUP).alias("n_rest")))
    inside = F.col("blob") == F.col("main")
    at = F.pmod(F.xxhash64("node"), F.when(inside, F.col("n_main")).otherwise(F.col("n_rest")))
    unit = lambda side, *names: F.struct(F.xxhash64("key", *names).alias("unit"), side.cast("int").alias("side"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    shown = F.transform(every("n_rest"), lambda k: unit(F.lit(1), F.lit("main"), at, k))
    asking = F.transform(every("n_main"), lambda k: unit(F.lit(0), F.lit("main"), k, at))
    among = F.transform(every("n_rest"), lambda k: unit(F.when(at == k, 2).when(at < k, 0).otherwise(1), F.lit("rest"), F.least(at, k), F.greatest(at, k)))
    met = F.when(F.col("all") <= 2 * GROUP, F.array(unit(F.lit(2)))).when(inside, shown).otherwise(F.concat(asking, among))
    units = rows.join(tops, "key").select("node", "component", "blob", F.explode(met).alias("u")).select("node", "component", "blob", "u.*")
    shown = units.join(shapes, "node").select("unit", "side", "node", "component", "blob", "size", "sketch")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        unit, held = None, []
        for batch in batches(source, 4096):
            edges: list[tuple[int, int]] = []
            for key, *member in zip(*(batch.column(n).to_pylist() for n in ("unit", "side", "node", "component", "blob", "size", "sketch"))):
                if key != unit:
                    if held:
                        edges += near_edges(held, percent)
                    unit, held = key, []
                held.append(member)
            yield rows_of(shape, [[a for a, _ in edges], [b for _, b in edges]])
        edges = near_edges(held, percent) if held else []
        yield rows_of(shape, [[a for a, _ in edges], [b for _, b in edges]])

    return shown.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def _links(pairs: DataFrame, whole: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, from the texts of both."""
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        shingler, kept = Shingler(words), {}
        for batch in batches(source, 256):
            rows: list[list] = [[], []]
            for a, b, left, right in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "left", "right"))):
                if a not in kept:
                    kept = {a: shingler.shingles(left)} if len(kept) > 8 else kept | {a: shingler.shingles(left)}
                if linked(kept[a], shingler.shingles(right), percent):
                    rows[0].append(a)
                    rows[1].append(b)
            yield rows_of(shape, rows)

    right = pairs.join(whole.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    both = right.join(whole.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def open_groups(members: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components: at most one fewer than there are components.

    ``members``: side (0 query, 1 group, 2 both), component and set. Side 1 and 2 are the group that the queries meet.
    """
    group = [(c, s) for side, c, s in members if side > 0]
    if not group:
        return []
    owner = np.repeat(np.arange(len(group)), [len(s) for _, s in group])
    tokens = np.concatenate([s for _, s in group])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = np.array([len(s) for _, s in group])
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for side, component, query in members:
        if side == 1:
            continue
        low, high = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
        if 100 * int((high > low).sum()) < percent * len(query):
            continue  # closed: too few of the query's shingles are in the union
        runs = high - low
        cells = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        shared = np.bincount(owner[cells], minlength=len(group))
        for k in np.flatnonzero(100 * shared >= percent * (len(query) + sizes - shared)):
            a, b = find(component), find(group[k][0])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((component, group[k][0]))
    return out


def _group_links(rows: DataFrame, whole: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components; ``rows``: blob, node, component and size of the documents to compare.

    Sets that link are of one size class or of two neighbouring ones. Every class of a blob is dealt into groups of about
    ``GROUP`` documents by hash, and each group meets the others of its own and the next class, so a task holds two groups
    whatever the size of the blob, and a blob that fits one group moves at most three times.
    """
    classed = rows.withColumn("s", F.floor(F.log(F.col("size")) / (math.log(100 / percent) * 1.001)))
    dealt = classed.groupBy("blob", "s").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.lit(1)).alias("n"))
    dealt = materialize(dealt)
    beside = lambda shift, name: dealt.select("blob", (F.col("s") + shift).alias("s"), F.col("n").alias(name))
    placed = classed.join(dealt, ["blob", "s"]).join(beside(-1, "above"), ["blob", "s"], "left").join(beside(1, "below"), ["blob", "s"], "left")
    placed = placed.withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")))

    def meetings(count: str, low, i, high, j, side) -> Column:
        every = F.when(F.col(count).isNotNull(), F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(every, lambda k: F.struct(F.xxhash64("blob", low, i(k), high, j(k)).alias("unit"), side(k).alias("side")))

    s, own = F.col("s"), F.col("i")
    within = meetings("n", s, lambda k: F.least(own, k), s, lambda k: F.greatest(own, k), lambda k: F.when(own == k, 2).when(own < k, 0).otherwise(1))
    upward = meetings("above", s, lambda k: own, s + 1, lambda k: k, lambda k: F.lit(0))
    downward = meetings("below", s - 1, lambda k: k, s, lambda k: own, lambda k: F.lit(1))
    units = placed.select("node", "component", F.explode(F.concat(within, upward, downward)).alias("u")).select("node", "component", "u.*")
    # a meeting without two components has nothing to find
    useful = units.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") != F.col("high")).select("unit")
    met = units.join(useful, "unit").join(whole, "node").select("unit", "side", "component", "text")
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source):
        shingler, unit, held = Shingler(words), None, []
        for batch in batches(source, 256):
            links: list[tuple[int, int]] = []
            for key, side, component, text in zip(*(batch.column(n).to_pylist() for n in ("unit", "side", "component", "text"))):
                if key != unit:
                    links += open_groups(held, percent)
                    unit, held = key, []
                held.append((side, component, shingler.shingles(text)))
            yield rows_of(shape, [[a for a, _ in links], [b for _, b in links]])
        links = open_groups(held, percent)
        yield rows_of(shape, [[a for a, _ in links], [b for _, b in links]])

    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A-Z count as a-z, words are runs of characters other than ASCII white space. Empty sets (null, empty or blank texts) link
    with nothing and are their own component. Repeated rows come out as often as they came in; a row without id gets the
    smallest id of its component, or null. Other columns are ignored. Components are over the exact links; pairs are not
    listed, as groups of copies have too many.
    """
    return _labelled(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of every component: that with the smallest doc_id, all columns kept. Repeated rows become one.

    Rows without id stay where their component has no id. Of equal smallest ids with different texts one stays.
    """
    group = F.struct(F.coalesce("component", "row"), F.col("component").isNull().alias("empty"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = _labelled(docs, words, percent).groupBy(group.alias("_group")).agg(first.alias("_row")).select("_row").distinct()
    keyed = docs.withColumn("_row", _row_key())
    return keyed.join(materialize(kept), "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text_column())


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row, n_shingles, component (null for empty sets) and component_id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row"), text_column().alias("text"))
    members = materialize(_documents(slim, words))
    # signatures are not kept but taken from the texts again, and dealt once for the buckets and for the rows in them
    sigs = _signed(slim, words, percent).repartition("sig")
    # equal documents have the same node and signatures, so a bucket matters if two of its nodes differ
    buckets = sigs.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter(F.col("low") != F.col("high"))
    inside = materialize(sigs.join(buckets.select("sig"), "sig").distinct())
    found = _components(slim.select("row", "text"), members, inside, words, percent)
    labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.filter(F.col("node").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("_least"))
    return labelled.join(least, "component", "left").select("doc_id", "row", "n_shingles", "component", F.coalesce("_least", "doc_id").alias("component_id"))


def _components(slim: DataFrame, members: DataFrame, inside: DataFrame, words: int, percent: int) -> DataFrame:
    """node and component of the nodes that link with another."""
    sizes = inside.groupBy("sig").agg(F.count("*").alias("size"))
    weights = inside.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = inside.join(weights, "node").groupBy("sig").agg(F.max(F.struct("weight", "node"))["node"].alias("a"))
    beside = materialize(inside.join(hubs, "sig").filter(F.col("a") != F.col("node")).select("sig", "a", "node"))
    signed = members.join(inside.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    shapes = materialize(signed.select("node", F.col("n_shingles").alias("size"), "sketch"))
    star = materialize(_near(beside.select("a", F.col("node").alias("b")).distinct(), shapes, percent))
    whole = _texts_of(slim, members, star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))), words)
    links = materialize(_links(star, whole, words, percent))
    first = components(links)
    # hubs are settled; buckets whose other members are of several components may hold further links
    marked = beside.join(first, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    mixed_buckets = lambda rows: rows.join(
        rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") != F.col("high")).select("sig"), "sig"
    )
    open_ = materialize(mixed_buckets(marked))
    if open_.isEmpty():
        return first
    blobs = _near_in_buckets(open_, shapes, percent)
    if blobs is None:
        return first
    named = blobs.join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "blob")
    rows = materialize(named.join(shapes.select("node", "size"), "node"))
    whole = _texts_of(slim, members, rows, words)
    more = materialize(_group_links(rows, whole, words, percent))
    if more.isEmpty():
        return first
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    alone = joined.select(F.col("component").alias("node"), "component").join(first, "node", "left_anti")
    every = first.unionByName(alone).join(joined, "component", "left")
    return every.select("node", F.coalesce("_whole", "component").alias("component"))
