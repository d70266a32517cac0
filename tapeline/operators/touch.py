"""First later row of a series that reaches a level.

A tree of extremes is climbed and descended with equi joins: an event looks at the later rows of its own block, then at
the later blocks of its own super-block, and so on; the first block that reaches the level is opened again. The tree
is as high as the longest series needs, so every join returns at most ``fan`` candidates per event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize

FAN = 128


def _reached(level_up: str, level_down: str, strict: bool) -> Column:
    high, low, up, down = F.col("_max"), F.col("_min"), F.col(level_up), F.col(level_down)
    over, under = (high > up, low < down) if strict else (high >= up, low <= down)
    return F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False))


def first_touch(
    events: DataFrame,
    rows: DataFrame,
    event_id: Sequence[str],
    pos: str,
    up: str,
    down: str,
    high: str,
    low: str,
    keys: Sequence[str] = ("symbol",),
    row_pos: str = "_pos",
    out: str = "touch_pos",
    strict: bool = False,
    fan: int = FAN,
) -> DataFrame:
    """Add ``out``: position of the first row after ``pos`` with ``high >= up`` or ``low <= down``, else null.

    Null levels never match. ``event_id`` names columns that identify an event.
    """
    keys = list(keys)
    whole = list(dict.fromkeys([*keys, *event_id]))
    longest = rows.agg(F.max(F.abs(row_pos))).first()[0] or 0
    top = 1
    while fan ** (top + 1) <= longest:
        top += 1
    leaf = rows.select(*keys, F.col(row_pos).alias("_i0"), F.col(high).alias("_max"), F.col(low).alias("_min"))
    nodes = [leaf.withColumn("_i1", F.floor(F.col("_i0") / fan))]
    for depth in range(1, top + 1):
        blocks = nodes[-1].groupBy(*keys, f"_i{depth}").agg(F.max("_max").alias("_max"), F.min("_min").alias("_min"))
        nodes.append(blocks.withColumn(f"_i{depth + 1}", F.floor(F.col(f"_i{depth}") / fan)))

    base = events.select(*dict.fromkeys([*whole, pos, up, down]))
    waiting = base.withColumns({f"_c{d}": F.floor(F.col(pos) / fan**d).cast("long") for d in range(top + 1)})
    hits = []
    for depth, tree in enumerate(nodes):
        tree = tree.withColumnRenamed(f"_i{depth}", "_node")
        if depth < top:
            joined = waiting.join(tree.withColumnRenamed(f"_i{depth + 1}", f"_c{depth + 1}"), [*keys, f"_c{depth + 1}"])
        else:
            joined = waiting.join(tree.drop(f"_i{depth + 1}"), keys)
        later = joined.filter((F.col("_node") > F.col(f"_c{depth}")) & _reached(up, down, strict))
        hits.append(later.groupBy(*whole).agg(F.min("_node").alias("_node")))
        if depth < top:
            # read when climbing on and when descending, and by every higher level; the join is the dearest step
            hits[-1] = materialize(hits[-1])
            waiting = waiting.join(hits[-1].select(*whole), whole, "left_anti")

    current = hits[top]
    for depth in range(top, 0, -1):
        opened = current.join(base, whole).withColumnRenamed("_node", f"_i{depth}")
        children = nodes[depth - 1].withColumnRenamed(f"_i{depth - 1}", "_node")
        inside = opened.join(children, [*keys, f"_i{depth}"]).filter(_reached(up, down, strict))
        deeper = inside.groupBy(*whole).agg(F.min("_node").alias("_node"))
        current = deeper.unionByName(hits[depth - 1])
    return events.join(current.withColumnRenamed("_node", out), whole, "left")
