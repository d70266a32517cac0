"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeline.llm.common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round links every node's larger neighbours to its smallest one, then every node's smaller ones. Edges stay as many as
    there were, no neighbourhood is collected, and each round is written to the shared folder. The number of rounds grows
    with the logarithm of the longest chain; it raises if it does not settle.
    """
    plain = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = _written(plain.distinct())
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, after = _written(down.select("a", F.col("m").alias("b")).unionByName(small).distinct())
        if after == seen:
            own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
        seen = after
    raise RuntimeError("the components have not settled")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their count and a digest that does not depend on their order."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("digest")))
    return out, (seen.get["n"], seen.get["digest"])
