"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunesift.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): every node that has an edge, with the least node it reaches.

    ``edges`` has long columns ``a`` and ``b`` (any direction, repeats and
    self-loops allowed; null ends are ignored).  Every round links a node's
    larger neighbours, then its smaller ones, to its least neighbour.  Minima
    are partial aggregates and go back by joins that adaptive execution can
    split, so a hub's edges never meet in one task.  Rounds grow with the
    logarithm of the longest path; each is stored, which cuts the lineage.
    """
    a, b = F.col("a"), F.col("b")

    def turned(e):
        return e.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    edges = stored(turned(edges), "cc")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: neighbours above a node go to the least node around it
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = stored(turned(large), "cc")
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = stored(turned(small.union(least.select("a", F.col("m").alias("b")))), "cc")
        new = _state(edges)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(a.alias("node"), b.alias("root")).union(
        edges.select(b.alias("node"), b.alias("root")).distinct())
