"""Connected components of links that may have hubs, without collecting any.

Alternating large-star and small-star steps: each step replaces links by links
to the least neighbour, until every component is a star around its least
member. Minima are partial aggregates, and a hub's links meet its minimum in a
join whose hot side the optimizer may split. Each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 200) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the least node.

    The rounds needed grow with the logarithm of the number of nodes; more than
    ``rounds`` are an error and not a result."""
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state = _state(edges)
    for i in range(1, rounds + 1):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = scratch.put(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links didn't settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
