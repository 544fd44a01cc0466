"""Distributed connected components by alternating large and small stars.

Edges are kept as (node, smaller node).  A large star links every larger
neighbour of a node to the least node in its neighbourhood, a small star does
so for the smaller neighbours; alternating them ends, after a number of rounds
that grows with the logarithm of the component's size, with each node linked to
the least node of its component.  Minima are taken by partial aggregation, so
the star around a hot node meets in no single task.  The minima are written
before they are joined back: with plain exchanges on both sides Spark can split
the join of a hot node, which it can't while one side is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, saved

#: Rounds after which something is wrong with the input or this code.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` has (a, b) with a > b; so has the result, which reads a saved
    table that comes with it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = saved(least.select("u", F.least("u", "m").alias("m")), "components-least")
    # Only larger neighbours move: edges (v, u) with v > u, that is, b = u.
    moved = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))
    return moved.filter("a <> b").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = saved(edges.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    moved = (
        edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        .filter("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges``, whose first two columns
    are the ends, of one orderable type.  The component is its least node.
    Loops and edges with a null end are left out."""
    x, y = edges.columns[:2]
    state = saved(
        edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y"))
        .filter("x is not null and y is not null and a <> b")
        .select("a", "b")
        .distinct(),
        "components",
    )
    before = None
    for _ in range(MOST_ROUNDS):
        # The state is final when it stays as it was; rows are compared by
        # count and by the sum of their hashes.
        now = state.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before or now[0] == 0:
            break
        before = now
        larger, used = _large_star(state)
        smaller, also_used = _small_star(larger)
        after = saved(smaller, "components")
        discard(state, used, also_used)
        state = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
