"""Connected components by alternating large-star and small-star steps; nothing but two numbers a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

#: The two steps together need about log2(n)^2 rounds at worst; a run beyond this is an error, not an answer.
MOST_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). large: each node's larger neighbours move to its least neighbour; else its smaller ones and itself do."""
    near = edges.union(edges.select("b", "a")) if large else edges
    near = near.toDF("u", "v")
    # Written, so that both sides of the join are exchanged afresh and adaptive execution can split a hub's edges.
    least = shared_table(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    moved = near.join(least, "u")
    moved = moved.filter("v > u").select("v", "m") if large else moved.select("v", "m").union(least.select("u", "m"))
    return moved.toDF("a", "b").filter("a > b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), two long columns; component is the least node reachable.

    Null ends and loops are ignored; an empty table gives none; repeated edges count once. Each round is written to the shared
    folder. The rounds end when a round changes no edge."""
    now = shared_table(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = state
        now = shared_table(_star(_star(now, True), False), "edges")
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
