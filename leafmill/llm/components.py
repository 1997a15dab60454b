"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """edges: a > b, at most `most` of them, counted once both ways. Large: every larger neighbour of a node
    is tied to the least of its neighbourhood; small: every smaller neighbour and the node itself are."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = join_groups(both, least, "u", "n", most, F.concat_ws("-", "u", "v"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (long). One row per node that has an edge: node, root (the least node it reaches).

    Each round is cut by a checkpoint in the shared folder. It ends when a round changes nothing:
    then every node hangs on its root. Hubs are joined by the hot-group way, so none is gathered.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(x: DataFrame) -> tuple:
        r = x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    last = mark(now)
    for _ in range(rounds):
        # A large star has as many edges as before at most: its rows, both ways, bound those of both steps.
        most = 2 * last[0]
        now = cut(_star(cut(_star(now, True, most)), False, most))
        if (state := mark(now)) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        last = state
    raise RuntimeError("components did not settle")
