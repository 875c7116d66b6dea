"""Connected components by alternating large-star and small-star rounds.

Each round is two joins and two aggregations over the edge table; the result of a
round is written to the shared folder, so lineage stays one round long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import Scratch


def spread(df: DataFrame, key: str, *aggregates) -> DataFrame:
    """``df`` aggregated by ``key``, dealt anew before a join on it.

    The second grouping column is a function of the first.  It changes no group, but
    the join then has an exchange of its own on both sides, so that adaptive
    execution can split the rows of a hot key.
    """
    return df.groupBy(key, F.xxhash64(key).alias("_spread")).agg(*aggregates).drop("_spread")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = spread(both, "a", F.min("b").alias("m"))
    out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return out.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = spread(edges, "a", F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    edges: columns a and b in any order and direction; loops and nulls are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(now, "edges")
    state = None
    for _ in range(rounds):
        after = scratch.keep(_small_star(_large_star(now)), "stars")
        scratch.discard(now)
        now = after
        total = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        if total == state:
            break
        state = total
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
