"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.session import release, stage

MAX_ROUNDS = 100


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node of (a, b) that is not the smallest of its component.

    Large and small stars in turn: each node hands its neighbours to the smallest of
    them, so a component folds into a star in a logarithmic number of rounds.  Minima
    are folded in each task before the shuffle, every round is a written table, and
    the driver sees a count and a checksum only.  Null ends and self links are ignored.
    """
    edges = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    edges, seen = stage(edges, "links"), None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now["n"], now["x"]) == seen or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (now["n"], now["x"])
        folded = stage(_small_star(_large_star(edges)), "links")
        release(edges)
        edges = folded
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m"))
    near = F.least("hub", "m").alias("v")
    return (
        both.where("v > u").join(least, F.col("u") == F.col("hub"))
        .select(F.col("v").alias("u"), near).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("hub"))
    up = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.union(least.select(F.col("hub").alias("u"), F.col("m").alias("v"))).distinct()
