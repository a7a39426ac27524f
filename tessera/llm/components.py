"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is written to the shared folder; a node's rows move by its id, and stars are built with
aggregates and joins only, so no neighbourhood is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node in an edge, root the smallest node of its component; edges: a, b (long)."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components-0")
    for k in range(1, rounds + 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"components-least-{k}")
        # large star: a node's larger neighbours, then small star: its smaller ones, meet its least
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = now.join(least, "a").select("b", "m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.where("a <> m").select("a", F.col("m").alias("b")))
        after = materialize(large.union(small).where("a <> b").distinct(), f"components-{k}")
        # a forest of stars: every left node once, no right node on the left
        discard(now, least)
        left = after.groupBy("a").count()
        if left.where("count > 1").limit(1).count() == 0 and after.join(after.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").limit(1).count() == 0:
            now = after
            break
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
