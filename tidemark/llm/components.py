"""Connected components over edges, by rounds of star contraction on Spark.

A round hangs every node's larger neighbours, then its smaller ones, onto its smallest neighbour.
Edges become stars around each component's smallest node after a number of rounds that grows with
the logarithm of the longest path.  Each round is written to the shared folder, which ends lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

MAX_ROUNDS = 64


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has bigint columns a and b; gives (node, root) of every node that isn't its component's smallest."""
    now = written(_links(edges))
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = written(_links(_small_star(_links(_large_star(now)))))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
