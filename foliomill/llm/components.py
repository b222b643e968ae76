"""Connected components by alternating large-star and small-star steps, as joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node that has an edge (a, b); the label is the smallest node it reaches.

    Each round's edges go to the shared folder, so the plan stays short and lost executors cost one round. Minima are
    aggregated before the shuffle, and rows meet them by joins that split skewed keys: a hub is never one task's work.
    """
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:  # the number of rounds grows with the logarithm of a chain's length
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        nxt = scratch.keep(small.select("e.a", "e.b").where("a <> b").distinct())
        scratch.drop(now, large)
        now = nxt
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(heads)
