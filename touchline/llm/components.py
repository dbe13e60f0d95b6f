"""Connected components over edge tables, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): the root is the component's smallest node.

    Each round hangs larger neighbours on the smallest one, first the larger ones of every node, then the
    smaller ones; stars are what stays. Every round is written out, so lineage stays short and lost executors cost one round at most.
    Only a count and a checksum reach the driver. Neighbours are never gathered: a hub's edges meet its minimum in a join,
    which adaptive execution splits. No edges give no rows.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    current = materialize(oriented(edges))
    before = state(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(oriented(large))
        least = current.groupBy("a").agg(F.min("b").alias("m"))
        small = current.join(least, "a")
        current = materialize(oriented(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))))
        after = state(current)
        if after == before:
            break
        before = after
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
