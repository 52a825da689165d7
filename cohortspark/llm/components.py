"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.storage import Scratch


def _stars(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v) with v < u.

    Minima are written before they are joined, so that the joins read plain shuffles, in which a hub can be split.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("m")), "low")
    large = scratch.cut(both.join(low, F.col("u") == F.col("node")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionByName(low.filter("m < node").select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct(), "large")
    least = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "least")
    return (large.join(least, F.col("u") == F.col("node")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link; the label is the smallest node that can be reached.

    Each round is a written table, replaced by the next one; only its count and checksum reach the driver. A hub is summed to
    one row by ``min`` before it meets its links in a join, which adaptive execution can split. Links of a node with itself
    are ignored; repeated links change nothing. Ends when a round changes nothing: every node is then linked to its label.
    """
    first = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path, state = scratch.write(first, "links"), None
    while True:
        edges = scratch.read(path, first.schema)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        following = scratch.write(_stars(scratch, edges), "links")
        scratch.discard(path)
        path = following
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
