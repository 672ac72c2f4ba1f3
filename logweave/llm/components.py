"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import freeze


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node links its larger (or smaller) neighbours to its smallest one."""
    near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        near = near.filter("b < a")
    least = (near.groupBy("a").agg(F.min("b").alias("m"))
             .select("a", F.least("a", "m").alias("m")))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: numbers); component is its smallest node.

    Self links and null ends are ignored; repeated links count once; without
    links the result is empty. Each round is a few shuffles of the links, which
    become stars in a number of rounds that grows with the logarithm of their
    number. The links are checkpointed each round, so a lost executor costs one
    round.
    """
    now = freeze(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter("a <> b").distinct())
    seen = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(sums) or not sums[0]:
            break
        seen = tuple(sums)
        now = freeze(_stars(_stars(now, True), False))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
