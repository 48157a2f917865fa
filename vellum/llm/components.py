"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Each round is written to the shared folder; only a checksum goes to the driver. Rounds grow with the logarithm of
    the longest path. Nodes with most links are split by a salt.
    """
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = C.materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, F.col("v") > F.col("u"))
        e = C.materialize(_star(e, F.lit(True)), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def _star(edges: DataFrame, which) -> DataFrame:
    """Links each u's chosen neighbours to the smallest of u and its neighbours, as (larger, smaller)."""
    least = C.materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    rows = C.attach(edges, least, ["u"], "n", F.col("v"))
    out = rows.where(which).select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
    return out.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct()
