"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gaugeworks.llm.common import discard, materialise


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges written and read back, with their number and checksum, which are taken while they are written."""
    seen = Observation()
    both = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return both, (seen.get["n"], seen.get["sum"])


def connected_components(links: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node in links (u, v); component is the least node that can be reached. stars: an
    earlier result (node, component), whose links count too.

    Each round is two grouped minima and joins; edges end as stars around the least nodes, after rounds that grow with
    the logarithm of a component's size. The driver sees a count and a checksum. Links with a null end are none; an
    empty table has no nodes; repeated links and links of a node to itself change nothing."""
    edges = links.select("u", "v")
    if stars is not None:
        edges = edges.unionByName(stars.select(F.col("node").alias("u"), F.col("component").alias("v")))
    edges, before = _stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # in large, v < u always
        joined = large.join(least, "u")
        small = joined.select("v", "m").where("v <> m").toDF("u", "v").unionByName(least.toDF("u", "v"))
        old = edges
        edges, after = _stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(old)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
