"""Connected components of links that are never brought to the driver or to one task.

Joins on a node that a large part of all links have are ordinary shuffled joins
followed by a shuffle on other keys, which Spark's skew handling may split.

Defined results: links with a null end and of a node with itself count for
nothing, repeated links and both directions once; nodes may be of any type with
an order; no links give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lookup, saved


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``links`` (a, b).

    First each node is tied to its least neighbour and its other links become
    links between those neighbours; that takes a hot node's many links away.
    What is left goes through alternating large and small stars, in which every
    minimum is pre-aggregated.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    ends = saved(ends, "links")
    tied = saved(ends.groupBy("u").agg(F.min("v").alias("p")), "tied")
    edges = saved(ends.join(tied, "u").where("v > p").select(F.col("v").alias("u"), F.col("p").alias("v")).distinct(), "edges")
    whole = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    # a node that was tied is itself a link of the rest wherever it is someone's neighbour
    first = edges
    edges = saved(edges.unionByName(tied.join(edges.select(F.explode(F.array("u", "v")).alias("u")).distinct().unionByName(tied.select(F.col("p").alias("u"))).distinct(), "u").select("u", F.col("p").alias("v"))).distinct(), "edges", first)
    state = whole(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "small-star", edges, large)
        if (now := whole(edges)) == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    roots = saved(roots.select(F.col("u").alias("p"), "root"), "roots", edges)
    # every node that is someone's lesser neighbour stands for itself too; the least root found for a node is right
    nodes = tied.select(F.col("u").alias("node"), "p").unionByName(ends.select(F.col("v").alias("node"), F.col("v").alias("p")).distinct())
    found = saved(lookup(nodes, roots, "p", "left").groupBy("node").agg(F.min(F.coalesce("root", "p")).alias("root")), "components")
    forget(ends, tied, roots)
    return found
