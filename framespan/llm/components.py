"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespan.llm.storage import Workspace


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(work: Workspace, links: DataFrame) -> DataFrame:
    """From links (a, b) of any orderable type: one row (node, root) for each node that has a link to another.

    ``root`` is the least node of the component. Both steps only take minima and join on
    nodes, so a node with very many links is summed before the shuffle and its join can be
    split; every round is written to the shared folder. Self links and nulls are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = work.write(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = work.write(large, "large")
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(parent.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, work.write(small, "small")
        work.drop(before)
        work.drop(large)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(rooted.select(F.col("root").alias("node"), "root").distinct())
