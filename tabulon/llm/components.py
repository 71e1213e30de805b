"""Connected components of an edge table: alternating large-star and small-star joins, and merging of known components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import sized, stored

#: Rows of an edge table that one task writes.
ROWS_PER_TASK = 200_000


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on (u, v): link neighbours of u to the smallest node around u."""
    least = F.least(F.min("v"), F.col("u")) if larger else F.min("v")
    hubs = edges.groupBy("u").agg(least.alias("m"))
    linked = edges.join(hubs, "u")
    if larger:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(hubs.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a leaf with one edge or a root; then no further step changes anything."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(edges.select(F.col("v").alias("x"), F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return each.where("leaf + root > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node reachable.

    Each step is an equi-join of a stored table with its own aggregate, so a hub with very many neighbours is a skewed join
    that Spark splits; nothing is collected but whether the edges are stars by now.
    """
    edges = stored(edges.where("a != b"), "cc-links")
    rows = edges.count()
    now = stored(sized(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows, ROWS_PER_TASK), "cc")
    while not _settled(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(sized(_star(both, True), rows, ROWS_PER_TASK), "cc-large")
        now = stored(sized(_star(large, False), rows, ROWS_PER_TASK), "cc-small")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after further links (a, b): whole components are joined by their labels, so only links between
    components are walked. Labels are the smallest nodes of their components, and stay so; nodes without a label are new."""
    known = labels.select(F.col("node").alias("a"), "label")
    def end(s):
        return F.coalesce(F.col(f"label_{s}"), F.col(s)).alias(s)
    between = (links.join(known.withColumnRenamed("label", "label_a"), "a", "left")
               .join(known.select(F.col("a").alias("b"), F.col("label").alias("label_b")), "b", "left").select(end("a"), end("b")))
    joined = components(between.where("a != b"))
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return old.union(joined.join(labels.select("node"), "node", "left_anti"))
