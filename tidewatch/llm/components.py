"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the edges (a, b).

    Each step sends every edge's end to the smallest neighbour. The minimum of a node is a sum that combines before its shuffle and
    is joined back, so that a node with very many neighbours is never gathered in one task. Edges are written after each round.
    """

    def stars(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return both, large

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = down.join(least, F.col("u") == F.col("w"))
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = saved(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    now, before = state(current), None
    while now != before and now[0]:
        current = saved(small(stars(current)[1]), "edges")
        now, before = state(current), now
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) after further links (a, b). Only the graph of the components that they connect is looked at."""
    known = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    ends = links
    for end in ("a", "b"):
        ends = ends.join(known, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_component", end)).drop("_id", "_component")
    moved = components(ends).select(F.col("id").alias("_from"), F.col("component").alias("_to"))
    old = labels.join(moved, F.col("component") == F.col("_from"), "left").select("id", F.coalesce("_to", "component").alias("component"))
    new = moved.join(labels, F.col("_from") == F.col("id"), "left_anti").select(F.col("_from").alias("id"), F.col("_to").alias("component"))
    return saved(old.unionByName(new), "labels")
