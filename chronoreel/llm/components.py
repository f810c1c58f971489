"""Connected components of an edge table, by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (id, component), component being the least id reachable; ids without an edge do not appear.

    Each step is a minimum per node (summed on the map side) and a join back, whose hot nodes the adaptive planner splits.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_star_forest(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, large = now, materialize(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = materialize(small.where("a <> b").distinct())
        drop(old, large)
    heads = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each a has one b and no b is an a: then every b is its component's least id."""
    ends = edges.select("a", F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up")))
    per_id = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return per_id.where("ups > 1 or (ups = 1 and n > 1)").isEmpty()
