"""Prefix sums over a whole table in a global order, without sending it through one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir. Where that is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronoreel-"))
    return df.checkpoint()


def global_prefix_sums(df: DataFrame, order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """Add, under each name, the sum of its value over all rows before, in the order of order (which must be a unique key).

    Range partitions are numbered; their sums, one row each, are added up; each partition adds what lies before it. The numbering is a
    checkpoint, so calling this runs a job that writes the table's rows to the checkpoint folder.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut_lineage(df.withColumns({f"__v_{k}": v for k, v in values.items()}).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*(F.sum(f"__v_{k}").alias(f"__sum_{k}") for k in values))
    sums = sums.select("__part", *(F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in values))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({k: F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) for k in values}).join(F.broadcast(sums), "__part")
    return out.withColumns({k: F.col(k) + F.col(f"__base_{k}") for k in values}).drop("__part", *(f"__{x}_{k}" for k in values for x in ("v", "base")))


def global_prefix_sum(df: DataFrame, order: list[Column | str], value: Column, name: str, first: int = 0) -> DataFrame:
    """global_prefix_sums() of one value, beginning at first."""
    return global_prefix_sums(df, order, {name: value}).withColumn(name, F.col(name) + first)
