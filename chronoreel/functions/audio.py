"""Audio kernels: mixing, downmixing and re-blocking of sample rows and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mix_levels(levels: Column) -> Column:
    """Levels (-1 to 1) of one sample mixed: their sum less their product where there are several, clipped."""
    total = F.aggregate(levels, F.lit(0.0), lambda s, x: s + x)
    product = F.aggregate(levels, F.lit(1.0), lambda s, x: s * x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.size(levels) > 1, total - product).otherwise(total)))


def interleave(left: Column, right: Column) -> Column:
    """Two channels as one array; the missing end of the shorter is silence."""
    return F.flatten(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda z: F.array(F.coalesce(z["l"], F.lit(0)), F.coalesce(z["r"], F.lit(0)))))


def channel(samples: Column, which: int, of: int) -> Column:
    return F.filter(samples, lambda _, i: i % of == which)


def from24(x: Column) -> Column:
    """24-bit samples to 16."""
    return F.shiftright(x, 8)


def reblock(blocks: DataFrame, part: str, order: str, samples: str, n: int) -> DataFrame:
    """Arrays of samples dealt anew into blocks of n (the last may be shorter): part, block, samples."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.size(samples)).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("__b", before).select(part, "__b", F.posexplode(samples).alias("__i", "v")).withColumn("pos", F.col("__b") + F.col("__i"))
    grouped = rows.groupBy(part, F.floor(F.col("pos") / n).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s"))
    return grouped.select(part, "block", F.transform("s", lambda x: x["v"]).alias("samples"))
