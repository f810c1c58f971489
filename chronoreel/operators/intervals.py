"""Interval joins by time bins: a range condition becomes an equality on (key, bin), so that no track is a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs with a_start < b_end and a_end > b_start inside one key. left has a_start, a_end; right b_start, b_end, and key on both.

    Each interval goes to every bin of width ticks that it touches; a pair is kept only in the bin where its overlap begins, so it
    appears once. width should be near the usual length. how: inner, semi or anti (of left); rows alike in all columns, nulls included, share an
    answer. Empty intervals touch nothing.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.where("a_end > a_start").withColumn("__bin", bins("a_start", "a_end"))
    b = right.where("b_end > b_start").withColumn("__bin", bins("b_start", "b_end"))
    overlap = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    if how == "inner":
        return a.join(b, [key, "__bin"]).where(overlap & (F.floor(F.greatest("a_start", "b_start") / width) == F.col("__bin"))).drop("__bin")
    hit = a.join(b.select(key, "__bin", "b_start", "b_end"), [key, "__bin"]).where(overlap).select(*left.columns).distinct()
    same = reduce(lambda x, y: x & y, (left[c].eqNullSafe(hit[c]) for c in left.columns))
    return left.join(hit, same, "left_semi" if how == "semi" else "left_anti")
