"""Exact fractions as struct<num, den> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rational(num: Column, den: Column) -> Column:
    return F.struct(num.cast("long").alias("num"), den.cast("long").alias("den"))


def gcd(a: Column, b: Column, steps: int = 64) -> Column:
    """Greatest common divisor by Euclid's steps (64 do for numbers under 2**44)."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def reduce(r: Column) -> Column:
    g = gcd(r["num"], r["den"])
    return F.when(g > 0, rational(r["num"] / g, r["den"] / g)).otherwise(r)


def plus(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] + b["num"] * a["den"], a["den"] * b["den"])


def minus(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"] - b["num"] * a["den"], a["den"] * b["den"])


def times(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["num"], a["den"] * b["den"])


def over(a: Column, b: Column) -> Column:
    return rational(a["num"] * b["den"], a["den"] * b["num"])


def flip(a: Column) -> Column:
    return rational(a["den"], a["num"])


def less(a: Column, b: Column) -> Column:
    """By cross product, for positive denominators."""
    return a["num"] * b["den"] < b["num"] * a["den"]


def same(a: Column, b: Column) -> Column:
    return a["num"] * b["den"] == b["num"] * a["den"]


def parse(text: Column) -> Column:
    """n, n:d or n/d; null for anything else."""
    good = text.rlike(r"^-?[0-9]+([:/][0-9]+)?$")
    den = F.nullif(F.regexp_extract(text, r"[:/]([0-9]+)$", 1), F.lit(""))
    return F.when(good, rational(F.regexp_extract(text, r"^(-?[0-9]+)", 1).try_cast("long"), F.coalesce(den, F.lit("1")).try_cast("long")))


def rescale(value: Column, old: int, new: int) -> Column:
    """Ticks of 1/old second as ticks of 1/new second, truncating."""
    return ((value * new - value * new % old) / old).cast("long")
