"""Shared pieces of the training-data operators: word rules, tables in the shared folder, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Rows up to which a per-group table may be broadcast; beyond it a shuffle join takes over.
BROADCAST_ROWS = 20_000


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), and an error on a
    cluster, whose machines would each write to a disk of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='chronoreel-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a plan cut that survives lost executors. drop() deletes the table when
    nothing reads it any more, clear() all tables of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.chronoreel_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete materialized tables that no plan needs any more."""
    for t in tables:
        _delete(t.sparkSession, t.chronoreel_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has materialized; results not yet read need them."""
    _delete(spark, shared_dir(spark))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a materialized df for broadcast if it is counted to have at most BROADCAST_ROWS rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int = 16) -> DataFrame:
    """Add, in the global order, totals over the rows before each row (exclusive) without one task seeing all rows.

    Range partitions are numbered and written, their totals summed (at most parts rows), and each partition adds the totals before it.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialize(df.repartitionByRange(max(parts, int(n)), *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    offsets = offsets.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(offsets), "__part")
    return rows.withColumns({k: F.col(k) + F.col(f"__{k}") for k in sums}).drop("__part", *(f"__{k}" for k in sums))


def unit(seed: str, *cols: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns, the same on every engine and in every run."""
    key = F.concat_ws("/", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(2**48)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
