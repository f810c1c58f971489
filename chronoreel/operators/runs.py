"""Run-length and sample-table operators: run encoding and expansion, sample times, offsets and chunk look-ups.

All work per track (or the partition columns given) and never across, so they scale with the number of tracks; windows are ordered by a
full key. Null values form runs of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(part: list, order: list):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def exclusive_sum(value: Column, part: list, order: list) -> Column:
    """Sum over the rows before each row of its partition; 0 for the first."""
    return F.coalesce(F.sum(value).over(_before(part, order)), F.lit(0))


def rle_encode(df: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of consecutive equal values: part, run (from 0), value, count."""
    w = Window.partitionBy(*part).orderBy(*order)
    first = F.row_number().over(w) == 1
    starts = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long")
    marked = df.withColumn("__s", starts).withColumn("run", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*part, "run").agg(F.first(value).alias("value"), F.count("*").alias("count"))


def rle_split(runs: DataFrame, part: list[str], most: int = 256) -> DataFrame:
    """Runs cut into records of at most most values each, as one count byte can say."""
    pieces = F.sequence(F.lit(0), F.floor((F.col("count") - 1) / most).cast("int"))
    cut = runs.withColumn("piece", F.explode(pieces))
    return cut.select(*part, "run", "piece", "value", F.least(F.lit(most), F.col("count") - F.col("piece") * most).cast("long").alias("count"))


def rle_expand(runs: DataFrame) -> DataFrame:
    """One row per value again: n counts inside the run from 0."""
    return runs.where("count > 0").withColumn("n", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))))


def sample_times(runs: DataFrame) -> DataFrame:
    """Sample-duration runs (track_id, run, count, duration) to samples: sample_no from 0 and pts, by prefix sums over runs only."""
    starts = runs.where("count > 0").select(
        "track_id", "run", "count", "duration",
        exclusive_sum(F.col("count"), ["track_id"], ["run"]).alias("sample0"), exclusive_sum(F.col("count") * F.col("duration"), ["track_id"], ["run"]).alias("pts0"),
    )
    one = rle_expand(starts)
    return one.select("track_id", "run", (F.col("sample0") + F.col("n")).alias("sample_no"), (F.col("pts0") + F.col("n") * F.col("duration")).alias("pts"), "duration")


def total_duration(runs: DataFrame) -> DataFrame:
    return runs.groupBy("track_id").agg(F.sum("count").alias("samples"), F.sum(F.col("count") * F.col("duration")).alias("ticks"))


def sample_offsets(samples: DataFrame, part: list[str], order: list[str], size: str = "size") -> DataFrame:
    """Byte offset of each sample inside its chunk: the sizes before it."""
    return samples.withColumn("offset", exclusive_sum(F.col(size), part, order))


def chunk_runs(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """For each (track_id, chunk) the run that covers it: the last one with first_chunk <= chunk. One sort per track, no range join."""
    both = chunks.select("track_id", "chunk", F.lit(1).alias("what"), F.lit(None).cast("struct<first_chunk:bigint,samples:bigint>").alias("r")).unionByName(
        runs.select("track_id", F.col("first_chunk").cast("long").alias("chunk"), F.lit(0).alias("what"), F.struct(F.col("first_chunk").cast("long").alias("first_chunk"), F.col("samples").cast("long").alias("samples")).alias("r"))
    )
    w = Window.partitionBy("track_id").orderBy("chunk", "what").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("r", F.last("r", ignorenulls=True).over(w)).where("what = 1").select("track_id", "chunk", "r.first_chunk", "r.samples")


def composition_runs(packets: DataFrame) -> DataFrame:
    """Composition offsets (pts less the sum of durations before) as runs."""
    est = exclusive_sum(F.col("duration"), ["track_id"], ["frame_no"])
    return rle_encode(packets.withColumn("offset", F.col("pts") - est), ["track_id"], ["frame_no"], "offset")


def sync_flags(samples: DataFrame, sync: DataFrame) -> DataFrame:
    """key flag by 1-based membership in the sync table (track_id, sample_no_1); tracks without an entry are all key."""
    marked = samples.join(sync.select("track_id", (F.col("sample_no_1") - 1).cast("long").alias("sample_no"), F.lit(True).alias("__k")).distinct(), ["track_id", "sample_no"], "left")
    has = sync.select("track_id", F.lit(True).alias("__t")).distinct()
    return marked.join(has, "track_id", "left").withColumn("key", F.col("__k").isNotNull() | F.col("__t").isNull()).drop("__k", "__t")


def byte_counts(texts: DataFrame) -> DataFrame:
    """value, count of every byte of the UTF-8 form of the first column, unchanged; values that never come have no row. Each batch is
    counted to at most 256 rows before they meet."""
    name = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = np.zeros(256, np.int64)
            for text in b.column(0).drop_null():
                seen += np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["value", "count"])

    some = texts.select(F.col(name).cast("binary").alias(name)).mapInArrow(run, "value int, count long")
    return some.groupBy("value").agg(F.sum("count").alias("count"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("count"))


def dictionary_codes(df: DataFrame, part: list[str], value: str, most: int = 255) -> DataFrame:
    """Codes by falling count (ties by value); values past most codes get the escape code most."""
    counts = df.groupBy(*part, value).agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("count"), value)) - 1
    return counts.withColumn("code", F.least(F.lit(most), rank).cast("long"))


def mode_first(df: DataFrame, part: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each part; of equals the one that reached the count first."""
    w = Window.partitionBy(*part, value).orderBy(*order)
    seen = df.where(F.col(value).isNotNull()).withColumn("__c", F.row_number().over(w))
    best = F.max_by(value, F.struct(F.col("__c"), *[-F.col(o) for o in order]))
    return seen.groupBy(*part).agg(best.alias("mode"), F.max(F.col("__c").cast("long")).alias("count"))
