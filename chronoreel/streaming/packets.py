"""Streaming forms of the packet verbs.

Tumbling windows use event time and a watermark. Groups of pictures and bounded reordering keep state per track: only what the next
packet needs (the running group, or at most depth held frames), never a whole track.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import event_packets

REORDERED = "track_id long, event_id long, out_no long"


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events and bytes per window of event time; rows later than late behind the newest are left out, as a watermark means."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    size = F.floor(F.col("value") * 100 + 0.5).cast("long")
    out = stamped.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(size).alias("bytes"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "events", "bytes")


def gop_state(events: DataFrame) -> DataFrame:
    """Each packet with its group number in its track, counted as packets arrive in order."""
    rows = events.select(F.col("user_id").alias("track_id"), "event_id", (F.col("event_type") == "purchase").alias("key"))

    def step(_key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values("event_id")
        gop = n + pdf["key"].astype("int64").cumsum()
        state.update((int(gop.iloc[-1]),))
        yield pdf.assign(gop=gop)[["track_id", "event_id", "gop"]]

    return rows.groupBy("track_id").applyInPandasWithState(step, "track_id long, event_id long, gop long", "n long", "append", "NoTimeout")


def _shared(spark) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests), and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='chronoreel-')}"
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def reorder(events: DataFrame, depth: int = 7) -> DataFrame:
    """Packets released by least event_id from a buffer of depth a track; the last depth stay held, as a stream has no end.

    A shuffle doesn't keep the order of rows, so each micro-batch of a track is sorted together with what was held."""
    rows = events.select(F.col("user_id").alias("track_id"), "event_id")

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        seen = np.sort(np.concatenate([np.array(held, "int64"), *(pdf["event_id"].to_numpy("int64") for pdf in frames)]))
        out = seen[: max(0, len(seen) - depth)]
        state.update((seen[len(out) :].tolist(), n + len(out)))
        yield pd.DataFrame({"track_id": pd.array([key[0]] * len(out), "Int64"), "event_id": out, "out_no": np.arange(n, n + len(out))})

    return rows.groupBy("track_id").applyInPandasWithState(step, REORDERED, "held array<long>, n long", "append", "NoTimeout")


def reorder_all(events: DataFrame, depth: int = 7) -> DataFrame:
    """Every packet of what is there now by least event_id, the buffers of reorder() flushed when the input ends: the stream runs to its
    end into shared files; then one batch pass over its last state releases what is still held, numbered on from n."""
    spark = events.sparkSession
    top = _shared(spark)
    released = run_available(reorder(events, depth), top=top)
    state = spark.read.format("statestore").load(f"{top}/state")
    held = state.select(F.col("key.track_id").alias("track_id"), F.posexplode("value.groupState.held").alias("i", "event_id"), F.col("value.groupState.n").alias("n"))
    return released.unionByName(held.select("track_id", "event_id", (F.col("n") + F.col("i")).alias("out_no")))


def run_available(stream: DataFrame, mode: str = "append", top: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table of the shared folder, never through the driver.

    In complete mode every batch writes the whole result anew, and the last one's is returned. Checkpoints and results are under top."""
    spark = stream.sparkSession
    top = top or _shared(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{top}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{top}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{top}/out")
    batches = []

    def save(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{top}/out/{n}")
        batches.append(n)

    writer.foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out/{batches[-1]}") if batches else spark.createDataFrame([], stream.schema)


def read_events(spark, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")


def packets(spark, sf_dir: str) -> DataFrame:
    return event_packets(spark.read.parquet(f"{sf_dir}/events.parquet"))
