"""Packet verbs: durations, groups of pictures, seeking, clipping, concatenating, merging and interleaving tracks.

Every verb is DataFrame to DataFrame and lazy; windows are per track and ordered by frame_no or (pts, event_id). Bytes need not be on
board: verbs use times and sizes only. Empty tables give empty results, null pts sort first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import global_prefix_sum, global_prefix_sums
from .runs import exclusive_sum


def track():
    return Window.partitionBy("track_id").orderBy("frame_no")


def up_to():
    return track().rowsBetween(Window.unboundedPreceding, 0)


def durations(packets: DataFrame, default: int = 3003) -> DataFrame:
    """duration = next pts - pts; the last packet repeats the one before it, a single packet gets default."""
    step = F.lead("pts").over(track()) - F.col("pts")
    return packets.withColumn("__d", step).withColumn("duration", F.coalesce("__d", F.lag("__d").over(track()), F.lit(default)).cast("long")).drop("__d")


def durations_last_one(packets: DataFrame) -> DataFrame:
    """duration = next pts - pts; 1 for the last."""
    return packets.withColumn("duration", F.coalesce(F.lead("pts").over(track()) - F.col("pts"), F.lit(1)).cast("long"))


def last_key(packets: DataFrame) -> DataFrame:
    """key_frame: the last key frame at or before each packet; the first frame where there is none yet."""
    return packets.withColumn("key_frame", F.coalesce(F.max(F.when(F.col("key"), F.col("frame_no"))).over(up_to()), F.lit(0)).cast("long"))


def gop_ids(packets: DataFrame) -> DataFrame:
    """gop: running count of key frames (0 before the first)."""
    return packets.withColumn("gop", F.sum(F.col("key").cast("long")).over(up_to()))


def gop_summary(packets: DataFrame) -> DataFrame:
    return gop_ids(packets).groupBy("track_id", "gop").agg(
        F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.min("pts").alias("first_pts"), (F.max("pts") - F.min("pts")).alias("span")
    )


def track_meta(packets: DataFrame) -> DataFrame:
    return packets.groupBy("track_id").agg(
        F.count("*").alias("frames"), F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"), F.sum(F.col("key").cast("long")).alias("keys"), F.sum("size").alias("bytes")
    )


def clip(packets: DataFrame, start: int, end: int) -> DataFrame:
    """Frames from the start of start's group of pictures up to end (excluded), with frame_no and pts counted anew."""
    keyed = last_key(packets).where(F.col("frame_no") < end)
    first = F.max(F.when(F.col("frame_no") == start, F.col("key_frame"))).over(Window.partitionBy("track_id"))
    kept = keyed.withColumn("__first", first).where("frame_no >= __first").drop("__first", "key_frame")
    return kept.withColumns({"clip_frame": F.col("frame_no") - F.min("frame_no").over(Window.partitionBy("track_id")), "clip_pts": F.col("pts") - F.first("pts").over(track())})


def seek(packets: DataFrame, points: DataFrame) -> DataFrame:
    """For each (track_id, at) the last packet with pts <= at and its key frame; null before the first. One sort per track."""
    rows = last_key(packets).select("track_id", F.col("pts").alias("at"), F.lit(0).alias("what"), F.struct("frame_no", "pts", "key_frame").alias("p"))
    asked = points.select("track_id", "at", F.lit(1).alias("what"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"))
    w = Window.partitionBy("track_id").orderBy("at", "what", F.col("p.frame_no")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(asked).withColumn("p", F.last("p", ignorenulls=True).over(w)).where("what = 1").select("track_id", "at", "p.frame_no", "p.pts", "p.key_frame")


def limit_frames(packets: DataFrame, n: int) -> DataFrame:
    return packets.where(F.col("frame_no") < n)


def skip_frames(packets: DataFrame, n: int) -> DataFrame:
    return packets.where(F.col("frame_no") >= n)


def display_order(packets: DataFrame) -> DataFrame:
    """display_no by pts (ties by decode order) and the duration to the next shown frame (null for the last)."""
    w = Window.partitionBy("track_id").orderBy("pts", "frame_no")
    return packets.withColumns({"display_no": (F.row_number().over(w) - 1).cast("long"), "duration": F.lead("pts").over(w) - F.col("pts")})


def reorder_bounded(packets: DataFrame, depth: int = 7) -> DataFrame:
    """Release order of a buffer of depth frames that always lets the least pts go: equal to display order where no frame is more than depth late.

    A frame of the buffer leaves when the buffer is full, so its place depends on all before it: the heap is carried through each track's
    packets in order, batch by batch, so a track of any length takes memory for depth frames. pts and frame_no must not be null.
    """
    import heapq

    import pyarrow as pa

    def run(batches):
        at, heap, n, out = None, [], 0, []

        def leave():
            nonlocal n
            pts, no = heapq.heappop(heap)
            out.append((at, no, pts, n))
            n += 1

        def batch():
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["track_id", "frame_no", "pts", "out_no"])

        for b in batches:
            for track_id, no, pts in zip(*(b.column(c).to_pylist() for c in ("track_id", "frame_no", "pts")), strict=True):
                if track_id != at:
                    while heap:
                        leave()
                    at, n = track_id, 0
                heapq.heappush(heap, (pts, no))
                if len(heap) > depth:
                    leave()
            yield batch()
        while heap:
            leave()
        yield batch()

    rows = packets.select(*(F.col(c).cast("long") for c in ("track_id", "frame_no", "pts")))
    return rows.repartition("track_id").sortWithinPartitions("track_id", "frame_no").mapInArrow(run, "track_id long, frame_no long, pts long, out_no long")


def copy_durations(packets: DataFrame, ahead: int = 7) -> DataFrame:
    """duration: the least positive gap to the pts of the next ahead packets; null where there is none."""
    later = F.collect_list("pts").over(track().rowsBetween(1, ahead))
    return packets.withColumn("duration", F.array_min(F.filter(F.transform(later, lambda p: p - F.col("pts")), lambda d: d > 0)))


def concat_tracks(packets: DataFrame, ends: str = "duration") -> DataFrame:
    """All tracks end to end in track_id order: cat_pts and cat_frame count on from the track before."""
    spans = packets.groupBy("track_id").agg(F.max(F.col("pts") + F.col(ends)).alias("__end"), F.min("pts").alias("__start"), F.count("*").alias("__n"))
    spans = global_prefix_sums(spans, ["track_id"], {"__pts0": F.col("__end") - F.col("__start"), "__frame0": F.col("__n")})
    joined = packets.join(spans, "track_id")
    return joined.withColumns({"cat_pts": F.col("pts") - F.col("__start") + F.col("__pts0"), "cat_frame": F.col("frame_no") + F.col("__frame0")}).drop("__end", "__start", "__n", "__pts0", "__frame0")


def merge_positions(packets: DataFrame, header: int = 0) -> DataFrame:
    """All tracks merged by pts (ties by track, then frame): byte position of each packet behind header bytes."""
    return global_prefix_sum(packets, ["pts", "track_id", "frame_no"], F.col("size"), "position", header)


def byte_range(placed: DataFrame, start: int, end: int) -> DataFrame:
    """Packets that overlap bytes [start, end)."""
    return placed.where((F.col("position") < end) & (F.col("position") + F.col("size") > start))


def interleave(packets: DataFrame, lead: int) -> DataFrame:
    """Audio goes out before the first video frame with pts + lead > its pts; audio behind the last video frame is dropped. out_no per track."""
    last = F.max(F.when(F.col("media") == "VIDEO", F.col("pts"))).over(Window.partitionBy("track_id"))
    kept = packets.withColumn("__last", last).where((F.col("media") == "VIDEO") | (F.col("pts") < F.col("__last") + lead)).drop("__last")
    at = F.when(F.col("media") == "AUDIO", F.col("pts") - lead).otherwise(F.col("pts"))
    w = Window.partitionBy("track_id").orderBy("__at", "__kind", "pts", "frame_no")
    return kept.withColumns({"__at": at, "__kind": F.when(F.col("media") == "VIDEO", 0).otherwise(1)}).withColumn("out_no", (F.row_number().over(w) - 1).cast("long")).drop("__at", "__kind")


def chunk_by_frames(packets: DataFrame, n: int) -> DataFrame:
    return packets.withColumn("chunk", F.floor(F.col("frame_no") / n).cast("long"))


def chunk_by_ticks(packets: DataFrame, ticks: int) -> DataFrame:
    """A chunk closes once its durations reach ticks, and the count starts anew: a running sum that resets, carried through each track's packets in
    order, batch by batch, in constant memory. A null duration counts as 0."""
    import pyarrow as pa

    def run(batches):
        at, held, chunk = None, 0, 0
        for b in batches:
            out = []
            for track_id, d in zip(b.column("track_id").to_pylist(), b.column("duration").to_pylist(), strict=True):
                if track_id != at:
                    at, held, chunk = track_id, 0, 0
                out.append(chunk)
                held += d or 0
                if held >= ticks:
                    held, chunk = 0, chunk + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["track_id", "frame_no", "duration", "chunk"])

    rows = packets.select(*(F.col(c).cast("long") for c in ("track_id", "frame_no", "duration")))
    return rows.repartition("track_id").sortWithinPartitions("track_id", "frame_no").mapInArrow(run, "track_id long, frame_no long, duration long, chunk long")


def copy_config_durations(packets: DataFrame) -> DataFrame:
    """Per track totals after durations(): frames and ticks."""
    return packets.groupBy("track_id").agg(F.count("*").alias("frames"), F.sum("duration").alias("ticks"))


def chunk_layout(packets: DataFrame, n: int) -> DataFrame:
    """Chunks of n frames with their byte offset in the track and size."""
    chunks = chunk_by_frames(packets, n).groupBy("track_id", "chunk").agg(F.count("*").alias("samples"), F.sum("size").alias("bytes"))
    return chunks.withColumn("offset", exclusive_sum(F.col("bytes"), ["track_id"], ["chunk"]))
