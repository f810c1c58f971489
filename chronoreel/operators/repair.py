"""Stream repair: wrapped, missing and drifting timestamps. Per track, in frame order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def track():
    return Window.partitionBy("track_id").orderBy("frame_no")


def up_to():
    return track().rowsBetween(Window.unboundedPreceding, 0)


def retime(packets: DataFrame, shift: int = 0, num: int = 1, den: int = 1, grid: int = 1) -> DataFrame:
    """pts * num div den, plus shift, not below 0, rounded to a multiple of grid."""
    moved = F.greatest(F.expr(f"pts * {num} div {den}") + shift, F.lit(0))
    return packets.withColumn("pts", F.floor((moved + grid // 2) / grid).cast("long") * grid if grid > 1 else moved)


def set_base(packets: DataFrame, base: int) -> DataFrame:
    """All tracks moved together so that the earliest pts is base."""
    first = packets.agg(F.min("pts").alias("__first"))
    return packets.crossJoin(F.broadcast(first)).withColumn("pts", F.col("pts") - F.col("__first") + base).drop("__first")


def unwrap(packets: DataFrame, period: int, enabled: bool = True) -> DataFrame:
    """pts as a growing count: a fall by more than half a period adds a period, a rise by more takes one off."""
    if not enabled:
        return packets
    step = F.col("pts") - F.lag("pts").over(track())
    turn = F.when(step < -(period // 2), 1).when(step > period // 2, -1).otherwise(0)
    return packets.withColumn("__t", turn).withColumn("pts", F.col("pts") + F.sum("__t").over(up_to()) * period).drop("__t")


def fill_missing(packets: DataFrame) -> DataFrame:
    """Null pts become the last known pts plus the last known duration (0 if none); a run of nulls shares one value, as the last known one stays."""
    last = F.last("pts", ignorenulls=True).over(up_to())
    step = F.last(F.when(F.col("pts").isNotNull(), F.col("duration")), ignorenulls=True).over(up_to())
    return packets.withColumn("pts", F.coalesce(F.col("pts"), last + F.coalesce(step, F.lit(0))))


def gop_pts(packets: DataFrame) -> DataFrame:
    """Missing pts (null) of a group (track_id, gop): in temporal_ref order, then backwards, then forwards again, a missing one becomes the last
    known pts plus the step between the last two known ones over the distance of their temporal references (whole, towards zero).

    A group with fewer than two known pts keeps its nulls, and so does one whose last two known references are equal. Groups are short (a
    key frame begins one), so each is an array in one row. An empty table gives an empty result.
    """
    frame = "struct<temporal_ref:bigint,pts:bigint>"
    nothing = F.lit(None).cast("bigint")
    start = F.struct(F.array().cast(f"array<{frame}>").alias("out"), *(nothing.alias(k) for k in ("p1", "t1", "p2", "t2")))

    def step(acc, x):
        moved = (acc["p1"] - acc["p2"]).cast("decimal(38,0)") / F.nullif(F.abs(acc["t1"] - acc["t2"]), F.lit(0))
        whole = F.when(moved >= 0, F.floor(moved)).otherwise(F.ceil(moved)).cast("bigint")
        pts = F.coalesce(x["pts"], acc["p1"] + whole)
        known = pts.isNotNull()
        later = lambda new, old: F.when(known, new).otherwise(old)
        out = F.concat(acc["out"], F.array(F.struct(x["temporal_ref"].alias("temporal_ref"), pts.alias("pts"))))
        return F.struct(out.alias("out"), later(pts, acc["p1"]).alias("p1"), later(x["temporal_ref"], acc["t1"]).alias("t1"), later(acc["p1"], acc["p2"]).alias("p2"), later(acc["t1"], acc["t2"]).alias("t2"))

    rows = packets.groupBy("track_id", "gop").agg(F.array_sort(F.collect_list(F.struct(F.col("temporal_ref").cast("bigint").alias("temporal_ref"), F.col("pts").cast("bigint").alias("pts")))).alias("f"))
    for _ in range(3):
        rows = rows.withColumn("f", F.reverse(F.aggregate("f", start, step)["out"]))
    return rows.select("track_id", "gop", F.explode("f").alias("e")).select("track_id", "gop", "e.temporal_ref", "e.pts")


def poc(packets: DataFrame, bits: int = 4) -> DataFrame:
    """Picture order count from its low bits: the high part steps when the low one wraps, and starts anew at key frames."""
    top = 1 << bits
    group = packets.withColumn("__g", F.sum(F.col("key").cast("long")).over(up_to()))
    w = Window.partitionBy("track_id", "__g").orderBy("frame_no")
    step = F.col("lsb") - F.lag("lsb").over(w)
    turn = F.when(step <= -top // 2, top).when(step > top // 2, -top).otherwise(0)
    return group.withColumn("__t", turn).withColumn("poc", F.col("lsb") + F.sum("__t").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__t", "__g")


#: Samples of an audio packet, and the rate at which counted packets tell the pace.
SAMPLES, PACE_RATE = 1024, 48000


def drift(packets: DataFrame, ahead: int = 600, limit: float = 0.33, rate: int = 48000) -> DataFrame:
    """fixed_pts in milliseconds: audio packets follow each other by their length; a video packet's step is the length of the audio among the next
    ahead packets (its own included) over the number of video ones, corrected by the difference of the two clocks (with the weight of that
    difference, one second at most) and bounded to limit of the step either way.

    Counts are windows; only the video clock rests on the packet before. It is carried through each track's packets in order, batch by batch,
    so a track of any length takes constant memory. Packets of a null frame_no come first; an empty table gives an empty result.
    """
    next_ones = track().rowsBetween(0, ahead - 1)
    is_audio, is_video = (F.col("media") == m for m in ("AUDIO", "VIDEO"))
    audio = F.coalesce(F.count_if(is_audio).over(track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = packets.select("track_id", "frame_no", "media", "pts").withColumns({
        "clock": (audio * SAMPLES).cast("double") / rate,
        "step": (F.count_if(is_audio).over(next_ones) * SAMPLES).cast("double") / F.nullif(F.count_if(is_video).over(next_ones) * PACE_RATE, F.lit(0)),
    })

    def run(batches):
        import math

        import pyarrow as pa

        at, video = None, 0.0
        for b in batches:
            out = []
            for track_id, media, clock, step in zip(*(b.column(c).to_pylist() for c in ("track_id", "media", "clock", "step")), strict=True):
                if track_id != at:
                    at, video = track_id, 0.0
                out.append(clock if media == "AUDIO" else video)
                if media == "VIDEO":
                    off = clock - video
                    video += min((1 + limit) * step, max((1 - limit) * step, step + min(1.0, abs(off)) * off))
            fixed = pa.array([math.floor(x * 1000 + 0.5) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("track_id", "frame_no", "media", "pts")), fixed], ["track_id", "frame_no", "media", "pts", "fixed_pts"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4]) + ", fixed_pts long"
    return rows.repartition("track_id").sortWithinPartitions("track_id", "frame_no").mapInArrow(run, schema)


def continuity_breaks(rows: DataFrame, part: str, counter: str) -> DataFrame:
    """Rows whose counter isn't one more than the row before (the first is none)."""
    before = F.lag(counter).over(Window.partitionBy(part).orderBy(counter))
    return rows.withColumn("__b", before).where(F.col("__b").isNotNull() & (F.col("__b") + 1 != F.col(counter))).withColumnRenamed("__b", "previous")


def timecode_gaps(rows: DataFrame, part: str, order: str) -> DataFrame:
    """gap: whether a timecode (hour, minute, second, frame, drop; null hour: none) does not continue the one before in part.

    It does not where one of the two is missing, the drop flag changes, the second moves by other than 0 or 1, the frame doesn't move by one inside a
    second (modulo the frame rate once that is known), or a new second doesn't begin at its first frame after the last one: frame 0, but 2
    in drop-frame minutes other than every tenth. The frame rate is 30 for drop-frame codes and otherwise learned at the first step to a frame 0;
    a second that begins elsewhere before that is a gap. The first row of a part is a gap if it has a timecode.
    """
    w = Window.partitionBy(part).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("hour", "minute", "second", "frame", "drop")}
    seconds = lambda h, m, s: h * 3600 + m * 60 + s
    sec = seconds(F.col("hour"), F.col("minute"), F.col("second"))
    step = sec - seconds(before["hour"], before["minute"], before["second"])
    learned = F.when((step == 1) & ~F.col("drop") & (before["drop"] == F.col("drop")) & (F.col("frame") == 0), before["frame"] + 1)
    rows = rows.withColumns({"__step": step, "__frame": before["frame"], "__drop": before["drop"], "__none": before["hour"].isNull(), "__sec": sec, "__learn": learned})
    known = F.first("__learn", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fps = F.when(F.col("drop"), F.lit(30)).otherwise(known)
    rows = rows.withColumn("__fps", fps)
    moved = F.col("frame") - F.col("__frame")
    moved = F.when(F.col("__fps").isNull(), moved).otherwise((moved + F.col("__fps")) % F.col("__fps"))
    first = F.when(F.col("drop") & (F.col("__sec") % 60 == 0) & (F.col("__sec") % 600 != 0), 2).otherwise(0)
    rolled = F.when(F.col("__fps").isNull(), F.col("frame") != 0).otherwise((F.col("frame") != first) | (F.col("__frame") != F.col("__fps") - 1))
    gap = (
        F.when(F.col("__none"), F.col("hour").isNotNull()).when(F.col("hour").isNull() | (F.col("__drop") != F.col("drop")), True)
        .when(F.col("__step") == 0, moved != 1).when(F.col("__step") == 1, rolled).otherwise(True)
    )
    return rows.withColumn("gap", gap).drop("__step", "__frame", "__drop", "__none", "__sec", "__learn", "__fps")
