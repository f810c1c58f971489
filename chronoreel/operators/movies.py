"""Whole-movie verbs: fragments to packets, cutting chunks to gaps, frame rate, timecode look-up, clips, concatenation.

Samples are rows (track_id, sample, start, duration); every verb partitions by track. Rows of a null track_id form a track of their own; null
times never match a condition; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The least timescale that a frame-rate change may set.
LEAST_TIMESCALE = 25


def by_track(*order):
    return Window.partitionBy("track_id").orderBy(*order)


def fragment_packets(fragments: DataFrame) -> DataFrame:
    """Fragments (track_id, decode_time, offset, sizes, durations) as packets: track_id, fragment, frame_no, pts, duration, offset, size, key.

    Fragments follow each other by decode time. Where a fragment tells no durations (null), each of its samples lasts the whole quotient of the
    step to the next fragment and its number of samples; the last one's last as long as those of the one before (0 if there is none).
    pts and offsets are prefix sums inside the fragment; its first sample is a key frame.
    """
    w = by_track("decode_time", "offset")
    n = F.size("sizes")
    step = F.expr("(lead(decode_time) over (partition by track_id order by decode_time, offset) - decode_time) div size(sizes)")
    rows = fragments.withColumns({"fragment": (F.row_number().over(w) - 1).cast("long"), "__each": step, "__first": F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    rows = rows.withColumn("__each", F.coalesce("__each", F.lag("__each").over(w), F.lit(0)))
    samples = rows.select("*", F.posexplode("sizes").alias("__i", "size")).withColumn("duration", F.coalesce(F.get("durations", F.col("__i")), F.col("__each")).cast("long"))
    inside = Window.partitionBy("track_id", "fragment").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    return samples.select(
        "track_id", "fragment", (F.col("__first") + F.col("__i")).alias("frame_no"), (F.col("decode_time") + before("duration")).alias("pts"), "duration",
        (F.col("offset") + before("size")).alias("offset"), F.col("size").cast("long").alias("size"), (F.col("__i") == 0).alias("key"),
    )


def cut_to_gaps(samples: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples (track_id, sample, start, duration) without those that lie wholly in one of the track's gaps (gap_start, gap_end, the end
    inclusive), re-timed without holes (new_start); and the intervals that remain as edits (track_id, ord, media_time, duration).

    Gaps of a track don't overlap. Samples, gaps and the intervals between them lie in one sort a track: each sample looks up the last gap that begins
    at or before it, and each interval the last kept sample that does.
    """
    side = lambda kind, at: F.struct(F.lit(kind).alias("side"), at.cast("long").alias("at"))
    ends = samples.groupBy("track_id").agg(F.max(F.col("start") + F.col("duration")).alias("stop"), F.min("start").alias("from"))
    sides = gaps.select("track_id", F.explode(F.array(side(0, F.col("gap_end") + 1), side(1, F.col("gap_start")))).alias("s"))
    sides = sides.unionByName(ends.select("track_id", F.explode(F.array(side(0, F.col("from")), side(1, F.col("stop")))).alias("s"))).select("track_id", "s.*")
    # the k-th beginning belongs to the k-th end; there are as many of both
    half = F.expr("count(*) over (partition by track_id) div 2")
    ranked = sides.withColumn("ord", (F.row_number().over(by_track("side", "at")) - 1) % half)
    left = ranked.groupBy("track_id", "ord").agg(F.max(F.expr("case when side = 0 then at end")).alias("a"), F.max(F.expr("case when side = 1 then at end")).alias("b")).where("b > a and track_id is not null")

    none = F.lit(None).cast("long")
    marks = samples.select("track_id", F.col("start").alias("__at"), F.lit(1).alias("__kind"), "sample", "duration", none.alias("__to"))
    marks = marks.unionByName(gaps.select("track_id", F.col("gap_start").alias("__at"), F.lit(0).alias("__kind"), none.alias("sample"), none.alias("duration"), F.col("gap_end").cast("long").alias("__to")))
    marks = marks.unionByName(left.select("track_id", F.col("a").alias("__at"), F.lit(2).alias("__kind"), none.alias("sample"), none.alias("duration"), F.col("b").alias("__to")))
    w = by_track("__at", "__kind", "sample")
    past, now = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.withColumn("__end", F.last(F.expr("case when __kind = 0 then __to end"), ignorenulls=True).over(now))
    rows = rows.withColumn("__keep", F.expr("__kind = 1 and not coalesce(__at + duration <= __end + 1, false)"))
    rows = rows.withColumn("new_start", F.coalesce(F.sum(F.expr("case when __keep then duration end")).over(past), F.lit(0)))
    kept = rows.where("__keep").select("track_id", "sample", F.col("__at").alias("start"), "duration", "new_start")

    found = rows.withColumn("__moved", F.last(F.expr("case when __keep then new_start - __at end"), ignorenulls=True).over(now)).where("__kind = 2")
    edits = found.select("track_id", (F.row_number().over(w) - 1).cast("int").alias("ord"), (F.col("__moved") + F.col("__at")).alias("media_time"), (F.col("__to") - F.col("__at")).alias("duration"))
    return kept, edits


def split_chunks(samples: DataFrame, cut: str, round_up: bool = False, at: str | None = None) -> DataFrame:
    """part: 0 for samples before a cut (a column, in time from the track's first sample), 1 behind it. A sample across the cut goes behind it, or
    before it with round_up. at: a column with each sample's time from the track's first, where that is known; else durations are added up in a sort of the samples."""
    begins = F.col(at) if at else F.coalesce(F.sum("duration").over(by_track("sample").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = begins < F.col(cut) if round_up else begins + F.col("duration") <= F.col(cut)
    return samples.withColumn("part", F.when(before, 0).otherwise(1))


def set_frame_rate(runs: DataFrame, num: int, den: int = 1, timescale: int = 600) -> DataFrame:
    """Runs (track_id, run, count, duration) played at num / den frames a second: by a new timescale (the whole part of rate times mean
    duration) if that is LEAST_TIMESCALE or more, else by durations in a timescale a hundred times as fine."""
    w = Window.partitionBy("track_id")
    rows = runs.withColumns({"__n": F.sum("count").over(w), "__all": F.sum(F.col("count") * F.col("duration")).over(w)})
    rows = rows.withColumn("__scale", F.expr(f"({num} * __all) div ({den} * __n)"))
    new = F.col("__scale") >= LEAST_TIMESCALE
    finer = F.floor(F.col("duration") * ((F.lit(timescale) * F.col("__all") * den).cast("double") / (F.col("__n") * num)) * 100).cast("long")
    return rows.withColumns({"timescale": F.when(new, F.col("__scale")).otherwise(timescale * 100).cast("long"), "duration": F.when(new, F.col("duration")).otherwise(finer)}).drop("__n", "__all", "__scale")


def timecodes_at(packets: DataFrame, codes: DataFrame) -> DataFrame:
    """Each packet (track_id, frame_no, pts) with the counter of the last timecode sample (track_id, start, counter) that begins at or before its
    pts, moved on by the packets since: counter and first_pts of that sample; null before the first. One sort a track."""
    none = F.lit(None).cast("long")
    both = codes.select("track_id", F.col("start").alias("pts"), F.lit(0).alias("__kind"), none.alias("frame_no"), "counter", F.col("start").alias("first_pts"))
    both = both.unionByName(packets.select("track_id", "pts", F.lit(1).alias("__kind"), "frame_no", none.alias("counter"), none.alias("first_pts")))
    w = by_track("pts", "__kind", "frame_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("counter", "first_pts")}).where("__kind = 1").drop("__kind")


def clip(packets: DataFrame, start: int | None = None, stop: int | None = None, config: str = "config") -> DataFrame:
    """What a clip keeps: from the first key video packet behind start once a config packet (a boolean column) was seen, up to the packet before
    the first one at or behind stop. clip_no counts the kept packets."""
    past = by_track("frame_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.col(config)).over(past)
    begins = seen & (F.col("media") == "VIDEO") & F.col("key") & (F.lit(True) if start is None else F.col("pts") > start)
    rows = packets.withColumns({"__b": begins, "__s": F.lit(False) if stop is None else F.col("pts") >= stop})
    rows = rows.withColumn("__b", F.coalesce(F.max("__b").over(past), F.lit(False)) & ~F.coalesce(F.max("__s").over(past), F.lit(False))).where("__b")
    return rows.drop("__b", "__s").withColumn("clip_no", (F.row_number().over(by_track("frame_no")) - 1).cast("long"))


def tag_gaps(packets: DataFrame) -> DataFrame:
    """Each packet with the time to the next one of its kind in its track (null for the last)."""
    return packets.withColumn("gap", F.lead("pts").over(Window.partitionBy("track_id", "media").orderBy("frame_no")) - F.col("pts"))


def concat_runs(runs: DataFrame) -> DataFrame:
    """Runs of several movies (movie, track_id, run, count, duration) as one table a track: movies in order, runs numbered on, each with the
    sample and the time it begins at."""
    w = by_track("movie", "run")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return runs.withColumns({"first_sample": before("count"), "start": before(F.col("count") * F.col("duration")), "new_run": (F.row_number().over(w) - 1).cast("long")})


def blocks_of_frames(blocks: DataFrame, frames: DataFrame) -> DataFrame:
    """Indexed blocks (track_id, block, n_frames) and wanted frames (track_id, frame_no): the block that holds each, and the frame's place in it;
    null past the end. Prefix sums, then one sort a track."""
    first = F.coalesce(F.sum("n_frames").over(by_track("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.lit(None).cast("long")
    both = blocks.where("n_frames > 0").select("track_id", first.cast("long").alias("at"), F.lit(0).alias("__kind"), F.col("block").cast("long").alias("block"), F.col("n_frames").cast("long").alias("__n"))
    both = both.withColumn("first", F.col("at")).unionByName(frames.select("track_id", F.col("frame_no").alias("at"), F.lit(1).alias("__kind"), none.alias("block"), none.alias("__n"), none.alias("first")))
    w = by_track("at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("block", "first", "__n")}).where("__kind = 1")
    there = F.col("at") < F.col("first") + F.col("__n")
    return found.select("track_id", F.col("at").alias("frame_no"), F.when(there, F.col("block")).alias("block"), F.when(there, F.col("at") - F.col("first")).alias("place"))
