"""Edit-list algebra. An edit list is the rows (track_id, ord, duration, media_time) of a track; media_time -1 is a gap.

All functions are pure: lists are not changed in place. Points and slices are in movie time, which is the sum of durations before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join
from .runs import exclusive_sum


def movie_starts(edits: DataFrame) -> DataFrame:
    """start and end of each edit in movie time."""
    start = exclusive_sum(F.col("duration"), ["track_id"], ["ord"])
    return edits.withColumn("start", start).withColumn("end", F.col("start") + F.col("duration"))


def edited_duration(edits: DataFrame) -> DataFrame:
    return edits.groupBy("track_id").agg(F.sum("duration").alias("duration"), F.count("*").alias("edits"))


def media_to_edited(points: DataFrame, edits: DataFrame) -> DataFrame:
    """(track_id, media) -> edited: inside the first edit, in list order, that holds the point or starts behind it; behind all edits the whole duration."""
    e = movie_starts(edits)
    inside = (F.col("media_time") >= 0) & (F.col("media") >= F.col("media_time")) & (F.col("media") < F.col("media_time") + F.col("duration"))
    before = (F.col("media_time") >= 0) & (F.col("media") < F.col("media_time"))
    hit = F.when(inside, F.col("start") + F.col("media") - F.col("media_time")).when(before, F.col("start"))
    joined = points.join(e, "track_id").withColumn("hit", hit)
    out = joined.groupBy(*points.columns).agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("ord"))).alias("hit"), F.max("end").alias("all"))
    return out.select(*points.columns, F.coalesce("hit", "all").alias("edited"))


def edited_to_media(points: DataFrame, edits: DataFrame, width: int = 1000) -> DataFrame:
    """(track_id, edited) -> media; null inside a gap or behind the end."""
    a = points.withColumns({"a_start": F.col("edited"), "a_end": F.col("edited") + 1})
    b = movie_starts(edits).select("track_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "media_time")
    found = interval_join(a, b, "track_id", width).select(*points.columns, F.when(F.col("media_time") >= 0, F.col("media_time") + F.col("edited") - F.col("b_start")).alias("media"))
    return points.join(found, points.columns, "left")


def split_edits(edits: DataFrame, cut) -> DataFrame:
    """Edits split at movie time cut: the crossing one becomes two (side 0 before, 1 after); gaps stay gaps; ord is kept."""
    left = F.least(F.col("duration"), F.greatest(F.lit(0), cut - F.col("start")))
    pieces = F.array(
        F.struct(F.lit(0).alias("side"), F.col("start").alias("start"), left.alias("duration"), F.col("media_time")),
        F.struct(F.lit(1).alias("side"), (F.col("start") + left).alias("start"), (F.col("duration") - left).alias("duration"), F.when(F.col("media_time") < 0, F.col("media_time")).otherwise(F.col("media_time") + left).alias("media_time")),
    )
    return movie_starts(edits).withColumn("p", F.explode(pieces)).where("p.duration > 0").select("track_id", "ord", "p.*")


def edits_on_edits(lower: DataFrame, higher: DataFrame, width: int = 1000) -> DataFrame:
    """The windows of higher, whose media_time is movie time of lower, as edits on lower's media. Order: higher's, then lower's."""
    a = higher.where("media_time >= 0").select("track_id", F.col("ord").alias("hi"), F.col("media_time").alias("a_start"), (F.col("media_time") + F.col("duration")).alias("a_end"))
    b = movie_starts(lower).select("track_id", F.col("ord").alias("lo"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.col("media_time").alias("at"))
    both = interval_join(a, b, "track_id", width)
    begin, stop = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    parts = both.select("track_id", "hi", "lo", (stop - begin).alias("duration"), F.when(F.col("at") < 0, F.col("at")).otherwise(F.col("at") + begin - F.col("b_start")).alias("media_time"))
    gaps = higher.where("media_time < 0").select("track_id", F.col("ord").alias("hi"), F.lit(-1).alias("lo"), "duration", "media_time")
    order = Window.partitionBy("track_id").orderBy("hi", "lo")
    return parts.unionByName(gaps).select("track_id", (F.row_number().over(order) - 1).cast("int").alias("ord"), "duration", "media_time")


def cut(edits: DataFrame, start, end) -> DataFrame:
    """Edits split at both ends of the slice [start, end), with inside true for what lies in it."""
    first = split_edits(edits, start)
    w = Window.partitionBy("track_id").orderBy("ord", "side")
    again = first.withColumn("ord", (F.row_number().over(w) - 1).cast("int")).select("track_id", "ord", "duration", "media_time")
    both = split_edits(again, end)
    renumbered = Window.partitionBy("track_id").orderBy("start")
    return both.select("track_id", (F.row_number().over(renumbered) - 1).cast("int").alias("ord"), "start", "duration", "media_time", ((F.col("start") >= start) & (F.col("start") < end)).alias("inside"))


def cut_inner(edits: DataFrame, start, end) -> DataFrame:
    return cut(edits, start, end).where("inside").drop("inside")


def cut_outer(edits: DataFrame, start, end) -> DataFrame:
    """What stays when the slice is taken out: the complement of cut_inner."""
    return cut(edits, start, end).where("not inside").drop("inside")


def insert_gap(edits: DataFrame, at, length: int) -> DataFrame:
    """The list with a gap of length put in at movie time at; lists that end before it get the gap at their end."""
    parts = split_edits(edits, at).select("track_id", F.col("start").alias("k1"), "side", "duration", "media_time")
    heads = parts.groupBy("track_id").agg(F.max(F.col("k1") + F.col("duration")).alias("total"))
    gap = heads.select("track_id", F.least(F.lit(at), F.col("total")).cast("long").alias("k1"), F.lit(-1).alias("side"), F.lit(length).cast("long").alias("duration"), F.lit(-1).cast("long").alias("media_time"))
    w = Window.partitionBy("track_id").orderBy("k1", "side")
    return parts.unionByName(gap).select("track_id", (F.row_number().over(w) - 1).cast("int").alias("ord"), "duration", "media_time")


def shift(edits: DataFrame, length: int) -> DataFrame:
    """A gap of length in front."""
    return insert_gap(edits, 0, length)


def paste(into: DataFrame, source: DataFrame, at: int) -> DataFrame:
    """source's edits put into the matching tracks at movie time at; other tracks of into get a gap as long as source, others of source a gap in front."""
    length = source.groupBy("track_id").agg(F.sum("duration").alias("d"))
    longest = length.agg(F.max("d").alias("longest"))
    base = split_edits(into, F.lit(at)).select("track_id", F.col("side").cast("int").alias("k0"), F.col("start").alias("k1"), "duration", "media_time")
    base = base.withColumn("k0", F.col("k0") * 2)
    added = source.select("track_id", F.lit(1).alias("k0"), F.col("ord").cast("long").alias("k1"), "duration", "media_time")
    ids = into.select("track_id").distinct()
    gap = F.lit(-1).cast("long").alias("media_time")
    fill = ids.join(length, "track_id", "left_anti").crossJoin(F.broadcast(longest)).where("longest is not null").select("track_id", F.lit(1).alias("k0"), F.lit(0).cast("long").alias("k1"), F.col("longest").alias("duration"), gap)
    lead = source.select("track_id").distinct().join(ids, "track_id", "left_anti").select("track_id", F.lit(0).alias("k0"), F.lit(0).cast("long").alias("k1"), F.lit(at).cast("long").alias("duration"), gap).where("duration > 0")
    w = Window.partitionBy("track_id").orderBy("k0", "k1")
    return base.unionByName(added).unionByName(fill).unionByName(lead).select("track_id", (F.row_number().over(w) - 1).cast("int").alias("ord"), "duration", "media_time")


def edited_frames(packets: DataFrame, edits: DataFrame, width: int = 1000) -> DataFrame:
    """Packets (pts, duration in media ticks) shown through an edit list: trimmed to the edit, in the order of edits, with movie times."""
    e = movie_starts(edits).where("media_time >= 0").select("track_id", "ord", "start", F.col("media_time").alias("b_start"), (F.col("media_time") + F.col("duration")).alias("b_end"))
    a = packets.select("track_id", "frame_no", F.col("pts").alias("a_start"), (F.col("pts") + F.col("duration")).alias("a_end"))
    both = interval_join(a, e, "track_id", width)
    begin, stop = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return both.select("track_id", "ord", "frame_no", (F.col("start") + begin - F.col("b_start")).alias("movie_pts"), (stop - begin).alias("duration"))


def strip_chunks(chunks: DataFrame, edits: DataFrame, width: int = 1000) -> DataFrame:
    """Chunks (track_id, chunk, start, duration) that some edit shows, with the ticks dropped before each of them."""
    a = chunks.withColumns({"a_start": F.col("start"), "a_end": F.col("start") + F.col("duration")})
    b = edits.where("media_time >= 0").select("track_id", F.col("media_time").alias("b_start"), (F.col("media_time") + F.col("duration")).alias("b_end"))
    kept = interval_join(a, b, "track_id", width, "semi").select("track_id", "chunk", F.lit(True).alias("kept"))
    marked = chunks.join(kept, ["track_id", "chunk"], "left")
    dropped = exclusive_sum(F.when(F.col("kept").isNull(), F.col("duration")).otherwise(0), ["track_id"], ["chunk"])
    return marked.withColumn("dropped", dropped).where("kept").drop("kept")


def find_gaps(edits: DataFrame) -> DataFrame:
    """Stretches of media time between the edits of a track that no edit shows."""
    w = Window.partitionBy("track_id").orderBy("media_time", "ord").rowsBetween(Window.unboundedPreceding, -1)
    spans = edits.where("media_time >= 0").withColumn("reach", F.max(F.col("media_time") + F.col("duration")).over(w))
    return spans.where("media_time > coalesce(reach, 0)").select("track_id", F.coalesce("reach", F.lit(0)).alias("gap_start"), F.col("media_time").alias("gap_end"))


def rescale_edits(edits: DataFrame, old: int, new: int) -> DataFrame:
    """Movie durations in another timescale, truncating; media times stay."""
    return edits.withColumn("duration", F.expr(f"duration * {new} div {old}"))


def force_edit_list(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Tracks (track_id, duration) without edits get one that shows all of them."""
    missing = tracks.join(edits.select("track_id").distinct(), "track_id", "left_anti")
    return edits.unionByName(missing.select("track_id", F.lit(0).alias("ord"), "duration", F.lit(0).cast("long").alias("media_time")))
