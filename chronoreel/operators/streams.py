"""Elementary-stream verbs: splitting and joining packets, references, statistics of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import exclusive_sum


def split_packets(packets: DataFrame, pieces: Column, step: int) -> DataFrame:
    """Each packet into pieces parts that follow each other by step ticks: pts grows inside a packet, frame_no over the track."""
    n = packets.withColumn("__n", pieces).where("__n > 0").withColumn("__first", exclusive_sum(F.col("__n"), ["track_id"], ["frame_no"]))
    rows = n.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    return rows.select("track_id", "frame_no", "part", (F.col("__first") + F.col("part")).cast("long").alias("out_no"), (F.col("pts") + F.col("part") * step).alias("pts"))


def join_fragments(fragments: DataFrame) -> DataFrame:
    """Fragments (track_id, seq, start, end, data) to whole units: from a start to the next end with no start or missing number between;
    what isn't begun or ended so is left out. unit counts whole ones per track."""
    w = Window.partitionBy("track_id").orderBy("seq")
    begun = F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    broken = (~F.col("start")) & (F.col("seq") != F.lag("seq").over(w) + 1)
    marked = fragments.withColumns({"__g": begun, "__broken": F.coalesce(broken, ~F.col("start"))}).where("__g > 0")
    ended = F.max(F.col("end").cast("int")).over(Window.partitionBy("track_id", "__g").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    inside = marked.withColumn("__after", F.coalesce(ended, F.lit(0))).where("__after = 0")
    groups = inside.groupBy("track_id", "__g").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("s"), F.max("end").alias("whole"), F.max("__broken").alias("broken"), F.min("seq").alias("seq"))
    whole = groups.where("whole and not broken")
    order = Window.partitionBy("track_id").orderBy("seq")
    return whole.select("track_id", (F.row_number().over(order) - 1).cast("long").alias("unit"), F.array_join(F.transform("s", lambda x: x["data"]), "").alias("data"))


def reference_order(pictures: DataFrame, current: DataFrame) -> DataFrame:
    """For each current picture (track_id, poc) the references (track_id, ref_poc) of its track in list 0 order (past by falling order
    count, then future by rising) and list 1 order (the reverse)."""
    both = current.join(pictures, "track_id").where("ref_poc <> poc")
    past = F.col("ref_poc") < F.col("poc")
    away = F.abs(F.col("ref_poc") - F.col("poc"))
    w = lambda first: Window.partitionBy("track_id", "poc").orderBy(F.when(past, 1 - first).otherwise(first), away)
    return both.select("track_id", "poc", "ref_poc", (F.row_number().over(w(1)) - 1).alias("list0"), (F.row_number().over(w(0)) - 1).alias("list1"))


def reference_window(pictures: DataFrame, depth: int = 16) -> DataFrame:
    """Every picture (track_id, decode_no, poc, key) with the references its decoder holds: the depth pictures decoded before it, none
    from before the last key picture, which clears the buffer. Lists as in reference_order; where both would be equal and longer than
    one, list 1 has its first two swapped. A window per track: rows grow with depth, never with the pairs of a track."""
    order = Window.partitionBy("track_id").orderBy("decode_no")
    since_key = F.coalesce(F.sum(F.col("key").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    buffer = Window.partitionBy("track_id", "__gop").orderBy("decode_no").rowsBetween(-depth, -1)
    held = pictures.withColumn("__gop", since_key).withColumn("__refs", F.array_sort(F.collect_list("poc").over(buffer)))
    past = F.reverse(F.filter("__refs", lambda r: r < F.col("poc")))
    future = F.filter("__refs", lambda r: r > F.col("poc"))
    lists = held.select("track_id", "poc", F.concat(past, future).alias("__l0"), F.concat(future, past).alias("__l1"))
    swapped = F.concat(F.slice("__l1", 2, 1), F.slice("__l1", 1, 1), F.slice("__l1", 3, depth))
    lists = lists.withColumn("__l1", F.when((F.size("__l1") > 1) & (F.col("__l0") == F.col("__l1")), swapped).otherwise(F.col("__l1")))
    rows = lists.select("track_id", "poc", F.posexplode("__l0").alias("list0", "ref_poc"), "__l1")
    return rows.select("track_id", "poc", "ref_poc", "list0", (F.array_position("__l1", F.col("ref_poc")) - 1).cast("int").alias("list1"))


def stream_info(packets: DataFrame) -> DataFrame:
    """Per track and kind of packet: packets, bytes and mean gap in ticks, truncating."""
    per = packets.groupBy("track_id", "media").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), F.min("pts").alias("__a"), F.max("pts").alias("__b"))
    gap = F.when(F.col("packets") > 1, F.expr("(__b - __a) div (packets - 1)"))
    return per.withColumn("mean_gap", gap).drop("__a", "__b")


def frame_number_unwrap(pictures: DataFrame, limit: int) -> DataFrame:
    """frame_num of references behind the current number made negative: those above it lie one period back."""
    return pictures.withColumn("unwrapped", F.when(F.col("ref_num") > F.col("frame_num"), F.col("ref_num") - limit).otherwise(F.col("ref_num")))


def segments(tracks: DataFrame, segment_ticks: int) -> DataFrame:
    """Fixed segments of tracks (track_id, duration): number and start of each."""
    n = F.expr(f"(duration + {segment_ticks} - 1) div {segment_ticks}")
    return tracks.where("duration > 0").select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("segment")).withColumn("start", F.col("segment") * segment_ticks)


def stable_timestamps(packets: DataFrame, stamps: DataFrame) -> DataFrame:
    """Packets given outside stamps (track_id, frame_no, stamp): only stamps that don't fall behind an earlier one count; durations to the next."""
    joined = packets.select("track_id", "frame_no").join(stamps, ["track_id", "frame_no"])
    w = Window.partitionBy("track_id").orderBy("frame_no")
    best = F.max("stamp").over(w.rowsBetween(Window.unboundedPreceding, -1))
    good = joined.withColumn("__m", best).where("__m is null or stamp >= __m").drop("__m")
    return good.withColumn("duration", F.lead("stamp").over(w) - F.col("stamp"))


def swap_config(packets: DataFrame, config: str) -> DataFrame:
    """Distinct configurations of each track, numbered in the order they first come: what a sample entry table needs."""
    first = packets.groupBy("track_id", config).agg(F.min("frame_no").alias("first_frame"))
    return first.withColumn("entry", F.row_number().over(Window.partitionBy("track_id").orderBy("first_frame")))
