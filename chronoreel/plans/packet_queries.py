"""Named queries over the packet view of events and the run view of lineitem, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import LR_SQL, PK_SQL, event_packets, line_runs, table
from ..operators import packets as P
from ..operators import runs as R
from ..operators import streams as S
from ..operators.prefix import global_prefix_sum
from . import virtual as V

QUERIES, SQL = {}, {}
PK = f"with {PK_SQL} "


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pk(spark, d):
    return event_packets(table(spark, d, "events"))


#: The order of frame_no inside a track, in SQL.
W = "(partition by track_id order by frame_no)"
UP = "(partition by track_id order by frame_no rows between unbounded preceding and current row)"


@query("gop_summary", PK + f"""select track_id, gop, count(*) as frames, sum(size)::bigint as bytes, min(pts) as first_pts, max(pts) - min(pts) as span
    from (select *, sum(key::bigint) over {UP}::bigint as gop from pk) group by track_id, gop""")
def gop_summary(spark, d):
    return P.gop_summary(pk(spark, d))


@query("packet_scan", PK + "select event_id, track_id, media, frame_no, pts, timescale, key, size from pk")
def packet_scan(spark, d):
    return pk(spark, d).drop("event_type")


@query("track_meta", PK + "select track_id, count(*) as frames, min(pts) as first_pts, max(pts) as last_pts, sum(key::bigint)::bigint as keys, sum(size)::bigint as bytes from pk group by track_id")
def track_meta(spark, d):
    return P.track_meta(pk(spark, d))


@query("track_filter", PK + "select track_id, frame_no, pts from pk where media = 'VIDEO'")
def track_filter(spark, d):
    return pk(spark, d).where("media = 'VIDEO'").select("track_id", "frame_no", "pts")


DUR = f"""dur as (select *, coalesce(d, lag(d) over {W}, 3003)::bigint as duration from (select *, lead(pts) over {W} - pts as d from pk))"""


@query("duration_lead", PK + f", {DUR} select track_id, frame_no, duration from dur")
def duration_lead(spark, d):
    return P.durations(pk(spark, d)).select("track_id", "frame_no", "duration")


@query("duration_last_one", PK + f"select track_id, frame_no, coalesce(lead(pts) over {W} - pts, 1) as duration from pk")
def duration_last_one(spark, d):
    return P.durations_last_one(pk(spark, d)).select("track_id", "frame_no", "duration")


@query("keyframe_list", PK + "select track_id, frame_no from pk where key")
def keyframe_list(spark, d):
    return pk(spark, d).where("key").select("track_id", "frame_no")


KF = f"kf as (select *, coalesce(max(case when key then frame_no end) over {UP}, 0) as key_frame from pk)"


@query("keyframe_lookup", PK + f", {KF} select track_id, frame_no, key_frame from kf")
def keyframe_lookup(spark, d):
    return P.last_key(pk(spark, d)).select("track_id", "frame_no", "key_frame")


@query("gop_id", PK + f"select track_id, frame_no, sum(key::bigint) over {UP}::bigint as gop from pk")
def gop_id(spark, d):
    return P.gop_ids(pk(spark, d)).select("track_id", "frame_no", "gop")


@query("clip_gop", PK + f""", {KF}, st as (select track_id, key_frame as first from kf where frame_no = 10),
    c as (select kf.* from kf join st using (track_id) where kf.frame_no >= first and kf.frame_no < 25)
    select track_id, frame_no, frame_no - min(frame_no) over (partition by track_id) as clip_frame, pts - min(pts) over (partition by track_id) as clip_pts from c""")
def clip_gop(spark, d):
    return P.clip(pk(spark, d), 10, 25).select("track_id", "frame_no", "clip_frame", "clip_pts")


@query("seek_pts", PK + f""", {KF}, t as (select track_id, min(pts) as lo, row_number() over (order by track_id) - 1 as i, count(*) over () as n from pk group by track_id),
    pt as (select o_orderkey, t.track_id, lo + (o_orderkey * 7919) % 100000000000 as "at" from orders join t on t.i = o_custkey % t.n)
    select o_orderkey, pt.track_id, "at", max(frame_no) as frame_no, max(pts) as pts, arg_max(key_frame, frame_no) as key_frame
    from pt left join kf on kf.track_id = pt.track_id and kf.pts <= pt."at" group by o_orderkey, pt.track_id, "at" """)
def seek_pts(spark, d):
    packets = pk(spark, d)
    low = global_prefix_sum(packets.groupBy("track_id").agg(F.min("pts").alias("lo")), ["track_id"], F.lit(1), "i")
    points = table(spark, d, "orders").crossJoin(F.broadcast(low.agg(F.count("*").alias("n")))).where("n > 0").select("o_orderkey", (F.col("o_custkey") % F.col("n")).alias("i")).join(low, "i")
    points = points.select("o_orderkey", "track_id", (F.col("lo") + (F.col("o_orderkey") * 7919) % 100000000000).alias("at"))
    found = P.seek(packets, points.select("track_id", "at").distinct())
    return points.join(found, ["track_id", "at"])


@query("limit_frames", PK + "select track_id, frame_no, pts from pk where frame_no < 5")
def limit_frames(spark, d):
    return P.limit_frames(pk(spark, d), 5).select("track_id", "frame_no", "pts")


@query("skip_frames", PK + "select track_id, frame_no, pts from pk where frame_no >= 20")
def skip_frames(spark, d):
    return P.skip_frames(pk(spark, d), 20).select("track_id", "frame_no", "pts")


def _shuffled(packets):
    """The same packets in a decode order of swapped pairs."""
    return packets.withColumn("frame_no", F.col("frame_no").bitwiseXOR(F.lit(1).cast("long")))


DECODE = "sw as (select track_id, xor(frame_no, 1) as frame_no, pts from pk)"


@query("display_reorder", PK + f""", {DECODE} select track_id, frame_no, row_number() over w - 1 as display_no, lead(pts) over w - pts as duration from sw window w as (partition by track_id order by pts, frame_no)""")
def display_reorder(spark, d):
    return P.display_order(_shuffled(pk(spark, d))).select("track_id", "frame_no", "display_no", "duration")


@query("reorder_bounded", PK + f", {DECODE} select track_id, frame_no, pts, row_number() over (partition by track_id order by pts, frame_no) - 1 as out_no from sw")
def reorder_bounded(spark, d):
    return P.reorder_bounded(_shuffled(pk(spark, d)))


@query("copy_duration_fill", PK + f""", {DECODE}, n as (select a.track_id, a.frame_no, min(b.pts - a.pts) as duration
    from sw a left join sw b on a.track_id = b.track_id and b.frame_no between a.frame_no + 1 and a.frame_no + 7 and b.pts > a.pts group by a.track_id, a.frame_no) select * from n""")
def copy_duration_fill(spark, d):
    # swapped pairs leave no gaps in the numbering but at a track's end, where the window counts rows and the SQL counts numbers
    swapped = _shuffled(pk(spark, d))
    return P.copy_durations(swapped).select("track_id", "frame_no", "duration")


@query("concat_tracks", PK + f""", {DUR}, sp as (select track_id, max(pts + duration) - min(pts) as span, min(pts) as start, count(*) as n from dur group by track_id),
    o as (select *, coalesce(sum(span) over p, 0)::bigint as pts0, coalesce(sum(n) over p, 0)::bigint as frame0 from sp window p as (order by track_id rows between unbounded preceding and 1 preceding))
    select dur.track_id, frame_no, pts - start + pts0 as cat_pts, frame_no + frame0 as cat_frame from dur join o using (track_id)""")
def concat_tracks(spark, d):
    return P.concat_tracks(P.durations(pk(spark, d))).select("track_id", "frame_no", "cat_pts", "cat_frame")


POS = "pos as (select *, coalesce(sum(size) over (order by pts, track_id, frame_no rows between unbounded preceding and 1 preceding), 0)::bigint + 40 as position from pk)"


@query("merge_positions", PK + f", {POS} select track_id, frame_no, position, size from pos")
def merge_positions(spark, d):
    return P.merge_positions(pk(spark, d), 40).select("track_id", "frame_no", "position", "size")


@query("byte_range_lookup", PK + f", {POS} select track_id, frame_no, position, size from pos where position < 200000 and position + size > 100000")
def byte_range_lookup(spark, d):
    return P.byte_range(P.merge_positions(pk(spark, d), 40), 100000, 200000).select("track_id", "frame_no", "position", "size")


@query("av_interleave", PK + """, l as (select *, max(case when media = 'VIDEO' then pts end) over (partition by track_id) as last from pk),
    k as (select *, case when media = 'AUDIO' then pts - 200000000 else pts end as go, case when media = 'VIDEO' then 0 else 1 end as kind from l where media = 'VIDEO' or pts < last + 200000000)
    select track_id, frame_no, media, row_number() over (partition by track_id order by go, kind, pts, frame_no) - 1 as out_no from k""")
def av_interleave(spark, d):
    return P.interleave(pk(spark, d), 200_000_000).select("track_id", "frame_no", "media", "out_no")


@query("chunk_by_frames", PK + """select track_id, chunk, samples, bytes, coalesce(sum(bytes) over (partition by track_id order by chunk rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
    from (select track_id, frame_no // 8 as chunk, count(*) as samples, sum(size)::bigint as bytes from pk group by track_id, frame_no // 8)""")
def chunk_by_frames(spark, d):
    return P.chunk_layout(pk(spark, d), 8)


@query("chunk_by_ticks", PK + f""", {DUR}, r as (select track_id, frame_no, duration from dur)
    , rec as (with recursive t as (select track_id, frame_no, duration, 0::bigint as chunk, duration as held from r where frame_no = 0
      union all select r.track_id, r.frame_no, r.duration, case when t.held >= 5000000000 then t.chunk + 1 else t.chunk end, case when t.held >= 5000000000 then r.duration else t.held + r.duration end
      from t join r on r.track_id = t.track_id and r.frame_no = t.frame_no + 1) select * from t) select track_id, frame_no, duration, chunk from rec""")
def chunk_by_ticks(spark, d):
    return P.chunk_by_ticks(P.durations(pk(spark, d)), 5_000_000_000)


RLE = f"""is_ as (select track_id, frame_no, event_type, case when row_number() over {W} = 1 or event_type is distinct from lag(event_type) over {W} then 1 else 0 end as s from pk),
    rn as (select track_id, event_type as value, sum(s) over {UP}::bigint - 1 as run from is_), rle as (select track_id, run, any_value(value) as value, count(*) as count from rn group by track_id, run)"""


@query("rle_encode", PK + f", {RLE} select track_id, run, value, count from rle")
def rle_encode(spark, d):
    return R.rle_encode(pk(spark, d), ["track_id"], ["frame_no"], "event_type")


@query("rle_split", "with big as (select l_returnflag as value, count(*) as count, 0::bigint as run, l_linenumber as track_id from lineitem group by l_returnflag, l_linenumber) "
       "select track_id, run, value, p::int as piece, least(256, count - p * 256)::bigint as count from (select *, unnest(range((count + 255) // 256)) as p from big)")
def rle_split(spark, d):
    big = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("count"))
    big = big.select(F.col("l_linenumber").alias("track_id"), F.lit(0).cast("long").alias("run"), F.col("l_returnflag").alias("value"), "count")
    return R.rle_split(big, ["track_id"])


@query("rle_expand", PK + f", {RLE} select track_id, run, value, unnest(range(count))::int as n from rle")
def rle_expand(spark, d):
    return R.rle_expand(R.rle_encode(pk(spark, d), ["track_id"], ["frame_no"], "event_type")).select("track_id", "run", "value", F.col("n").cast("int").alias("n"))


@query("stts_expand", f"""with {LR_SQL}, b as (select *, coalesce(sum(count) over p, 0)::bigint as s0, coalesce(sum(count * duration) over p, 0)::bigint as p0 from lr
    window p as (partition by track_id order by run rows between unbounded preceding and 1 preceding)), e as (select *, unnest(range(count)) as n from b)
    select track_id, run, s0 + n as sample_no, p0 + n * duration as pts, duration from e""")
def stts_expand(spark, d):
    return R.sample_times(line_runs(table(spark, d, "lineitem")))


@query("run_totals", f"with {LR_SQL} select track_id, sum(count)::bigint as samples, sum(count * duration)::bigint as ticks from lr group by track_id")
def run_totals(spark, d):
    return R.total_duration(line_runs(table(spark, d, "lineitem")))


@query("sample_offsets", f"""with {LR_SQL} select track_id, run, duration as size, coalesce(sum(duration) over (partition by track_id order by run rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from lr""")
def sample_offsets(spark, d):
    return R.sample_offsets(line_runs(table(spark, d, "lineitem")).select("track_id", "run", F.col("duration").alias("size")), ["track_id"], ["run"])


@query("stsc_asof", f"""with {LR_SQL}, r as (select track_id, 1 + coalesce(sum(count) over (partition by track_id order by run rows between unbounded preceding and 1 preceding), 0)::bigint as first_chunk, duration as samples from lr),
    c as (select track_id, unnest(range(1, n + 1)) as chunk from (select track_id, sum(count)::bigint as n from lr group by track_id))
    select c.track_id, chunk, max(first_chunk) as first_chunk, arg_max(samples, first_chunk) as samples from c join r on r.track_id = c.track_id and first_chunk <= chunk group by c.track_id, chunk""")
def stsc_asof(spark, d):
    lr = line_runs(table(spark, d, "lineitem"))
    runs = lr.select("track_id", (R.exclusive_sum(F.col("count"), ["track_id"], ["run"]) + 1).alias("first_chunk"), F.col("duration").alias("samples"))
    chunks = R.total_duration(lr).select("track_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("samples"))).alias("chunk"))
    return R.chunk_runs(chunks, runs)


@query("ctts_runs", PK + f""", {DUR}, o as (select track_id, frame_no, xor(frame_no, 1) * 1000 - coalesce(sum(1000) over (partition by track_id order by frame_no rows between unbounded preceding and 1 preceding), 0)::bigint as off from pk),
    i as (select *, case when row_number() over {W} = 1 or off is distinct from lag(off) over {W} then 1 else 0 end as s from o), r as (select track_id, off as value, sum(s) over {UP}::bigint - 1 as run from i)
    select track_id, run, any_value(value) as value, count(*) as count from r group by track_id, run""")
def ctts_runs(spark, d):
    swapped = pk(spark, d).select("track_id", "frame_no", (F.col("frame_no").bitwiseXOR(F.lit(1).cast("long")) * 1000).alias("pts"), F.lit(1000).cast("long").alias("duration"))
    return R.composition_runs(swapped)


@query("sync_flags", PK + """, s as (select distinct track_id from pk where key)
    select track_id, frame_no, key or track_id not in (select track_id from s) as key from pk""")
def sync_flags(spark, d):
    packets = pk(spark, d)
    sync = packets.where("key").select("track_id", (F.col("frame_no") + 1).alias("sample_no_1"))
    out = R.sync_flags(packets.select("track_id", F.col("frame_no").alias("sample_no")), sync)
    return out.select("track_id", F.col("sample_no").alias("frame_no"), "key")


@query("duration_mode", PK + f""", v as (select track_id, frame_no, size // 10 as value from pk), c as (select *, row_number() over (partition by track_id, value order by frame_no) as c from v)
    select track_id, arg_max(value, (c, -frame_no)) as mode, max(c) as count from c group by track_id""")
def duration_mode(spark, d):
    values = pk(spark, d).select("track_id", "frame_no", F.expr("size div 10").alias("value"))
    return R.mode_first(values, ["track_id"], "value", ["frame_no"])


@query("split_packets", PK + """, n as (select track_id, frame_no, pts, size % 4 as n from pk), f as (select *, coalesce(sum(n) over (partition by track_id order by frame_no rows between unbounded preceding and 1 preceding), 0)::bigint as first from n where n > 0),
    e as (select *, unnest(range(n))::int as part from f) select track_id, frame_no, part, first + part as out_no, pts + part * 1024 as pts from e""")
def split_packets(spark, d):
    return S.split_packets(pk(spark, d), F.col("size") % 4, 1024)


@query("stream_info", PK + """select track_id, media, count(*) as packets, sum(size)::bigint as bytes, case when count(*) > 1 then (max(pts) - min(pts)) // (count(*) - 1) end as mean_gap from pk group by track_id, media""")
def stream_info(spark, d):
    return S.stream_info(pk(spark, d))


@query("reference_lists", PK + """, d as (select track_id, frame_no as poc, row_number() over w as n, coalesce(sum(key::bigint) over (partition by track_id order by xor(frame_no, 1) rows between unbounded preceding and current row), 0)::bigint as gop
    from pk window w as (partition by track_id order by xor(frame_no, 1))), b as (select c.track_id, c.poc, r.poc as ref_poc from d c join d r on r.track_id = c.track_id and r.gop = c.gop and r.n between c.n - 16 and c.n - 1),
    l as (select *, row_number() over (partition by track_id, poc order by ref_poc > poc, abs(ref_poc - poc)) - 1 as l0, row_number() over (partition by track_id, poc order by ref_poc < poc, abs(ref_poc - poc)) - 1 as l1,
    count(*) over p > 1 and (bool_and(ref_poc < poc) over p or bool_and(ref_poc > poc) over p) as same from b window p as (partition by track_id, poc))
    select track_id, poc, ref_poc, l0::int as list0, case when same and l1 < 2 then 1 - l1 else l1 end::int as list1 from l""")
def reference_lists(spark, d):
    pictures = pk(spark, d).select("track_id", F.col("frame_no").bitwiseXOR(F.lit(1).cast("long")).alias("decode_no"), F.col("frame_no").alias("poc"), "key")
    return S.reference_window(pictures)


@query("frame_num_unwrap", PK + "select track_id, frame_no, frame_no % 16 as frame_num, (frame_no * 5) % 16 as ref_num, case when (frame_no * 5) % 16 > frame_no % 16 then (frame_no * 5) % 16 - 16 else (frame_no * 5) % 16 end as unwrapped from pk")
def frame_num_unwrap(spark, d):
    return S.frame_number_unwrap(pk(spark, d).select("track_id", "frame_no", (F.col("frame_no") % 16).alias("frame_num"), (F.col("frame_no") * 5 % 16).alias("ref_num")), 16)


@query("segments", PK + """, t as (select track_id, max(pts) - min(pts) as duration from pk group by track_id), s as (select track_id, unnest(range((duration + 3599999999) // 3600000000)) as segment from t where duration > 0)
    select track_id, segment, segment * 3600000000 as start from s""")
def segments(spark, d):
    tracks = pk(spark, d).groupBy("track_id").agg((F.max("pts") - F.min("pts")).alias("duration"))
    return S.segments(tracks, 3_600_000_000)


@query("stable_timestamps", PK + f""", m as (select track_id, frame_no, size as stamp, max(size) over (partition by track_id order by frame_no rows between unbounded preceding and 1 preceding) as m from pk),
    g as (select track_id, frame_no, stamp from m where m is null or stamp >= m) select track_id, frame_no, stamp, lead(stamp) over {W} - stamp as duration from g""")
def stable_timestamps(spark, d):
    packets = pk(spark, d)
    return S.stable_timestamps(packets, packets.select("track_id", "frame_no", F.col("size").alias("stamp")))


@query("config_entries", PK + "select track_id, event_type, min(frame_no) as first_frame, row_number() over (partition by track_id order by min(frame_no))::int as entry from pk group by track_id, event_type")
def config_entries(spark, d):
    return S.swap_config(pk(spark, d), "event_type")


@query("filter_chain", PK + """, v as (select * from pk where media = 'VIDEO' and frame_no >= 10 and frame_no < 60) select track_id, frame_no, greatest(pts * 9 // 100 - 100, 0) as pts from v""")
def filter_chain(spark, d):
    return V.apply(pk(spark, d), "media=video,skip=10,limit=60,scale=9:100,shift=-100").select("track_id", "frame_no", "pts")


@query("virtual_frames", PK + f", {POS} select track_id, frame_no, position, size from pos where track_id = 3 and frame_no between 5 and 20")
def virtual_frames(spark, d):
    return V.VirtualMovie(pk(spark, d), 40).frames(3, 5, 20).select("track_id", "frame_no", "position", "size")
