"""Named queries of the edit algebra and of stream repair, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import ED_SQL, LR_SQL, PK_SQL, event_packets, line_runs, order_edits, table
from ..operators import edits as E
from ..operators import repair as X
from ..operators import runs as R

QUERIES, SQL = {}, {}
ED = f"""with {ED_SQL}, es as (select *, coalesce(sum(duration) over (partition by track_id order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as start from ed)"""
PK = f"with {PK_SQL} "
W = "(partition by track_id order by frame_no)"
UP = "(partition by track_id order by frame_no rows between unbounded preceding and current row)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def ed(spark, d):
    return order_edits(table(spark, d, "orders"))


def pk(spark, d):
    return event_packets(table(spark, d, "events"))


@query("edits_prefix", ED + ' select track_id, ord, start, start + duration as "end", duration, media_time from es')
def edits_prefix(spark, d):
    return E.movie_starts(ed(spark, d))


@query("edited_duration", ED + " select track_id, sum(duration)::bigint as duration, count(*) as edits from ed group by track_id")
def edited_duration(spark, d):
    return E.edited_duration(ed(spark, d))


MEDIA = "p as (select distinct o_custkey as track_id, (o_orderkey * 37) % 6000 as media from orders)"


@query("media_to_edited", ED + f""", {MEDIA}, j as (select p.track_id, media, ord, start + duration as e, case when media_time >= 0 and media >= media_time and media < media_time + duration then start + media - media_time
    when media_time >= 0 and media < media_time then start end as hit from p join es using (track_id))
    select track_id, media, coalesce(arg_min(hit, ord) filter (where hit is not null), max(e)) as edited from j group by track_id, media""")
def media_to_edited(spark, d):
    points = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), (F.col("o_orderkey") * 37 % 6000).alias("media")).distinct()
    return E.media_to_edited(points, ed(spark, d))


@query("edited_to_media", ED + """, p as (select distinct o_custkey as track_id, (o_orderkey * 37) % 6000 as edited from orders)
    select p.track_id, edited, case when media_time >= 0 then media_time + edited - start end as media from p left join es on es.track_id = p.track_id and start <= edited and edited < start + duration""")
def edited_to_media(spark, d):
    points = table(spark, d, "orders").select(F.col("o_custkey").alias("track_id"), (F.col("o_orderkey") * 37 % 6000).alias("edited")).distinct()
    return E.edited_to_media(points, ed(spark, d))


SPLIT = """s0 as (select *, least(duration, greatest(0, 1500 - start)) as l from es), sp as (
    select track_id, ord, 0 as side, start, l as duration, media_time from s0 where l > 0 union all
    select track_id, ord, 1, start + l, duration - l, case when media_time < 0 then media_time else media_time + l end from s0 where duration > l)"""


@query("split_edits", ED + f", {SPLIT} select track_id, ord, side, start, duration, media_time from sp")
def split_edits(spark, d):
    return E.split_edits(ed(spark, d), F.lit(1500))


@query("edits_on_edits", ED + """, hi as (select track_id, ord, duration + 300 as duration, case when media_time < 0 then -1 else (media_time * 3) % 4000 end as media_time from ed),
    pr as (select hi.track_id, hi.ord as h, es.ord as l, least(hi.media_time + hi.duration, es.start + es.duration) - greatest(hi.media_time, es.start) as duration,
      case when es.media_time < 0 then es.media_time else es.media_time + greatest(hi.media_time, es.start) - es.start end as media_time
      from hi join es on hi.track_id = es.track_id and hi.media_time >= 0 and hi.media_time < es.start + es.duration and hi.media_time + hi.duration > es.start
      union all select track_id, ord, -1, duration, media_time from hi where media_time < 0)
    select track_id, (row_number() over (partition by track_id order by h, l) - 1)::int as ord, duration, media_time from pr""")
def edits_on_edits(spark, d):
    lower = ed(spark, d)
    higher = lower.select("track_id", "ord", (F.col("duration") + 300).alias("duration"), F.when(F.col("media_time") < 0, F.col("media_time")).otherwise(F.col("media_time") * 3 % 4000).alias("media_time"))
    return E.edits_on_edits(lower, higher)


def _cut_sql(inside: str) -> str:
    pieces = []
    for lo, hi in (("0", "1000"), ("1000", "2500"), ("2500", "9223372036854775807")):
        pieces.append(f"select track_id, greatest(start, {lo}) as start, least(start + duration, {hi}) - greatest(start, {lo}) as duration, case when media_time < 0 then media_time else media_time + greatest(start, {lo}) - start end as media_time from es where start < {hi} and start + duration > {lo}")
    return ED + f", c as ({' union all '.join(pieces)}), n as (select *, (row_number() over (partition by track_id order by start) - 1)::int as ord from c) select track_id, ord, start, duration, media_time from n where {inside} (start >= 1000 and start < 2500)"


@query("cut_inner", _cut_sql(""))
def cut_inner(spark, d):
    return E.cut_inner(ed(spark, d), F.lit(1000), F.lit(2500))


@query("cut_outer", _cut_sql("not"))
def cut_outer(spark, d):
    return E.cut_outer(ed(spark, d), F.lit(1000), F.lit(2500))


@query("insert_gap", ED + f""", {SPLIT}, g as (select track_id, start as k1, side, duration, media_time from sp union all
    select track_id, least(1500, max(start + duration)), -1, 77, -1 from sp group by track_id)
    select track_id, (row_number() over (partition by track_id order by k1, side) - 1)::int as ord, duration::bigint as duration, media_time::bigint as media_time from g""")
def insert_gap(spark, d):
    return E.insert_gap(ed(spark, d), 1500, 77)


@query("paste_edits", ED + f""", {SPLIT}, src as (select track_id + 5 as track_id, ord, duration, media_time from ed), tot as (select track_id, sum(duration) as n from src group by track_id),
    u as (select track_id, side * 2 as k0, start as k1, duration, media_time from sp union all select track_id, 1, ord, duration, media_time from src
      union all select distinct ed.track_id, 1, 0, (select max(n) from tot), -1 from ed where track_id not in (select track_id from src)
      union all select distinct track_id, 0, 0, 1500, -1 from src where track_id not in (select track_id from ed))
    select track_id, (row_number() over (partition by track_id order by k0, k1) - 1)::int as ord, duration::bigint as duration, media_time::bigint as media_time from u""")
def paste_edits(spark, d):
    base = ed(spark, d)
    return E.paste(base, base.withColumn("track_id", F.col("track_id") + 5), 1500)


FRAMES = f"""{LR_SQL}, fr as (select track_id % 300 as track_id, track_id * 100 + run as frame_no, coalesce(sum(duration) over (partition by track_id % 300 order by track_id, run rows between unbounded preceding and 1 preceding), 0)::bigint as pts, duration from lr)"""


def _frames(spark, d):
    from pyspark.sql import Window

    lr = line_runs(table(spark, d, "lineitem")).withColumn("t", F.col("track_id") % 300)
    w = Window.partitionBy("t").orderBy("track_id", "run").rowsBetween(Window.unboundedPreceding, -1)
    return lr.select(F.col("t").alias("track_id"), (F.col("track_id") * 100 + F.col("run")).alias("frame_no"), F.coalesce(F.sum("duration").over(w), F.lit(0)).alias("pts"), "duration")


@query("edited_frames", ED + f""", {FRAMES} select es.track_id, ord, frame_no, start + greatest(pts, media_time) - media_time as movie_pts, least(pts + fr.duration, media_time + es.duration) - greatest(pts, media_time) as duration
    from es join fr on fr.track_id = es.track_id and media_time >= 0 and pts < media_time + es.duration and pts + fr.duration > media_time""")
def edited_frames(spark, d):
    return E.edited_frames(_frames(spark, d), ed(spark, d), 200)


@query("strip_chunks", ED + f""", {FRAMES}, k as (select fr.*, exists (select 1 from ed where ed.track_id = fr.track_id and media_time >= 0 and pts < media_time + ed.duration and pts + fr.duration > media_time) as kept from fr)
    select track_id, chunk, start, duration, dropped from (select track_id, frame_no as chunk, pts as start, duration, kept,
      coalesce(sum(case when kept then 0 else duration end) over (partition by track_id order by frame_no rows between unbounded preceding and 1 preceding), 0)::bigint as dropped from k) where kept""")
def strip_chunks(spark, d):
    chunks = _frames(spark, d).select("track_id", F.col("frame_no").alias("chunk"), F.col("pts").alias("start"), "duration")
    return E.strip_chunks(chunks, ed(spark, d), 200)


@query("find_gaps", ED + """, r as (select track_id, media_time, max(media_time + duration) over (partition by track_id order by media_time, ord rows between unbounded preceding and 1 preceding) as reach from ed where media_time >= 0)
    select track_id, coalesce(reach, 0) as gap_start, media_time as gap_end from r where media_time > coalesce(reach, 0)""")
def find_gaps(spark, d):
    return E.find_gaps(ed(spark, d))


@query("rescale_edits", ED + " select track_id, ord, duration * 90000 // 600 as duration, media_time from ed")
def rescale_edits(spark, d):
    return E.rescale_edits(ed(spark, d), 600, 90000)


@query("force_edit_list", ED + """ select track_id, ord, duration, media_time from ed union all
    select c_custkey, 0, 100, 0 from customer where c_custkey not in (select track_id from ed)""")
def force_edit_list(spark, d):
    tracks = table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.lit(100).cast("long").alias("duration"))
    return E.force_edit_list(tracks, ed(spark, d))


@query("retime", PK + "select track_id, frame_no, ((greatest(pts * 9 // 100 - 5000, 0) + 1501) // 3003) * 3003 as pts from pk")
def retime(spark, d):
    return X.retime(pk(spark, d), -5000, 9, 100, 3003).select("track_id", "frame_no", "pts")


@query("set_base", PK + "select track_id, frame_no, pts - (select min(pts) from pk) + 90000 as pts from pk")
def set_base(spark, d):
    return X.set_base(pk(spark, d), 90000).select("track_id", "frame_no", "pts")


@query("unwrap_pts", PK + f""", m as (select track_id, frame_no, (pts // 10) % 2147483648 as pts from pk), s as (select *, pts - lag(pts) over {W} as step from m)
    select track_id, frame_no, pts + sum(case when step < -1073741824 then 1 when step > 1073741824 then -1 else 0 end) over {UP}::bigint * 2147483648 as pts from s""")
def unwrap_pts(spark, d):
    wrapped = pk(spark, d).withColumn("pts", F.expr("pts div 10") % 2147483648)
    return X.unwrap(wrapped, 2147483648).select("track_id", "frame_no", "pts")


@query("fill_missing_pts", PK + f""", g as (select track_id, frame_no, case when not key then pts end as p, size as duration from pk)
    select track_id, frame_no, coalesce(p, last_value(p ignore nulls) over {UP} + coalesce(last_value(case when p is not null then duration end ignore nulls) over {UP}, 0)) as pts from g""")
def fill_missing_pts(spark, d):
    holes = pk(spark, d).select("track_id", "frame_no", F.when(~F.col("key"), F.col("pts")).alias("pts"), F.col("size").alias("duration"))
    return X.fill_missing(holes).select("track_id", "frame_no", "pts")


def _gop_pass(k: int, before: str, back: bool) -> str:
    order = "t desc, p is null, p desc" if back else "t, p is not null, p"
    last = "r.p1 + trunc((r.p1 - r.p2) / nullif(abs(r.t1 - r.t2), 0))::bigint"
    keep = lambda new, old: f"case when q is not null then {new} else {old} end"
    return f"""n{k} as materialized (select track_id, gop, t, p, row_number() over (partition by track_id, gop order by {order}) as i from {before}),
    r{k} as (select track_id, gop, i, t, p, p as p1, case when p is not null then t end as t1, null::bigint as p2, null::bigint as t2 from n{k} where i = 1
    union all select track_id, gop, i, t, q, {keep('q', 'p1')}, {keep('t', 't1')}, {keep('p1', 'p2')}, {keep('t1', 't2')} from (select n.*, coalesce(n.p, {last}) as q, r.p1, r.t1, r.p2, r.t2
    from r{k} r join n{k} n on n.track_id = r.track_id and n.gop = r.gop and n.i = r.i + 1) x)"""


@query("gop_pts_repair", f"with recursive {PK_SQL}, g0 as (select track_id, sum(key::int) over {UP}::bigint as gop, frame_no as t, case when frame_no % 4 < 2 then pts end as p from pk), "
    + ", ".join((_gop_pass(1, "g0", False), _gop_pass(2, "r1", True), _gop_pass(3, "r2", False))) + " select track_id, gop, t as temporal_ref, p as pts from r3")
def gop_pts_repair(spark, d):
    from ..operators import packets as P

    rows = P.gop_ids(pk(spark, d)).select("track_id", "gop", F.col("frame_no").alias("temporal_ref"), F.when(F.col("frame_no") % 4 < 2, F.col("pts")).alias("pts"))
    return X.gop_pts(rows)


@query("drift_correction", f"""with recursive {PK_SQL}, c as (select track_id, frame_no, media, pts, (count(*) filter (media = 'AUDIO') over (partition by track_id order by frame_no rows between unbounded preceding and 1 preceding) * 1024)::double / 48000 as clock,
    (count(*) filter (media = 'AUDIO') over n * 1024)::double / nullif(count(*) filter (media = 'VIDEO') over n * 48000, 0) as step from pk window n as (partition by track_id order by frame_no rows between current row and 599 following)),
    v as materialized (select *, row_number() over (partition by track_id order by frame_no) as i from c where media = 'VIDEO'),
    r as (select track_id, i, 0.0::double as video from v where i = 1 union all
      select v.track_id, v.i + 1, video + least(1.33::double * step, greatest((1 - 0.33::double) * step, step + least(1.0::double, abs(clock - video)) * (clock - video))) from r join v on v.track_id = r.track_id and v.i = r.i)
    select c.track_id, c.frame_no, c.media, c.pts, floor(case when c.media = 'AUDIO' then c.clock else r.video end * 1000 + 0.5)::bigint as fixed_pts
    from c left join v on c.track_id = v.track_id and c.frame_no = v.frame_no left join r on r.track_id = v.track_id and r.i = v.i""")
def drift_correction(spark, d):
    return X.drift(pk(spark, d))


@query("poc_unwrap", PK + f""", g as (select track_id, frame_no, frame_no % 16 as lsb, sum(key::int) over {UP} as g from pk), s as (select *, lsb - lag(lsb) over (partition by track_id, g order by frame_no) as step from g)
    select track_id, frame_no, lsb + sum(case when step <= -8 then 16 when step > 8 then -16 else 0 end) over (partition by track_id, g order by frame_no)::bigint as poc from s""")
def poc_unwrap(spark, d):
    return X.poc(pk(spark, d).withColumn("lsb", F.col("frame_no") % 16)).select("track_id", "frame_no", "poc")


@query("timecode_breaks", "with l as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as previous from conversations) select conv_id, turn, previous from l where previous + 1 <> turn")
def timecode_breaks(spark, d):
    return X.continuity_breaks(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "previous")


TC_SQL = """with t as (select event_id, (event_id // 2500) % 2 = 1 as drop, case when event_id % 97 = 0 then null else (event_id // 108000) % 24 end as hour, (event_id // 1800) % 60 as minute, (event_id // 30) % 60 as second,
    event_id % 30 + case when event_id % 501 = 0 then 1 else 0 end as frame, event_id // 2500 as part from events),
    b as (select *, lag(hour) over w as ph, lag(frame) over w as pf, lag(drop) over w as pd, hour * 3600 + minute * 60 + second - lag(hour * 3600 + minute * 60 + second) over w as step, hour * 3600 + minute * 60 + second as sec from t window w as (partition by part order by event_id)),
    k as (select *, case when drop then 30 else first_value(case when step = 1 and not drop and pd = drop and frame = 0 then pf + 1 end ignore nulls) over (partition by part order by event_id rows between unbounded preceding and 1 preceding) end as fps from b)
    select event_id, case when ph is null then hour is not null when hour is null or pd <> drop then true when step = 0 then (case when fps is null then frame - pf else (frame - pf + fps) % fps end) <> 1
    when step = 1 then case when fps is null then frame <> 0 else frame <> (case when drop and sec % 60 = 0 and sec % 600 <> 0 then 2 else 0 end) or pf <> fps - 1 end else true end as gap from k"""


@query("timecode_gaps", TC_SQL)
def timecode_gaps(spark, d):
    e = F.col("event_id")
    at = lambda n, m: (F.floor(e / n) % m).cast("bigint")
    rows = table(spark, d, "events").select(
        e, (at(2500, 2) == 1).alias("drop"), F.when(e % 97 != 0, at(108000, 24)).alias("hour"), at(1800, 60).alias("minute"), at(30, 60).alias("second"),
        (e % 30 + F.when(e % 501 == 0, 1).otherwise(0)).alias("frame"), F.floor(e / 2500).alias("part"),
    )
    return X.timecode_gaps(rows, "part", "event_id").select("event_id", "gap")
