"""Named queries of whole-movie verbs, kernels and sample arithmetic, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import LR_SQL, PK_SQL, event_packets, line_runs, table
from ..operators import movies as M
from ..operators.runs import exclusive_sum

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def pk(spark, d):
    return event_packets(table(spark, d, "events"))


PK = f"with {PK_SQL}"
#: Samples of every order: a line item's quantity as often as its line number says.
SAMPLES = f"""with {LR_SQL}, s0 as (select track_id, run, duration, unnest(range(count)) as k from lr), s as materialized (select track_id, row_number() over w - 1 as sample, duration,
    coalesce(sum(duration) over (partition by track_id order by run, k rows between unbounded preceding and 1 preceding), 0)::bigint as start from s0 window w as (partition by track_id order by run, k)),
    g as (select track_id, sum(duration)::bigint // 3 as gap_start, sum(duration)::bigint * 2 // 3 as gap_end from s group by track_id having sum(duration) > 30)"""
LEFT = "k as materialized (select s.*, coalesce(sum(s.duration) over (partition by s.track_id order by start rows between unbounded preceding and 1 preceding), 0)::bigint as new_start from s left join g on s.track_id = g.track_id and start >= gap_start and start + s.duration <= gap_end + 1 where g.track_id is null)"


def sample_runs(spark, d):
    return line_runs(table(spark, d, "lineitem")).where("count > 0")


def samples(rows):
    """Samples of runs: numbers and times are sums over runs, so samples need no sort."""
    lasts = F.coalesce("duration", F.lit(0))
    before = lambda c: exclusive_sum(c, ["track_id"], ["run"]).cast("long")
    rows = rows.withColumns({"__n": before(F.col("count")), "__t": before(F.col("count") * lasts)}).withColumn("k", F.explode(F.expr("sequence(0, count - 1)")))
    return rows.select("track_id", (F.col("__n") + F.col("k")).alias("sample"), (F.col("__t") + F.col("k") * lasts).alias("start"), "duration")


def thirds(rows):
    return rows.groupBy("track_id").agg(F.sum(F.col("count") * F.col("duration")).alias("t")).where("t > 30").selectExpr("track_id", "t div 3 as gap_start", "t * 2 div 3 as gap_end")


@query("cut_chunks_samples", f"{SAMPLES}, {LEFT} select track_id, sample, new_start from k")
def cut_chunks_samples(spark, d):
    rows = sample_runs(spark, d)
    return M.cut_to_gaps(samples(rows), thirds(rows))[0].select("track_id", "sample", "new_start")


@query("cut_chunks_edits", f"""{SAMPLES}, {LEFT}, i as (select track_id, 0 as a, gap_start as b from g union all select track_id, gap_end + 1, t from g join (select track_id, sum(duration)::bigint as t from s group by track_id) using (track_id)
    union all select track_id, 0, sum(duration)::bigint from s group by track_id having sum(duration) <= 30)
    select i.track_id, (row_number() over (partition by i.track_id order by a) - 1)::int as ord, new_start + a - start as media_time, b - a as duration from i asof join k on i.track_id = k.track_id and i.a >= k.start where b > a""")
def cut_chunks_edits(spark, d):
    rows = sample_runs(spark, d)
    return M.cut_to_gaps(samples(rows), thirds(rows))[1]


@query("split_chunks", f"{SAMPLES} select track_id, sample, case when start + duration <= 100 then 0 else 1 end as down, case when start < 100 then 0 else 1 end as up from s")
def split_chunks(spark, d):
    rows = samples(sample_runs(spark, d)).withColumn("cut", F.lit(100))
    return M.split_chunks(M.split_chunks(rows, "cut", at="start").withColumnRenamed("part", "down"), "cut", True, "start").select("track_id", "sample", "down", F.col("part").alias("up"))


@query("set_frame_rate", f"""with {LR_SQL}, t as (select track_id, run, count, duration, sum(count) over (partition by track_id)::bigint as n, sum(count * duration) over (partition by track_id)::bigint as a from lr), u as (select *, a // n as scale from t)
    select track_id, run, case when scale >= 25 then scale else 60000 end as timescale, case when scale >= 25 then duration else floor(duration * ((600 * a)::double / n) * 100)::bigint end as duration from u""")
def set_frame_rate(spark, d):
    return M.set_frame_rate(line_runs(table(spark, d, "lineitem")), 1).select("track_id", "run", "timescale", "duration")


@query("fragment_packets", """with f as (select o_custkey as track_id, o_orderkey * 1000 as decode_time, o_orderkey as "offset", list((l_quantity)::bigint order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as sizes from orders join lineitem on l_orderkey = o_orderkey group by all),
    g as (select *, row_number() over w - 1 as fragment, (lead(decode_time) over w - decode_time) // len(sizes) as each_, sum(len(sizes)) over w - len(sizes) as first from f window w as (partition by track_id order by decode_time)),
    h as (select * replace (coalesce(each_, lag(each_) over (partition by track_id order by decode_time), 0) as each_) from g), s as (select *, unnest(range(len(sizes))) as i from h)
    select track_id, fragment, (first + i)::bigint as frame_no, decode_time + i * each_ as pts, each_ as duration, "offset" + coalesce(list_sum(sizes[1:i]), 0)::bigint as "offset", sizes[i + 1] as size, i = 0 as key from s""")
def fragment_packets(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sizes = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))))
    rows = lines.groupBy("o_custkey", "o_orderkey").agg(F.transform(sizes, lambda x: x["q"]).alias("sizes"))
    none = F.lit(None).cast("array<long>")
    return M.fragment_packets(rows.select(F.col("o_custkey").alias("track_id"), (F.col("o_orderkey") * 1000).alias("decode_time"), F.col("o_orderkey").alias("offset"), "sizes", none.alias("durations")))


@query("timecode_lookup", f"{PK}, c as (select track_id, pts as start, event_id as counter from pk where key) select p.track_id, p.frame_no, p.pts, c.counter, c.start as first_pts from pk p asof left join c on p.track_id = c.track_id and p.pts >= c.start")
def timecode_lookup(spark, d):
    p = pk(spark, d)
    return M.timecodes_at(p, p.where("key").select("track_id", F.col("pts").alias("start"), F.col("event_id").alias("counter"))).select("track_id", "frame_no", "pts", "counter", "first_pts")


@query("clip_packets", f"""{PK}, m as (select track_id, (min(pts) + max(pts)) // 2 as mid from pk group by track_id), r as (select pk.*, bool_or(event_type = 'click') over w as seen, bool_or(pts >= 1704200000000000) over w as done from pk window w as (partition by track_id order by frame_no)),
    b as (select track_id, min(frame_no) as first from r where seen and key and media = 'VIDEO' and pts > 1704100000000000 group by track_id)
    select r.track_id, frame_no, row_number() over (partition by r.track_id order by frame_no) - 1 as clip_no from r join b on r.track_id = b.track_id and frame_no >= first where not done""")
def clip_packets(spark, d):
    rows = pk(spark, d).withColumn("config", F.col("event_type") == "click")
    return M.clip(rows, 1704100000000000, 1704200000000000).select("track_id", "frame_no", "clip_no")


@query("tag_gaps", f"{PK} select track_id, frame_no, media, lead(pts) over (partition by track_id, media order by frame_no) - pts as gap from pk")
def tag_gaps(spark, d):
    return M.tag_gaps(pk(spark, d)).select("track_id", "frame_no", "media", "gap")


CONCAT = f"with {LR_SQL}, m as (select track_id as movie, track_id % 50 as track_id, run, count, duration from lr)"


@query("concat_runs", f"""{CONCAT} select movie, track_id, run, row_number() over w - 1 as new_run, coalesce(sum(count) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as first_sample,
    coalesce(sum(count * duration) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start from m window w as (partition by track_id order by movie, run)""")
def concat_runs(spark, d):
    rows = line_runs(table(spark, d, "lineitem")).select(F.col("track_id").alias("movie"), (F.col("track_id") % 50).alias("track_id"), "run", "count", "duration")
    return M.concat_runs(rows).select("movie", "track_id", "run", "new_run", "first_sample", "start")


@query("block_of_frame", f"""with {LR_SQL}, b as (select track_id, run, count, sum(count) over (partition by track_id order by run) - count as first from lr), f as (select distinct l_orderkey as track_id, l_partkey % 20 as frame_no from lineitem)
    select f.track_id, f.frame_no, case when frame_no < first + count then run end::bigint as block, case when frame_no < first + count then frame_no - first end::bigint as place from f asof join b on f.track_id = b.track_id and f.frame_no >= b.first""")
def block_of_frame(spark, d):
    lines = table(spark, d, "lineitem")
    blocks = line_runs(lines).select("track_id", F.col("run").alias("block"), F.col("count").alias("n_frames"))
    return M.blocks_of_frames(blocks, lines.select(F.col("l_orderkey").alias("track_id"), (F.col("l_partkey") % 20).alias("frame_no")).distinct())


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


VEC = "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings)"
_SINC = ", ".join(f"{t!r}::double" for t in K.sinc_kernel(40, 0.1))


@query("sinc_low_pass", f"{VEC}, p as (select vec_id, x, unnest(range(25)) as i from e) select vec_id, i, round(list_sum(list_transform(range(1, 41), lambda k: x[i + k] * [{_SINC}][k])), 6) as y from p")
def sinc_low_pass(spark, d):
    out = vectors(spark, d).select("vec_id", F.posexplode(K.convolve(F.col("x"), K.sinc_kernel(40, 0.1))).alias("i", "y"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


_L = "case when abs({0}) > 3 then 0.0 when {0} = 0 then 1.0 else (3 * sin(pi() * ({0})) * sin(pi() * ({0}) / 3)) / (pi() * pi() * ({0}) * ({0})) end"
_TERMS = [(k, _L.format(f"(p + {k} - at_)")) for k in (-2, -1, 0, 1, 2, 3)]


@query("lanczos_resample", f"""{VEC}, o as (select vec_id, x, unnest(range(200)) as i from e), q as (select *, 3 + i * {44100 / 48000!r}::double as at_ from o), w as (select *, floor(at_)::int as p from q), v as (select * from w where p < len(x) - 3)
    select vec_id, i, round(case when p - at_ < -0.001 then ({' + '.join(f'x[p + {k + 1}] * ({t})' for k, t in _TERMS)}) / ({' + '.join(f'({t})' for _, t in _TERMS)}) else x[p + 1] end, 6) as y from v""")
def lanczos_resample(spark, d):
    out = vectors(spark, d).select("vec_id", F.posexplode(K.resample(F.col("x"), 44100, 48000)).alias("i", "y"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("y", 6).alias("y"))


@query("whole_taps", f"""{VEC}, a as (select vec_id, list_transform(x[1:6], lambda v: abs(v) + 0.01) as x from e), s as (select vec_id, i, x[i + 1] * 16384 / (0.0 + x[1] + x[2] + x[3] + x[4] + x[5] + x[6]) as v from (select *, unnest(range(6)) as i from a)),
    r as (select *, 16384 - sum(floor(v)) over (partition by vec_id) as short, row_number() over (partition by vec_id order by v - floor(v) desc, i) as k from s)
    select vec_id, i, floor(v)::bigint + (k <= short)::bigint as tap from r""")
def whole_taps(spark, d):
    taps = F.transform(F.slice("x", 1, 6), lambda v: F.abs(v) + 0.01)
    return vectors(spark, d).select("vec_id", F.posexplode(K.whole_taps(taps, 14)).alias("i", "tap")).select("vec_id", F.col("i").cast("long").alias("i"), "tap")


@query("mix_samples", f"""{VEC}, m as (select vec_id, x[1] * 0.7 as a, x[2] * 1.0 as b, x[3] * 0.5 as c from e)
    select vec_id, floor(greatest(-1.0, least(1.0, (0.0 + a + b + c) - 1.0 * a * b * c)) * 32768)::bigint & 65535 as mixed, floor((0.0 + b) * 32768)::bigint & 65535 as solo from m""")
def mix_samples(spark, d):
    x = [F.get("x", F.lit(i)) for i in range(3)]
    return vectors(spark, d).select("vec_id", K.mix(x, [0.7, 1.0, 0.5]).alias("mixed"), K.mix(x, [0.7, 1.0, 0.5], [True, False, True]).alias("solo"))


@query("zip_tracks", """with a as (select vec_id as block, embedding[1]::double as v from embeddings), b as (select vec_id + 3 as block, embedding[2]::double as v from embeddings)
    select coalesce(a.block, b.block) as block, coalesce(a.v, 0) as left_, coalesce(b.v, 0) as right_ from a full join b on a.block = b.block""")
def zip_tracks(spark, d):
    e = vectors(spark, d)
    a = e.select(F.col("vec_id").alias("block"), F.get("x", F.lit(0)).alias("left_"))
    b = e.select((F.col("vec_id") + 3).alias("block"), F.get("x", F.lit(1)).alias("right_"))
    return a.join(b, "block", "full").select("block", F.coalesce("left_", F.lit(0.0)).alias("left_"), F.coalesce("right_", F.lit(0.0)).alias("right_"))


@query("number_util", """select l_orderkey, l_linenumber, l_partkey, (1::bigint << (length(bin(greatest(l_partkey - 1, 0))) - (l_partkey <= 1)::int))::bigint as power, (l_partkey - 500) - floor((l_partkey - 500) / 360.0)::bigint * 360 as wrapped,
    list_sum(list_transform(range(8), lambda k: ((l_partkey % 256) >> k & 1) << (7 - k)))::int as reversed, (l_partkey < 500)::int as sign, case when l_partkey * 3000000 <= 2147483647 then (l_partkey * 3000000)::int end as checked from lineitem""")
def number_util(spark, d):
    x = F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.next_power_of_two(x).alias("power"), K.wrap(x - 500, 360).alias("wrapped"), K.reverse_bits(x % 256).alias("reversed"), K.odd_sign(x - 500).alias("sign"), K.whole_int(x * 3000000).alias("checked"))


@query("array_moves", f"{VEC}, a as (select vec_id, list_transform(x[1:5], lambda v: floor(v * 100)::bigint) as a from e) select vec_id, list_concat(a[3:5], a[1:2]) as rotated, [a[4], a[2], a[3], a[1], a[5]] as swapped, [a[5], a[1], a[3]] as permuted from a")
def array_moves(spark, d):
    rows = vectors(spark, d).select("vec_id", F.transform(F.slice("x", 1, 5), lambda v: F.floor(v * 100).cast("long")).alias("a"))
    return rows.select("vec_id", K.rotate(F.col("a"), 2).alias("rotated"), K.swap(F.col("a"), 0, 3).alias("swapped"), K.permute(F.col("a"), [4, 0, 2]).alias("permuted"))


@query("write_bits", """select l_orderkey, l_linenumber, lower(lpad(to_hex(((l_partkey & 4095) << 12) | ((l_linenumber & 7) << 9) | ((l_suppkey & 31) << 4)), 6, '0')) as bytes, (l_suppkey << 8)::bigint as deeper, (l_partkey >> 4)::bigint as flatter from lineitem""")
def write_bits(spark, d):
    c = F.col
    packed = K.write_bits([(c("l_partkey"), 12), (c("l_linenumber"), 3), (c("l_suppkey"), 5)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.hex(packed)).alias("bytes"), K.scale_depth(c("l_suppkey"), 8, 16).alias("deeper"), K.scale_depth(c("l_partkey"), 16, 12).alias("flatter"))
