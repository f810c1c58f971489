"""Named queries over the scalar, binary, pixel and audio functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import binary as B
from ..functions import pixels as X
from ..functions import rational as R
from ..functions import strings as S
from ..functions import timecode as T
from ..model import PK_SQL, event_packets, table
from ..operators import runs

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PK = f"with {PK_SQL} "


def frames(spark, d):
    return event_packets(table(spark, d, "events")).select("event_id", (F.col("event_id") * 997).alias("frame"))


def _tc(f: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%02d', {f} // 30 // 3600, {f} // 30 // 60 % 60, {f} // 30 % 60, {f} % 30)"


@query("timecode_ndf", f"select event_id, {_tc('(event_id * 997)', ':')} as timecode from events")
def timecode_ndf(spark, d):
    return frames(spark, d).select("event_id", T.format_timecode(F.col("frame"), 30).alias("timecode"))


DROP = "(f + 18 * (f // 17982) + 2 * ((f % 17982 - 2) // 1798))"


@query("timecode_df", f"with t as (select event_id, event_id * 997 as f from events), u as (select event_id, {DROP} as n from t) select event_id, {_tc('n', ';')} as timecode from u")
def timecode_df(spark, d):
    return frames(spark, d).select("event_id", T.format_timecode(F.col("frame"), 30, True).alias("timecode"))


@query("timecode_parse", "select event_id, event_id * 997 as frame, event_id * 997 as ndf, event_id * 997 as df from events")
def timecode_parse(spark, d):
    f = frames(spark, d)
    return f.select("event_id", "frame", T.parse_timecode(T.format_timecode(F.col("frame"), 30), 30).alias("ndf"), T.parse_timecode(T.format_timecode(F.col("frame"), 30, True), 30).alias("df"))


@query("timecode_round", "select event_id, (2 * value2 // 1001 + 1) // 2 as frame from (select event_id, event_id * 997 as value2 from events)")
def timecode_round(spark, d):
    return frames(spark, d).select("event_id", T.timecode_frame(F.col("frame"), 1001).alias("frame"))


@query("mac_time", "select o_orderkey, epoch(o_orderdate)::bigint + 2082844800 as mac, epoch(o_orderdate)::bigint as unix from orders")
def mac_time(spark, d):
    unix = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    return table(spark, d, "orders").select("o_orderkey", T.unix_to_mac(unix).alias("mac")).withColumn("unix", T.mac_to_unix(F.col("mac")))


@query("period_parse", "select o_orderkey, (o_orderkey % 30) * 3600000 + (o_orderkey % 60) * 60000 + (o_orderkey % 61) * 1000 + 250 as ms, null::bigint as bad from orders")
def period_parse(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("PT"), (k % 30).cast("string"), F.lit("H"), (k % 60).cast("string"), F.lit("M"), (k % 61).cast("string"), F.lit(".25S"))
    return table(spark, d, "orders").select("o_orderkey", T.parse_period(text).alias("ms"), T.parse_period(F.lit("1H")).cast("long").alias("bad"))


@query("dpx_date", "select o_orderkey, epoch(o_orderdate)::bigint as plain, epoch(o_orderdate)::bigint + 8 * 3600 as west, epoch(o_orderdate)::bigint - 19800 as east, null::bigint as bad from orders")
def dpx_date(spark, d):
    text = F.date_format(F.expr("cast(o_orderdate as timestamp_ntz)"), "yyyy:MM:dd:HH:mm:ss")
    return table(spark, d, "orders").select(
        "o_orderkey", T.parse_dpx_date(text).alias("plain"), T.parse_dpx_date(F.concat(text, F.lit(":-08"))).alias("west"), T.parse_dpx_date(F.concat(text, F.lit(":+0530"))).alias("east"), T.parse_dpx_date(F.lit("")).cast("long").alias("bad")
    )


@query("rational_ops", """with r as (select distinct l_orderkey as a, l_partkey as b, l_suppkey as c, l_linenumber::bigint as d from lineitem)
    select a, b, c, d, gcd(a, b) as g, a // gcd(a, b) as num, b // gcd(a, b) as den, a * d + c * b as plus_num, b * d as plus_den, a * d - c * b as minus_num, a * c as times_num, a * d as over_num, b * c as over_den, a * d < c * b as less from r""")
def rational_ops(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_linenumber").cast("long").alias("d")).distinct()
    x, y = R.rational(F.col("a"), F.col("b")), R.rational(F.col("c"), F.col("d"))
    low, plus = R.reduce(x), R.plus(x, y)
    return r.select("a", "b", "c", "d", R.gcd(F.col("a"), F.col("b")).alias("g"), low["num"].alias("num"), low["den"].alias("den"), plus["num"].alias("plus_num"), plus["den"].alias("plus_den"),
                    R.minus(x, y)["num"].alias("minus_num"), R.times(x, y)["num"].alias("times_num"), R.over(x, y)["num"].alias("over_num"), R.over(x, y)["den"].alias("over_den"), R.less(x, y).alias("less"))


@query("rational_parse", "select p_partkey, p_partkey as num, p_size::bigint + 1 as den, p_partkey as whole, true as bad from part")
def rational_parse(spark, d):
    p = table(spark, d, "part")
    key, den = F.col("p_partkey").cast("string"), (F.col("p_size") + 1).cast("string")
    two = R.parse(F.concat_ws(":", key, den))
    return p.select("p_partkey", two["num"].alias("num"), two["den"].alias("den"), R.parse(key)["num"].alias("whole"), R.parse(F.concat(key, F.lit(".5")))["num"].isNull().alias("bad"))


@query("rescale", "select l_orderkey, l_linenumber, l_partkey, l_orderkey * 90000 // 48000 as up, (l_orderkey - 3000) * 1001 // 30000 as down from lineitem")
def rescale(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.rescale(k, 48000, 90000).alias("up"), R.rescale(k - 3000, 30000, 1001).alias("down"))


@query("md5_frames", "select doc_id, md5(text) as digest from documents")
def md5_frames(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("byte_histogram", "with b as (select unnest(regexp_extract_all(hex(encode(text)), '..')) as h from documents) select ('0x' || h)::int as value, count(*) as count from b group by h")
def byte_histogram(spark, d):
    return runs.byte_counts(table(spark, d, "documents").select("text"))


@query("dictionary_codes", "with c as (select source, lang as value, count(*) as count from documents group by all) select source, value, count, least(2, row_number() over (partition by source order by count desc, value) - 1)::bigint as code from c")
def dictionary_codes(spark, d):
    docs = table(spark, d, "documents").select("source", F.col("lang").alias("value"))
    return runs.dictionary_codes(docs, ["source"], "value", 2)


@query("varint_roundtrip", "select o_orderkey, o_orderkey as ber, o_orderkey as ebml, case when o_orderkey < 127 then 1 when o_orderkey < 16383 then 2 else 3 end as n from orders")
def varint_roundtrip(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", B.from_ber32(B.ber32(k)).alias("ber"), B.from_ebml(B.ebml(k)).alias("ebml"), B.ebml_length(k).alias("n"))


@query("varint_bytes", "select o_orderkey, upper(printf('%02x%02x%02x%02x', 128 + (o_orderkey >> 21), 128 + ((o_orderkey >> 14) & 127), 128 + ((o_orderkey >> 7) & 127), o_orderkey & 127)) as ber from orders")
def varint_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", B.ber32(F.col("o_orderkey")).alias("ber"))


@query("golomb", """with v as (select l_orderkey, l_linenumber, l_partkey, l_partkey - 100 as x from lineitem), g as (select *, case when x > 0 then 2 * x - 1 else -2 * x end as code from v)
    select l_orderkey, l_linenumber, l_partkey, code, repeat('0', length(bin(code + 1)) - 1) || bin(code + 1) as bits, x as back from g""")
def golomb(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.golomb(F.col("l_partkey") - 100).alias("code"))
    v = v.withColumn("bits", B.exp_golomb_bits(F.col("code")))
    return v.withColumn("back", B.from_golomb(B.from_exp_golomb_bits(F.concat("bits", F.lit("0101")))))


@query("bit_pack", "select l_orderkey, l_linenumber, l_partkey, (l_orderkey << 16) | (l_partkey & 65535) as packed, l_orderkey as high, l_partkey & 65535 as low from lineitem")
def bit_pack(spark, d):
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.pack(F.col("l_orderkey"), F.col("l_partkey"), 16).alias("packed"))
    return v.withColumns({"high": B.unpack_high(F.col("packed"), 16), "low": B.unpack_low(F.col("packed"), 16)})


@query("read_bits", "select n_nationkey, ascii(n_name[1]) >> 4 as nibble, ascii(n_name[1])::bigint * 256 + ascii(n_name[2]) as be, ascii(n_name[2])::bigint * 256 + ascii(n_name[1]) as le from nation")
def read_bits(spark, d):
    data = F.encode("n_name", "UTF-8")
    return table(spark, d, "nation").select("n_nationkey", B.read_bits(data, 0, 4).cast("int").alias("nibble"), B.uint_be(data, 0, 2).alias("be"), B.uint_le(data, 0, 2).alias("le"))


@query("nal_escape", """with h as (select o_orderkey, lpad(hex(o_orderkey % 4), 2, '0') as b from orders) select o_orderkey, '010000' || '03' || b || 'FF' as escaped, '010000' || b || 'FF' as back from h""")
def nal_escape(spark, d):
    raw = F.concat(F.lit("010000"), F.lpad(F.hex(F.col("o_orderkey") % 4), 2, "0"), F.lit("FF"))
    v = table(spark, d, "orders").select("o_orderkey", B.escape_nal(raw).alias("escaped"))
    return v.withColumn("back", B.unescape_nal(F.col("escaped")))


@query("start_code_segments", "select doc_id, (generate_subscripts(p, 1) - 1)::int as segment, length(unnest(p))::bigint as n_chars from (select doc_id, string_split(text, chr(10)) as p from documents)")
def start_code_segments(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("segment", "s"))
    return docs.select("doc_id", "segment", F.length("s").cast("long").alias("n_chars"))


EMB = "e as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 100 + 0.5)::int) as v from embeddings)"


def blocks(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100 + 0.5).cast("int")).alias("v"))


@query("block_stats", f"""with {EMB}, r as (select *, list_reverse(v) as w from e)
    select vec_id, list_sum(v)::bigint as total, list_sum(list_transform(v, lambda x: x * x))::bigint as squares, list_sum(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2])))::bigint as sad,
    list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as ssd from r""")
def block_stats(spark, d):
    v = F.col("v")
    return blocks(spark, d).select("vec_id", X.block_sum(v).alias("total"), X.block_sum(F.transform(v, lambda x: x * x)).alias("squares"), X.sad(v, F.reverse(v)).alias("sad"), X.ssd(v, F.reverse(v)).alias("ssd"))


@query("psnr", f"""with {EMB}, r as (select vec_id, list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::double as e from e)
    select vec_id, floor(10 * log10(65025.0::double * 64 / e) * 1000)::bigint as psnr_milli from r where e > 0""")
def psnr(spark, d):
    v = F.col("v")
    out = blocks(spark, d).select("vec_id", X.psnr(X.ssd(v, F.reverse(v)).cast("double"), F.lit(64)).alias("p"))
    return out.where("p is not null").select("vec_id", F.floor(F.col("p") * 1000).cast("long").alias("psnr_milli"))


PIX = "p as (select l_orderkey, l_linenumber, l_partkey, (l_orderkey * 7 % 256)::int as y, (l_partkey * 13 % 256)::int as u, (l_suppkey * 31 % 256)::int as v from lineitem)"


def pixels(spark, d):
    k = lambda c, m: (F.col(c) * m % 256).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", k("l_orderkey", 7).alias("y"), k("l_partkey", 13).alias("u"), k("l_suppkey", 31).alias("v"))


def _level(x: str) -> str:
    return f"greatest(0, least(255, ({x} + 128) >> 8))::int"


@query("yuv_rgb", f"with {PIX} select l_orderkey, l_linenumber, l_partkey, y, u, v, {_level('298 * (y - 16) + 409 * (v - 128)')} as r, {_level('298 * (y - 16) - 100 * (u - 128) - 208 * (v - 128)')} as g, {_level('298 * (y - 16) + 516 * (u - 128)')} as b from p")
def yuv_rgb(spark, d):
    return pixels(spark, d).withColumn("c", X.yuv_to_rgb(F.col("y"), F.col("u"), F.col("v"))).select("l_orderkey", "l_linenumber", "l_partkey", "y", "u", "v", "c.*")


def _plane(x: str, base: int) -> str:
    return f"greatest(0, least(255, (({x} + 128) >> 8) + {base}))::int"


@query("rgb_yuv", f"with {PIX} select l_orderkey, l_linenumber, l_partkey, {_plane('66 * y + 129 * u + 25 * v', 16)} as y, {_plane('-38 * y - 74 * u + 112 * v', 128)} as u, {_plane('112 * y - 94 * u - 18 * v', 128)} as v from p")
def rgb_yuv(spark, d):
    return pixels(spark, d).withColumn("c", X.rgb_to_yuv(F.col("y"), F.col("u"), F.col("v"))).select("l_orderkey", "l_linenumber", "l_partkey", "c.*")


def _list(n: str, body: str) -> str:
    return f"list_transform(range({n}), lambda i: {body})"


@query("fir_filter", f"with {EMB} select vec_id, {_list('60', '(v[i + 1] + 4 * v[i + 2] + 6 * v[i + 3] + 4 * v[i + 4] + v[i + 5] + 8) >> 4')} as out from e")
def fir_filter(spark, d):
    return blocks(spark, d).select("vec_id", X.fir(F.col("v"), [1, 4, 6, 4, 1], 4).alias("out"))


@query("resample", f"""with {EMB}, t as (select [[0, 128, 0, 0], [-9, 111, 29, -3], [-8, 72, 72, -8], [-3, 29, 111, -9]] as t)
    select vec_id, {_list('48', '(' + ' + '.join(f'v[greatest(0, least(63, (i * 5 >> 2) + {k - 1})) + 1] * t[(i * 5 & 3) + 1][{k + 1}]' for k in range(4)) + ' + 64) >> 7')} as out from e, t""")
def resample(spark, d):
    return blocks(spark, d).select("vec_id", X.resample4(F.col("v"), 5, 48).alias("out"))


@query("hadamard", f"with {EMB} select vec_id, {_list('8', 'list_sum(list_transform(range(8), lambda j: case when bit_count((i & j)::int) % 2 = 0 then v[j + 1] else -v[j + 1] end))::int')} as out from e")
def hadamard(spark, d):
    return blocks(spark, d).select("vec_id", X.hadamard8(F.slice("v", 1, 8)).alias("out"))


@query("integer_transform", f"with {EMB} select vec_id, [v[1] + v[2] + v[3] + v[4], 2 * v[1] + v[2] - v[3] - 2 * v[4], v[1] - v[2] - v[3] + v[4], v[1] - 2 * v[2] + 2 * v[3] - v[4]] as out from e")
def integer_transform(spark, d):
    return blocks(spark, d).select("vec_id", X.integer_transform4(F.slice("v", 1, 4)).alias("out"))


@query("crop", f"with {EMB} select vec_id, list_concat(list_concat(v[19:21], v[27:29]), v[35:37]) as out from e")
def crop(spark, d):
    return blocks(spark, d).select("vec_id", X.crop(F.col("v"), 8, 2, 2, 3, 3).alias("out"))


@query("subsample", f"with {EMB} select vec_id, {_list('32', '(v[2 * i + 1] + v[2 * i + 2] + 1) >> 1')} as out from e")
def subsample(spark, d):
    return blocks(spark, d).select("vec_id", X.subsample_pairs(F.col("v")).alias("out"))


@query("first_mismatch", f"with {EMB}, n as (select a.vec_id, list_filter(range(64), lambda i: a.v[i + 1] <> b.v[i + 1])[1] as at_ from e a join e b on b.vec_id = a.vec_id + 1) select vec_id, at_ as place from n")
def first_mismatch(spark, d):
    a, b = blocks(spark, d), blocks(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", X.first_difference(F.col("v"), F.col("w")).alias("place"))


@query("downmix", f"""with {EMB} select vec_id, {_list('64', 'floor(greatest(-1.0, least(1.0, (v[i + 1] / 100.0::double + v[64 - i] / 100.0::double) - (v[i + 1] / 100.0::double) * (v[64 - i] / 100.0::double))) * 32767 + 0.5)::int')} as out from e""")
def downmix(spark, d):
    mixed = F.zip_with("v", F.reverse("v"), lambda x, y: B.to_pcm16(A.mix_levels(F.array(x / 100.0, y / 100.0))))
    return blocks(spark, d).select("vec_id", mixed.alias("out"))


@query("interleave_channels", f"with {EMB} select vec_id, {_list('128', 'case when i % 2 = 0 then v[i // 2 + 1] else v[64 - i // 2] end')} as out from e")
def interleave_channels(spark, d):
    return blocks(spark, d).select("vec_id", A.interleave(F.col("v"), F.reverse("v")).alias("out"))


@query("pcm_reblock", f"""with {EMB}, x as (select vec_id % 7 as track_id, (row_number() over (partition by vec_id % 7 order by vec_id) - 1) * 64 as base, v from e), y as (select track_id, base + unnest(range(64)) as pos, unnest(v) as s from x)
    select track_id, pos // 100 as block, list(s order by pos) as samples from y group by track_id, pos // 100""")
def pcm_reblock(spark, d):
    rows = blocks(spark, d).withColumn("track_id", F.col("vec_id") % 7)
    return A.reblock(rows, "track_id", "vec_id", "v", 100)


@query("pcm16", "select n_nationkey, list_transform(range(length(n_name) // 2), lambda i: ascii(n_name[2 * i + 1]) + 256 * ascii(n_name[2 * i + 2])) as samples from nation")
def pcm16(spark, d):
    return table(spark, d, "nation").select("n_nationkey", B.pcm16(F.encode("n_name", "UTF-8")).alias("samples"))


@query("json_props", "select event_id, json_extract(props, '$.k')::bigint as k, to_json({'event': event_type, 'k': json_extract(props, '$.k')::bigint})::varchar as packed from events")
def json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), k.alias("k"))).alias("packed"))


@query("fourcc", "select n_nationkey, substr(n_name, 1, 4) as code, ascii(n_name[1])::bigint * 16777216 + ascii(n_name[2]) * 65536 + ascii(n_name[3]) * 256 + ascii(n_name[4]) as number from nation where length(n_name) >= 4")
def fourcc(spark, d):
    return table(spark, d, "nation").where("length(n_name) >= 4").select("n_nationkey", B.fourcc_number(F.encode("n_name", "UTF-8")).alias("number")).withColumn("code", B.fourcc(F.col("number")))


@query("path_split", "select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as parts, regexp_replace(url, '\\.[^./]*$', '') as stem, lower(regexp_extract(url, '\\.([^./]+)$', 1)) as ext from pages")
def path_split(spark, d):
    return table(spark, d, "pages").select("page_id", S.split_tokens(F.col("url"), "/").alias("parts"), S.remove_extension(F.col("url")).alias("stem"), S.extension(F.col("url")).alias("ext"))


@query("zero_pad", "select p_partkey, case when length(p_size::varchar) >= 3 then p_size::varchar else lpad(p_size::varchar, 3, '0') end as three, 'seg-' || case when length(p_partkey::varchar) >= 5 then p_partkey::varchar else lpad(p_partkey::varchar, 5, '0') end || '-' || p_size || '.m4s' as file from part")
def zero_pad(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.zero_pad(n, 3).alias("three"), S.fill_template("seg-$Number%05d$-$Size$.m4s", {"Number": k, "Size": n}).alias("file"))


@query("capitalise", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as title from part")
def capitalise(spark, d):
    return table(spark, d, "part").select("p_partkey", S.capitalise(F.col("p_name")).alias("title"))


@query("math_util", """select p_partkey, floor(log2(p_partkey + 1) + 1e-12)::int as log2, case when p_partkey <= 0 then 1 else 1 << ceil(log2(p_partkey + 1) - 1e-12)::int end::bigint as power, greatest(3, least(40, p_size)) as clipped,
    list_sum(list_transform(range(8), lambda k: ((((p_partkey % 256)::int >> k::int) & 1) << (7 - k::int))))::bigint as mirrored from part""")
def math_util(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", S.log2_floor(k + 1).alias("log2"), S.next_power_of_two(k + 1).alias("power"), S.clip(F.col("p_size"), 3, 40).alias("clipped"), S.bit_reverse8((k % 256).cast("int")).cast("long").alias("mirrored"))


@query("array_ops", f"with {EMB} select vec_id, list_concat(v[6:64], v[1:5]) as turned, [v[3], v[1], v[2]] as picked, list_max(v) as high, list_min(v) as low from e")
def array_ops(spark, d):
    v = F.col("v")
    return blocks(spark, d).select("vec_id", S.rotate(v, 5).alias("turned"), S.permute(v, [2, 0, 1]).alias("picked"), F.array_max(v).alias("high"), F.array_min(v).alias("low"))


def _basis() -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in X.cosine_basis()) + "]"


def _dct(block: str, along_rows: bool) -> str:
    at = lambda i: f"{block}[(i // 8) * 8 + {i + 1}] * t[i % 8 + 1][{i + 1}]" if along_rows else f"{block}[i % 8 + {8 * i + 1}] * t[i // 8 + 1][{i + 1}]"
    return _list("64", "((" + " + ".join(at(i) for i in range(8)) + " + 2048) >> 12)::int")


@query("dct", f"with {EMB}, b as (select {_basis()} as t), r as (select vec_id, t, {_dct('v', True)} as h from e, b) select vec_id, {_dct('h', False)} as out from r")
def dct(spark, d):
    return blocks(spark, d).select("vec_id", X.dct8x8(F.col("v")).alias("out"))


@query("dct_round_trip", f"with {EMB} select vec_id, true as near from e")
def dct_round_trip(spark, d):
    back = blocks(spark, d).select("vec_id", "v", X.dct8x8(F.col("v")).alias("c")).select("vec_id", "v", X.dct8x8(F.col("c"), True).alias("w"))
    return back.select("vec_id", (F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b))) <= 3).alias("near"))


def _sad_at(dy: int, dx: int) -> str:
    cells = [(r, c) for r in range(4) for c in range(4)]
    return " + ".join(f"abs(v[{(r + 2) * 8 + c + 2 + 1}] + {(r * c) % 3} - v[{(r + 2 + dy) * 8 + c + 2 + dx + 1}])" for r, c in cells)


@query("motion_search", f"with {EMB}, s as (select vec_id, list_min([" + ", ".join(f"({_sad_at(dy, dx)})::bigint * 100 + {(dy + 2) * 10 + dx + 2}" for dy in range(-2, 3) for dx in range(-2, 3)) + "]) as m from e) select vec_id, m // 100 as sad, (m % 100 // 10 - 2)::int as dy, (m % 10 - 2)::int as dx from s")
def motion_search(spark, d):
    own = F.transform(X.crop(F.col("v"), 8, 2, 2, 4, 4), lambda x, i: x + (F.shiftright(i, 2) * (i % 4)) % 3)
    return blocks(spark, d).select("vec_id", X.motion_search(own, F.col("v"), 8, 4, 2).alias("m")).select("vec_id", "m.sad", "m.dy", "m.dx")
