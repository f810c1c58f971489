"""Golden values of the media model, and edge cases of operators."""

import pytest
from pyspark.sql import functions as F

from chronoreel.functions import binary as B
from chronoreel.functions import probe
from chronoreel.functions import rational as R
from chronoreel.functions import timecode as T
from chronoreel.operators import edits as E
from chronoreel.operators import packets as P
from chronoreel.operators import repair as X
from chronoreel.operators import runs
from chronoreel.operators import streams
from chronoreel.operators.intervals import interval_join
from chronoreel.streaming import packets as stream

EDIT = "track_id long, ord int, duration long, media_time long"


def edit_list(spark, pairs):
    return spark.createDataFrame([(1, i, d, m) for i, (d, m) in enumerate(pairs)], EDIT)


@pytest.mark.parametrize(
    "lower, higher, out",
    [
        ([(3000, 4000), (4000, 14000), (4000, 24000)], [(3000, 2000), (3000, 6000)], [(1000, 6000), (2000, 14000), (1000, 17000), (2000, 24000)]),
        ([(3000, 4000), (4000, 24000), (4000, 14000)], [(3000, 2000), (3000, 6000)], [(1000, 6000), (2000, 24000), (1000, 27000), (2000, 14000)]),
        ([(3000, 4000), (4000, 24000), (4000, 14000)], [(3000, 6000), (3000, 2000)], [(1000, 27000), (2000, 14000), (1000, 6000), (2000, 24000)]),
        ([(9000, 0), (10000, 9000)], [(8000, 1000), (9000, 10000)], [(8000, 1000), (9000, 10000)]),
        ([], [(5, 0)], []),
    ],
)
def test_edits_on_edits(spark, lower, higher, out):
    got = E.edits_on_edits(edit_list(spark, lower), edit_list(spark, higher)).orderBy("ord").collect()
    # edits that meet at their ends in media time may come as two; joined, they must give the expected list
    joined = []
    for r in got:
        if joined and joined[-1][1] + joined[-1][0] == r["media_time"]:
            joined[-1] = (joined[-1][0] + r["duration"], joined[-1][1])
        else:
            joined.append((r["duration"], r["media_time"]))
    assert joined == out


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_variable_length_integers(spark):
    n = [F.lit(x).cast("long") for x in (1, 128, 16384)]
    assert list(one(spark, *(B.ebml(x).alias(f"c{i}") for i, x in enumerate(n)))) == ["81", "4080", "204000"]
    assert list(one(spark, B.from_ebml(F.lit("4241")).alias("a"), B.from_ebml(F.lit("A1")).alias("b"))) == [577, 33]


def test_rationals(spark):
    texts = ["42:43", "42/43", "42", "42.43", "42/a"]
    got = one(spark, *(R.parse(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)))
    assert [tuple(x) if x else None for x in got] == [(42, 43), (42, 43), (42, 1), None, None]


def test_dates_and_timecodes(spark):
    got = one(spark, T.parse_dpx_date(F.lit("2017:09:05:14:14:59")).alias("a"), T.parse_dpx_date(F.lit("2017:09:05:14:14:59:-08")).alias("b"), T.parse_dpx_date(F.lit("2017:09:05:14:14:59:-0800")).alias("c"), T.parse_dpx_date(F.lit("")).alias("d"))
    assert got["a"] == 1504620899 and got["b"] == got["c"] == got["a"] + 8 * 3600 and got["d"] is None
    got = one(spark, T.format_timecode(F.lit(17982), 30, True).alias("a"), T.format_timecode(F.lit(1800), 30, True).alias("b"), T.format_timecode(F.lit(1), 30, True).alias("c"), T.parse_timecode(F.lit("00:00:00:31"), 30).alias("d"))
    assert list(got) == ["00:10:00;00", "00:01:00;02", "00:00:00;01", None]


def test_md5_slice(spark):
    assert one(spark, F.md5(F.substring(F.unhex(F.lit("0001020304")), 2, 3)).alias("m"))["m"] == "5289df737df57326fcdd22597afb1fac"


def test_cut_is_a_partition(spark):
    e = edit_list(spark, [(1000, 0), (500, -1), (2000, 700)])
    inner, outer = E.cut_inner(e, F.lit(800), F.lit(1600)), E.cut_outer(e, F.lit(800), F.lit(1600))
    assert inner.agg(F.sum("duration")).first()[0] == 800
    assert inner.agg(F.sum("duration")).first()[0] + outer.agg(F.sum("duration")).first()[0] == 3500


def test_interval_join_once_per_pair(spark):
    a = spark.createDataFrame([(1, 0, 50), (1, 10, 11), (1, 5, 5), (2, 0, 9)], "k long, a_start long, a_end long")
    b = spark.createDataFrame([(1, 7, 40), (1, 50, 60), (3, 0, 9)], "k long, b_start long, b_end long")
    assert sorted((r["a_start"], r["b_start"]) for r in interval_join(a, b, "k", 4).collect()) == [(0, 7), (10, 7)]
    assert interval_join(a, b, "k", 4, "anti").count() == 2


def test_gop_pts_extrapolation(spark):
    rows = [(1, 0, i, p) for i, p in enumerate([None, None, 3000, 4000, None, 6000])]
    got = X.gop_pts(spark.createDataFrame(rows, "track_id long, gop long, temporal_ref long, pts long")).orderBy("temporal_ref").collect()
    assert [r["pts"] for r in got] == [1000, 2000, 3000, 4000, 5000, 6000]


def test_single_packet_durations(spark):
    p = spark.createDataFrame([(1, 0, 10)], "track_id long, frame_no long, pts long")
    assert P.durations(p).first()["duration"] == 3003
    assert P.durations_last_one(p).first()["duration"] == 1


def test_rle_round_trip(spark):
    rows = [(1, i, v) for i, v in enumerate([None, None, "a", "a", "b", None])]
    df = spark.createDataFrame(rows, "t long, n long, v string")
    r = runs.rle_encode(df, ["t"], ["n"], "v").orderBy("run").collect()
    assert [(x["value"], x["count"]) for x in r] == [(None, 2), ("a", 2), ("b", 1), (None, 1)]
    assert runs.rle_expand(runs.rle_encode(df, ["t"], ["n"], "v")).count() == 6


def test_probe_transport_stream(spark):
    ts = bytearray(188 * 4)
    ts[::188] = b"\x47" * 4
    df = spark.createDataFrame([(bytes(ts),), (b"none of it",), (None,)], "data binary")
    assert [r[0] for r in df.select(probe.detect(F.col("data"))).collect()] == ["mpegts", None, None]


def test_fragments(spark):
    rows = [(1, 0, False, False, "x"), (1, 1, True, False, "a"), (1, 2, False, False, "b"), (1, 3, False, True, "c"), (1, 4, False, True, "y"), (1, 5, True, False, "d"), (1, 7, False, True, "e"), (1, 8, True, True, "f"), (1, 9, True, False, "g")]
    df = spark.createDataFrame(rows, "track_id long, seq long, start boolean, end boolean, data string")
    assert [r["data"] for r in streams.join_fragments(df).orderBy("unit").collect()] == ["abc", "f"]


def test_packed_pictures_and_disc_pcm():
    import numpy as np

    from chronoreel.functions import codecs

    r = np.random.default_rng(1)
    y, u, v = r.integers(0, 1024, (4, 50)), r.integers(0, 1024, (4, 25)), r.integers(0, 1024, (4, 25))
    for got, want in zip(codecs.v210_to_planes(codecs.planes_to_v210(y, u, v), 50, 4), (y, u, v), strict=True):
        assert (got == want).all()
    head = bytes([0xA0, 1, 0, 0, 0, 0x01, 0])
    assert codecs.disc_pcm(head + b"\x00\x01\xff\xff") == (48000, 2, 16, [1, -1])
    assert codecs.disc_pcm(bytes([0xA0, 1, 0, 0, 0, 0x80, 0]) + b"\x00\x01\xff\xff\x07\xfe")[3] == [0x107, -2]


def test_reference_window_holds_every_picture(spark):
    decoded = [1, 0, 3, 2] + list(range(4, 60))  # two swapped pairs, then in order; picture 50 is a key picture
    rows = [(t, n, poc, poc == 50) for t in (1, 2) for n, poc in enumerate(decoded)]
    got = streams.reference_window(spark.createDataFrame(rows, "track_id long, decode_no long, poc long, key boolean"), 4).collect()
    want = set()
    for t in (1, 2):
        held = []
        for poc in decoded:
            held = [] if poc == 50 else held[-4:]
            past, future = sorted((r for r in held if r < poc), reverse=True), sorted(r for r in held if r > poc)
            l0, l1 = past + future, future + past
            if l0 == l1 and len(l1) > 1:
                l1[:2] = l1[1::-1]
            want |= {(t, poc, r, l0.index(r), l1.index(r)) for r in held}
            held.append(poc)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(r["poc"] for r in got) == 59


def test_byte_counts_sees_every_byte(spark):
    texts = ["Aa\n\tÉ~\x00\x7f", "", None, "日本 🎬\r\n" * 50, "".join(map(chr, range(256)))]
    got = runs.byte_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    data = b"".join((t or "").encode() for t in texts)
    assert {r["value"]: r["count"] for r in got} == {v: data.count(v) for v in set(data)} and len(got) == len(set(data))
    assert sum(r["count"] for r in got) == len(data)


def test_stream_reorder_flushes_every_track(spark, tmp_path):
    swapped = [(1, i ^ 1) for i in range(20)] + [(2, i) for i in (102, 100, 101)] + [(3, 200 + i) for i in range(8)] + [(None, 300)]
    later = [(1, 20 + i) for i in range(3)] + [(4, 400)]
    for name, rows in (("events.parquet", swapped), ("events.parquet2", later)):
        spark.createDataFrame(rows, "user_id long, event_id long").coalesce(1).write.parquet(str(tmp_path / name))
    got = stream.reorder_all(stream.read_events(spark, str(tmp_path))).collect()
    tracks = {}
    for track, event in swapped + later:
        tracks.setdefault(track, []).append(event)
    want = [(track, event, n) for track, events in tracks.items() for n, event in enumerate(sorted(events))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_whole_table_forms_reach_every_track(spark, tmp_path):
    from chronoreel.plans import QUERIES

    events = [(n, u, "purchase" if u % 2 and not i else "view", 1.0, i) for n, (u, i) in enumerate((u, i) for u in range(0, 600, 2) for i in range(3))]
    events += [(9000 + i, 7, "purchase" if i == 1 else "view", 1.0, i) for i in range(3)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, i int")
    rows.selectExpr("event_id", "user_id", "event_type", "value", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, i) as ts").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(602).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    sought = QUERIES["seek_pts"](spark, str(tmp_path)).groupBy("track_id").count().collect()
    assert {r["track_id"]: r["count"] for r in sought} == dict.fromkeys([*range(0, 600, 2), 7], 2)
    flags = {(r["track_id"], r["frame_no"]): r["key"] for r in QUERIES["sync_flags"](spark, str(tmp_path)).collect()}
    assert len(flags) == 903 and {k for k, v in flags.items() if not v} == {(7, 0), (7, 2)}
    spark.createDataFrame([(1, t) for t in (0, 1, 2, 5, 6)] + [(2, t) for t in range(9)], "conv_id long, turn int").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [tuple(r) for r in QUERIES["timecode_breaks"](spark, str(tmp_path)).collect()] == [(1, 5, 2)]


def test_cutting_to_gaps(spark):
    """Fixed values that must come out: sizes left, and the edits that play them."""
    from chronoreel.operators import movies

    sizes = [*range(42, 74), *range(142, 174)]
    samples = spark.createDataFrame([(1, i, i * 1024, 1024) for i in range(64)] + [(2, 0, 0, 10)], "track_id long, sample long, start long, duration long")
    gaps = spark.createDataFrame([(1, 14400, 28799), (1, 43200, 57599)], "track_id long, gap_start long, gap_end long")
    kept, edits = movies.cut_to_gaps(samples, gaps)
    assert [sizes[r["sample"]] for r in kept.where("track_id = 1").orderBy("sample").collect()] == [*range(42, 57), *range(70, 74), *range(142, 153), *range(166, 174)]
    assert [(r["media_time"], r["duration"]) for r in edits.where("track_id = 1").orderBy("ord").collect()] == [(0, 14400), (15488, 14400), (30976, 7936)]
    assert [(r["media_time"], r["duration"]) for r in edits.where("track_id = 2").collect()] == [(0, 10)]
    assert kept.limit(0).count() == 0 and movies.cut_to_gaps(samples.limit(0), gaps.limit(0))[1].count() == 0


def test_group_times_from_two_known_ones(spark):
    from chronoreel.operators import repair

    def fixed(pts):
        rows = [(1, 0, t, p) for t, p in enumerate(pts)]
        return [r["pts"] for r in repair.gop_pts(spark.createDataFrame(rows, "track_id long, gop long, temporal_ref long, pts long")).orderBy("temporal_ref").collect()]

    assert fixed([0, None, 20, None]) == [0, 10, 20, 30]
    assert fixed([None, None, 20, 30]) == [0, 10, 20, 30]
    assert fixed([None, 10, None]) == [None, 10, None] and fixed([None]) == [None]
    assert repair.gop_pts(spark.createDataFrame([], "track_id long, gop long, temporal_ref long, pts long")).count() == 0


def test_drift_by_hand(spark):
    from chronoreel.operators import repair

    rows = [(1, i, m, 0) for i, m in enumerate(["AUDIO", "VIDEO", "AUDIO", "VIDEO", "AUDIO", "AUDIO"])] + [(2, 0, "VIDEO", 0)]
    got = {(r["track_id"], r["frame_no"]): r["fixed_pts"] for r in repair.drift(spark.createDataFrame(rows, "track_id long, frame_no long, media string, pts long")).collect()}
    a = 1024 / 48000
    first = a * 3 / 2 + a * a  # three audio packets to two video ones, and the clocks differ by one packet
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): int(a * 1000 + 0.5), (1, 3): int(first * 1000 + 0.5), (1, 4): int(2 * a * 1000 + 0.5), (1, 5): int(3 * a * 1000 + 0.5), (2, 0): 0}


def test_timecode_gaps_by_rule(spark):
    from chronoreel.operators import repair

    def gaps(codes, drop=False):
        rows = [(1, i, *(c or (None,) * 4), drop) for i, c in enumerate(codes)]
        df = spark.createDataFrame(rows, "part int, n int, hour int, minute int, second int, frame int, drop boolean")
        return [r["gap"] for r in repair.timecode_gaps(df, "part", "n").orderBy("n").collect()]

    assert gaps([(0, 0, 0, 23), (0, 0, 0, 24), (0, 0, 1, 0), (0, 0, 1, 1), (0, 0, 1, 3)]) == [True, False, False, False, True]
    assert gaps([(0, 0, 59, 29), (0, 1, 0, 2)], True) == [True, False] and gaps([(0, 9, 59, 29), (0, 10, 0, 0)], True) == [True, False]
    assert gaps([(0, 0, 59, 29), (0, 1, 0, 0)], True) == [True, True] and gaps([(0, 0, 0, 1), None, (0, 0, 0, 3)]) == [True, True, True] and gaps([(0, 0, 0, 1), (0, 0, 2, 0)]) == [True, True]


def test_anti_joins_see_nulls(spark):
    from chronoreel.operators.intervals import interval_join

    left = spark.createDataFrame([(1, 0, 10, None), (1, 0, 10, None), (1, 50, 60, "x"), (2, 0, 10, None)], "k int, a_start long, a_end long, note string")
    right = spark.createDataFrame([(1, 5, 7), (1, 8, 30)], "k int, b_start long, b_end long")
    assert interval_join(left, right, "k", 4, "semi").count() == 2
    assert sorted(r["a_start"] for r in interval_join(left, right, "k", 4, "anti").collect()) == [0, 50]
