"""Sources and sinks: files made here, read by Spark, and back."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chronoreel.sources import boxes, images, manifest, mpeg, simple, sinks

PACKETS = "path string, frame_no long, pts long, timescale int, duration long, key boolean, data binary"


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        (tmp_path / name).write_bytes(content)
        return str(tmp_path / name)

    return write


def test_mux_and_read_back(spark, tmp_path):
    r = random.Random(1)
    rows = [(f"f{k}", i, i * 40, 1000, 40, i % 5 == 0, bytes(r.randrange(256) for _ in range(2 * r.randint(1, 50)))) for k in range(3) for i in range(23)]
    df = spark.createDataFrame(rows, PACKETS)
    by = {(p, i): d for p, i, _, _, _, _, d in rows}
    for kind in ("mp4", "mkv", "ivf", "flv"):
        folder = tmp_path / kind
        sizes = sinks.write_files(sinks.mux(df, kind), str(folder)).collect()
        assert len(sizes) == 3
        files = spark.read.format("binaryFile").load(str(folder)).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
        if kind == "mp4":
            got = boxes.track_packets(boxes.read_tracks(spark, str(folder))).join(files.withColumnRenamed("path", "f"), F.col("path").endswith(F.col("f")))
            got = got.select(F.col("f").alias("path"), "frame_no", "pts", "key", F.expr("substring(content, file_pos + 1, size)").alias("data"))
            assert boxes.movie_duration(boxes.read_tracks(spark, str(folder))).select("duration").distinct().collect()[0][0] == 920
        elif kind == "mkv":
            got = boxes.block_frames(boxes.read_mkv(spark, str(folder)))
        elif kind == "ivf":
            got = simple.read_ivf(spark, str(folder)).withColumn("key", F.lit(None))
        else:
            got = simple.read_flv(spark, str(folder)).withColumn("frame_no", F.expr("row_number() over (partition by path order by position) - 1"))
        got = got.withColumn("path", F.regexp_extract("path", "[^/]+$", 0)).collect()
        assert {(g["path"], g["frame_no"]): bytes(g["data"]) for g in got} == by, kind
        assert all(g["pts"] == g["frame_no"] * 40 for g in got)
        if kind in ("mp4", "mkv"):
            assert all(g["key"] == (g["frame_no"] % 5 == 0) for g in got)


def test_mp4_header_first_and_tree(spark, put):
    data = sinks.mp4_bytes([b"abc", b"de", b"f"], [10, 10, 20], [True, False, True], 600, per_chunk=2, edits=[(30, 5), (10, -1)], header_first=True)
    path = put("a.mp4", data)
    t = boxes.read_tracks(spark, path).first()
    assert [tuple(x) for x in t["stts"]] == [(2, 10), (1, 20)] and t["sync"] == [1, 3] and [tuple(e)[:2] for e in t["edits"]] == [(30, 5), (10, -1)]
    p = boxes.track_packets(boxes.read_tracks(spark, path)).orderBy("frame_no").collect()
    assert [data[x["file_pos"] : x["file_pos"] + x["size"]] for x in p] == [b"abc", b"de", b"f"]
    tree = boxes.read_boxes(spark, path)
    assert [r["tag"] for r in tree.where("depth = 1").orderBy("node").collect()] == ["ftyp", "moov", "mdat"]
    assert tree.where(F.col("tags") == F.array(*map(F.lit, ["moov", "trak", "mdia", "minf", "stbl", "stsz"]))).count() == 1


def test_wav_y4m(spark, put):
    pcm = bytes(range(256)) * 20
    got = simple.read_wav(spark, put("a.wav", sinks.wav_bytes([pcm], 8000))).orderBy("frame_no").collect()
    assert b"".join(bytes(r["data"]) for r in got) == pcm and [r["pts"] for r in got] == [0, 1024, 2048] and got[2]["duration"] == 512
    frames = [bytes([i]) * 24 for i in range(3)]
    got = simple.read_y4m(spark, put("a.y4m", sinks.y4m_bytes(frames, 4, 4, 30000, 1001) + b"FRAME\ncut")).orderBy("frame_no").collect()
    assert [bytes(r["data"]) for r in got] == frames and [r["pts"] for r in got] == [0, 1001, 2002] and got[0]["timescale"] == 30000


def test_flv_resync(spark, put):
    whole = sinks.flv_bytes([("video", 0, b"\x17abc"), ("audio", 20, b"\xaf"), ("video", 1 << 24, b"\x27d")])
    got = simple.read_flv(spark, put("a.flv", whole[:13] + b"junk" + whole[13:])).orderBy("position").collect()
    assert [(r["type"], r["pts"], r["key"], r["codec"]) for r in got] == [("video", 0, True, 7), ("audio", 20, True, 10), ("video", 1 << 24, False, 7)]


def test_mpeg_audio_and_adts(spark, put):
    frame = struct.pack(">I", 0xFFFB9000) + b"\0" * 413  # layer 3, 128 kbit/s, 44.1 kHz
    got = simple.read_mpeg_audio(spark, put("a.mp3", b"junk" + frame + frame)).orderBy("frame_no").collect()
    assert [(r["size"], r["pts"], r["timescale"]) for r in got] == [(417, 0, 44100), (417, 1152, 44100)]
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x5F, 0xFC]) + b"abc"
    got = simple.read_adts(spark, put("a.aac", adts * 2)).orderBy("frame_no").collect()
    assert [(r["size"], r["pts"], r["timescale"]) for r in got] == [(10, 0, 44100), (10, 1024, 44100)]


def ts_packet(pid, payload, start, count):
    stuff = 184 - len(payload)
    field = bytes([stuff - 1]) + (b"\0" + b"\xff" * (stuff - 2) if stuff > 1 else b"") if stuff else b""
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if stuff else 0x10) | count]) + field + payload


def test_transport_stream(spark, put):
    section = lambda table, body: b"\0" + bytes([table, 0xB0, len(body) + 9]) + b"\0\1\xc1\0\0" + body + b"\0\0\0\0"
    pat, pmt = section(0, b"\0\1\xe1\0"), section(2, b"\xe1\1\xf0\0" + b"\x1b\xe1\1\xf0\0" + b"\x0f\xe1\2\xf0\0")
    data = b"v" * 300
    pes = b"\0\0\1\xe0\0\0\x80\xc0\x0a" + mpeg.write_time(8589934590, 3) + mpeg.write_time(900, 1) + data
    ts = ts_packet(0, pat, True, 0) + ts_packet(256, pmt, True, 0) + ts_packet(257, pes[:184], True, 0) + ts_packet(257, pes[184:], False, 1)
    path = put("a.ts", ts)
    assert sorted((r["stream_type"], r["pid"]) for r in mpeg.read_ts_programs(spark, path).collect()) == [(15, 258), (27, 257)]
    got = mpeg.read_ts_pes(spark, path).collect()
    assert [(r["pid"], r["pts"], r["dts"], bytes(r["data"])) for r in got] == [(257, 8589934590, 900, data)]
    assert mpeg.read_ts(spark, path).count() == 4


def test_program_stream_times(spark, put):
    pack = b"\0\0\1\xba" + b"\x44" + b"\0" * 9
    pes = lambda t, n: b"\0\0\1\xe0" + struct.pack(">H", 8 + n) + b"\x80\x80\x05" + mpeg.write_time(t, 2) + b"d" * n
    old = b"\0\0\1\xc0" + struct.pack(">H", 5 + 4) + mpeg.write_time(77, 2) + b"oldf"
    got = mpeg.read_ps(spark, put("a.mpg", pack + pes(10000, 20) + pes(13003, 30) + old)).orderBy("pos").collect()
    assert [(r["stream_id"], r["pts"], r["size"]) for r in got] == [(0xE0, 10000, 20), (0xE0, 13003, 30), (0xC0, 77, 4)]


def test_nal_units(spark, put):
    got = mpeg.read_nal_units(spark, put("a.264", b"\0\0\0\1\x67ab\0\0\1\x68c\0\0\1\x65ddd")).orderBy("idx").collect()
    assert [(r["nal_type"], r["size"]) for r in got] == [(7, 3), (8, 2), (5, 4)]


@pytest.mark.parametrize("lacing, head, sizes", [(1, "00", None), (1, "05bbffff7800" "", None)])
def test_lacing_heads(lacing, head, sizes):
    assert boxes.lace_sizes(bytes.fromhex("02") + bytes([187, 255, 1]) + b"x" * 500, 0, 1)[0] == [187, 256, 57]
    assert boxes.lace_sizes(bytes.fromhex("0741E0605F605FBFBFBF5F9F") + b"x" * 5000, 0, 3)[0][:7] == [480, 576, 672, 672, 672, 672, 576]
    assert boxes.lace_sizes(b"\3" + b"x" * 40, 0, 2) == ([10] * 4, 1)


def test_png_kinds(spark, put):
    rgb = bytes(range(48))
    path = put("a.png", sinks.png_bytes(4, 4, rgb))
    r = images.read_png(spark, path).first()
    assert (r["width"], r["height"], r["channels"], bytes(r["pixels"])) == (4, 4, 3, rgb)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def png(w, h, depth, colour, rows, laced=0, extra=b""):
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    bits = next(images.png_pictures(png(3, 2, 2, 0, b"\0\x1b\0\xe4")))
    assert list(bits[3]) == [0, 85, 170, 255, 170, 85]
    up = next(images.png_pictures(png(2, 3, 8, 0, b"\0\5\6\2\1\1\4\1\1")))
    assert list(up[3]) == [5, 6, 6, 7, 7, 8]
    pal = next(images.png_pictures(png(2, 1, 8, 3, b"\0\1\0", extra=chunk(b"PLTE", b"abcdef") + chunk(b"tRNS", b"\7"))))
    assert pal[2] == 4 and pal[3] == b"def\xffabc\7"
    laced = next(images.png_pictures(png(2, 2, 8, 0, b"\0\1" + b"\0\2" + b"\0\3\4", 1)))
    assert list(laced[3]) == [1, 2, 3, 4]


def test_sequences_headers_and_junk(spark, tmp_path, put):
    for n in (1, 2, 3, 5):
        put(f"img{n:03d}.png", bytes([n]))
    got = simple.read_image_sequence(spark, str(tmp_path / "img*.png")).orderBy("frame_no").collect()
    assert [bytes(r["data"])[0] for r in got] == [1, 2, 3]
    dpx = bytearray(2048)
    dpx[:4] = b"SDPX"
    dpx[136:155] = b"2017:09:05:14:14:59"
    dpx[772:780] = struct.pack(">II", 2048, 1556)
    dpx[1920:1924] = bytes.fromhex("01000405")
    r = simple.read_dpx(spark, put("a.dpx", bytes(dpx))).first()
    assert (r["width"], r["height"], r["file_date"], r["timecode"]) == (2048, 1556, "2017:09:05:14:14:59", "01:00:04:05")
    avi = b"RIFF" + struct.pack("<I", 28) + b"AVI LIST" + struct.pack("<I", 12) + b"movi00dc" + struct.pack("<I", 0) + b"    "
    assert [(r["depth"], r["id"]) for r in simple.read_riff(spark, put("a.avi", avi)).orderBy("offset").collect()][:3] == [(0, "RIFF:AVI "), (1, "LIST:movi"), (2, "00dc")]
    junk = put("junk", b"\xff" * 500)
    for read in (simple.read_wav, simple.read_y4m, simple.read_ivf, simple.read_flv, simple.read_adts, images.read_png, boxes.read_tracks, mpeg.read_ts):
        assert read(spark, junk).count() == 0


def test_manifest(spark, put):
    mpd = b"""<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT10S"><Period><AdaptationSet mimeType="video/mp4">
    <SegmentTemplate timescale="1000" duration="4000" startNumber="3" media="$RepresentationID$/s$Number%04d$.m4s"/><Representation id="v1" bandwidth="9"/></AdaptationSet>
    <AdaptationSet><Representation id="a1" mimeType="audio/mp4"><SegmentTemplate timescale="10" media="a$Time$$$"><SegmentTimeline><S t="5" d="20" r="1"/><S d="7"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet></Period></MPD>"""
    got = [tuple(r)[3:] for r in manifest.read_mpd(spark, put("a.mpd", mpd)).orderBy("adaptation", "number").collect()]
    assert got[:3] == [("v1", "video/mp4", 9, 1000, 3 + i, 4000 * i, (4000, 4000, 2000)[i], f"v1/s000{3 + i}.m4s") for i in range(3)]
    assert [(g[5], g[6], g[7]) for g in got[3:]] == [(5, 20, "a5$"), (25, 20, "a25$"), (45, 7, "a45$")]
    assert manifest.read_mpd(spark, put("b.mpd", b"<x")).count() == 0
