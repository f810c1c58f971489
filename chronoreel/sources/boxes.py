"""MP4/MOV box trees and sample tables, and Matroska element trees and blocks.

An MP4 file gives one row a track with its tables as run arrays; packets come from those rows by run expansion, prefix sums and as-of
look-ups in Spark, so the samples of a long track are not built in one Python loop.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import runs as R
from .base import scan

BOX = "node int, parent int, depth int, tags array<string>, tag string, offset long, size long, payload binary"
#: Boxes that hold boxes, and the bytes of their own before those.
CONTAINERS = {"moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "edts": 0, "dinf": 0, "udta": 0, "moof": 0, "traf": 0, "mvex": 0, "meta": 4, "dref": 8, "stsd": 8}
TRACK = (
    "track_no int, track_id long, media string, codec string, timescale int, movie_timescale int, duration long, stts array<struct<count:int,duration:long>>, ctts array<struct<count:int,offset:long>>, "
    "stsc array<struct<first_chunk:long,samples:long,entry:int>>, sizes array<long>, chunks array<long>, sync array<long>, edits array<struct<duration:long,media_time:long,rate:double>>"
)
ELEMENT = "node int, parent int, depth int, id string, name string, offset long, size long, value binary"
BLOCK = "track int, cluster_time long, time int, key boolean, lacing int, frame int, pts long, size long, data binary"


def walk_boxes(data: bytes) -> Iterator[tuple]:
    """(node, parent, depth, path, tag, offset, size, payload of a leaf)."""
    stack, node = [(0, len(data), -1, ())], 0
    while stack:
        at, end, parent, path = stack.pop()
        if at + 8 > end:
            continue
        size, tag = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8].decode("latin-1")
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head:
            continue
        stop = min(end, at + size)
        stack.append((at + size, end, parent, path))
        inner = (*path, tag)
        leaf = tag not in CONTAINERS
        yield node, parent, len(inner), list(inner), tag, at, size, data[at + head : stop] if leaf else None
        if not leaf:
            stack.append((at + head + CONTAINERS[tag], stop, node, inner))
        node += 1


def _bodies(data: bytes, start: int, end: int) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    at = start
    while at + 8 <= end:
        size, head = struct.unpack_from(">I", data, at)[0], 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            break
        tag = data[at + 4 : at + 8].decode("latin-1")
        out.setdefault(tag, []).append((at + head, min(end, at + size)))
        at += size
    return out


def _rows(data: bytes, span: tuple[int, int] | None, fmt: str, skip: int = 4) -> list[tuple]:
    if not span:
        return []
    n, width = struct.unpack_from(">I", data, span[0] + skip)[0], struct.calcsize(fmt)
    n = min(n, (span[1] - span[0] - skip - 4) // width)
    return [struct.unpack_from(fmt, data, span[0] + skip + 4 + i * width) for i in range(n)]


def mp4_tracks(data: bytes) -> Iterator[tuple]:
    top = _bodies(data, 0, len(data))
    for moov in top.get("moov", [])[-1:]:
        m = _bodies(data, *moov)
        wide = data[m["mvhd"][0][0]] == 1
        movie_scale = struct.unpack_from(">I", data, m["mvhd"][0][0] + (20 if wide else 12))[0]
        for no, trak in enumerate(m.get("trak", [])):
            t = _bodies(data, *trak)
            mdia = _bodies(data, *t["mdia"][0])
            stbl = _bodies(data, *_bodies(data, *mdia["minf"][0])["stbl"][0])
            one = lambda tag: stbl.get(tag, [None])[0]  # noqa: B023, E731
            tk, md = t["tkhd"][0][0], mdia["mdhd"][0][0]
            track_id = struct.unpack_from(">I", data, tk + (20 if data[tk] == 1 else 12))[0]
            scale, duration = struct.unpack_from(">IQ", data, md + 20) if data[md] == 1 else struct.unpack_from(">II", data, md + 12)
            kind = data[mdia["hdlr"][0][0] + 8 : mdia["hdlr"][0][0] + 12].decode("latin-1")
            codec = data[one("stsd")[0] + 12 : one("stsd")[0] + 16].decode("latin-1") if one("stsd") else None
            z = one("stsz")
            fixed, n = struct.unpack_from(">II", data, z[0] + 4) if z else (0, 0)
            sizes = [fixed] * n if fixed else [r[0] for r in _rows(data, z, ">I", 8)]
            offsets = [r[0] for r in (_rows(data, one("stco"), ">I") or _rows(data, one("co64"), ">Q"))]
            elst = _bodies(data, *t["edts"][0]).get("elst", [None])[0] if "edts" in t else None
            edits = _rows(data, elst, ">qqi" if elst and data[elst[0]] == 1 else ">iii")
            yield (
                no, track_id, {"vide": "VIDEO", "soun": "AUDIO"}.get(kind, kind), codec, scale, movie_scale, duration, _rows(data, one("stts"), ">II"), _rows(data, one("ctts"), ">Ii"), _rows(data, one("stsc"), ">III"),
                sizes, offsets, [r[0] for r in _rows(data, one("stss"), ">I")] if one("stss") else None, [(d, m_, r / 65536) for d, m_, r in edits],
            )


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, walk_boxes, BOX)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, mp4_tracks, TRACK)


def track_packets(tracks: DataFrame) -> DataFrame:
    """Track rows to packets: file, track_id, frame_no, media_pts, pts, duration, size, file_pos, key. Bytes stay where they are."""
    key = F.concat_ws("#", "path", "track_no")
    t = tracks.withColumn("track_id", key).select("track_id", "path", "media", "codec", "timescale", "stts", "ctts", "stsc", "sizes", "chunks", "sync")
    runs = t.select("track_id", F.posexplode("stts").alias("run", "s")).select("track_id", "run", "s.count", "s.duration")
    times = R.sample_times(runs)
    shifts = t.where(F.size("ctts") > 0).select("track_id", F.posexplode("ctts").alias("run", "s")).select("track_id", "run", F.col("s.count").alias("count"), F.col("s.offset").alias("duration"))
    shifts = R.sample_times(shifts).select("track_id", "sample_no", F.col("duration").alias("shift"))
    sizes = t.select("track_id", F.posexplode("sizes").alias("sample_no", "size")).withColumn("sample_no", F.col("sample_no").cast("long"))
    chunks = t.select("track_id", F.posexplode("chunks").alias("c", "chunk_pos")).select("track_id", (F.col("c") + 1).cast("long").alias("chunk"), "chunk_pos")
    layout = t.select("track_id", F.explode("stsc").alias("s")).select("track_id", "s.first_chunk", "s.samples")
    placed = R.chunk_runs(chunks.select("track_id", "chunk"), layout).join(chunks, ["track_id", "chunk"])
    placed = placed.withColumn("first", R.exclusive_sum(F.col("samples"), ["track_id"], ["chunk"])).where("samples > 0")
    members = placed.select("track_id", "chunk", "chunk_pos", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("samples") - 1)).alias("sample_no"))
    members = R.sample_offsets(members.join(sizes, ["track_id", "sample_no"]), ["track_id", "chunk"], ["sample_no"])
    out = members.join(times, ["track_id", "sample_no"]).join(shifts, ["track_id", "sample_no"], "left")
    sync = t.where("sync is not null").select("track_id", F.explode_outer("sync").alias("sample_no_1"))
    out = R.sync_flags(out, sync).join(t.select("track_id", "path", "media", "codec", "timescale"), "track_id")
    return out.select(
        "track_id", "path", "media", "codec", F.col("sample_no").alias("frame_no"), F.col("pts").alias("media_pts"), (F.col("pts") + F.coalesce("shift", F.lit(0))).alias("pts"), "timescale", "duration", "size",
        (F.col("chunk_pos") + F.col("offset")).alias("file_pos"), "key",
    )


def movie_duration(tracks: DataFrame) -> DataFrame:
    """Per file the longest track in movie ticks."""
    return tracks.groupBy("path").agg(F.max(F.expr("duration * movie_timescale div timescale")).alias("duration"))


#: Fixed ids and names of the Matroska elements that are entered or used.
MASTERS = {0x18538067: "Segment", 0x1F43B675: "Cluster", 0x1654AE6B: "Tracks", 0xAE: "TrackEntry", 0x1549A966: "Info", 0xA0: "BlockGroup", 0x1C53BB6B: "Cues", 0xBB: "CuePoint", 0x1A45DFA3: "EBML", 0xE0: "Video", 0xE1: "Audio"}
LEAVES = {0xE7: "Timecode", 0xA3: "SimpleBlock", 0xA1: "Block", 0x2AD7B1: "TimecodeScale", 0x4489: "Duration", 0xD7: "TrackNumber", 0x83: "TrackType", 0x86: "CodecID", 0xFB: "ReferenceBlock", 0x9B: "BlockDuration", 0xB0: "PixelWidth", 0xBA: "PixelHeight"}


def ebml_number(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """Value and length of a variable-length number; length 0 where there is none."""
    if at >= len(data) or not data[at]:
        return 0, 0
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        return 0, 0
    v = int.from_bytes(data[at : at + n], "big")
    return (v if keep_mark else v & (1 << 7 * n) - 1), n


def ebml_signed(data: bytes, at: int) -> tuple[int, int]:
    v, n = ebml_number(data, at)
    return v - ((1 << 7 * n - 1) - 1), n


def walk_elements(data: bytes) -> Iterator[tuple]:
    stack, node = [(0, len(data), -1, 0)], 0
    while stack:
        at, end, parent, depth = stack.pop()
        eid, a = ebml_number(data, at, True)
        size, b = ebml_number(data, at + a)
        if at >= end or not a or not b:
            continue
        body = at + a + b
        stop = end if size == (1 << 7 * b) - 1 else min(end, body + size)
        stack.append((stop, end, parent, depth))
        master = eid in MASTERS
        name = MASTERS.get(eid) or LEAVES.get(eid)
        yield node, parent, depth, f"{eid:X}", name, at, stop - body, None if master else data[body:stop]
        if master:
            stack.append((body, stop, node, depth + 1))
        node += 1


def lace_sizes(block: bytes, at: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block from its lace head on, and where the frames begin."""
    if not lacing:
        return [len(block) - at], at
    n = block[at] + 1
    at += 1
    if lacing == 2:
        return [(len(block) - at) // n] * n, at
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while block[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + block[at])
            at += 1
    else:
        size, k = ebml_number(block, at)
        at += k
        sizes.append(size)
        for _ in range(n - 2):
            diff, k = ebml_signed(block, at)
            at += k
            sizes.append(sizes[-1] + diff)
        del sizes[n - 1 :]
    return [*sizes, len(block) - at - sum(sizes)], at


def mkv_blocks(data: bytes) -> Iterator[tuple]:
    """Frames of all blocks; a frame's time is its cluster's plus its block's."""
    cluster_time, groups = 0, {}
    for node, parent, _, _, name, _, _, value in walk_elements(data):
        if name == "Timecode":
            cluster_time = int.from_bytes(value, "big")
        elif name == "ReferenceBlock":
            groups[parent] = False
        elif name in ("SimpleBlock", "Block") and value:
            track, k = ebml_number(value, 0)
            time, flags = struct.unpack_from(">hB", value, k)
            sizes, at = lace_sizes(value, k + 3, flags >> 1 & 3)
            key = bool(flags & 0x80) if name == "SimpleBlock" else groups.get(parent, True)
            for i, size in enumerate(sizes):
                yield track, cluster_time, time, key, flags >> 1 & 3, i, cluster_time + time, size, value[at : at + size]
                at += size


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, walk_elements, ELEMENT)


def read_mkv(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, mkv_blocks, BLOCK)


def block_frames(blocks: DataFrame) -> DataFrame:
    """Matroska frames numbered per file and track, with durations to the next (1 for the last)."""
    w = Window.partitionBy("path", "track").orderBy("pts", "frame")
    return blocks.withColumns({"frame_no": (F.row_number().over(w) - 1).cast("long"), "duration": F.coalesce(F.lead("pts").over(w) - F.col("pts"), F.lit(1))})
