"""Flat containers: WAV, Y4M, IVF, FLV, MPEG audio, ADTS, DPX headers, AVI chunks, numbered images."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import scan

PACKET = "frame_no long, pts long, timescale int, duration long, key boolean, size long, data binary"
FLV_TAG = "position long, type string, pts long, key boolean, codec int, frame_type int, size long, data binary"
CHUNK = "depth int, parent string, id string, offset long, size long"


def wav_packets(data: bytes, frames: int = 1024) -> Iterator[tuple]:
    """Packets of frames PCM frames; pts counts frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return
    at, rate, width = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt " and body + 16 <= len(data):
            rate, width = struct.unpack_from("<I", data, body + 4)[0], struct.unpack_from("<H", data, body + 12)[0]
        elif name == b"data" and width:
            end = min(len(data), body + size)
            for no, p in enumerate(range(body, end, frames * width)):
                block = data[p : min(end, p + frames * width)]
                n = len(block) // width
                if n:
                    yield no, no * frames, rate, n, True, n * width, block[: n * width]
            return
        at = body + size + (size & 1)


def y4m_packets(data: bytes) -> Iterator[tuple]:
    """Frames of 4:2:0 video; duration one frame at the header's rate."""
    end = data.find(b"\n")
    if not data.startswith(b"YUV4MPEG2") or end < 0:
        return
    head = {t[:1]: t[1:] for t in data[:end].decode("ascii", "replace").split(" ")[1:] if t}
    if not head.get("C", "420").startswith("420"):
        return
    w, h = int(head.get("W", 0)), int(head.get("H", 0))
    num, den = (int(x) for x in head.get("F", "25:1").split(":"))
    size, at, no = w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2), end + 1, 0
    while size and data[at : at + 5] == b"FRAME":
        at = data.find(b"\n", at) + 1
        if not at or at + size > len(data):
            return
        yield no, no * den, num, den, True, size, data[at : at + size]
        at += size
        no += 1


def ivf_packets(data: bytes) -> Iterator[tuple]:
    if data[:4] != b"DKIF" or len(data) < 32:
        return
    at, (num, den), no = struct.unpack_from("<H", data, 6)[0], struct.unpack_from("<II", data, 16), 0
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<IQ", data, at)
        if at + 12 + size > len(data):
            return
        frame = data[at + 12 : at + 12 + size]
        yield no, pts * den, num, den, not (frame[:1] and frame[0] & 1), size, frame
        at += 12 + size
        no += 1


def flv_tags(data: bytes) -> Iterator[tuple]:
    """Tags in order; after damage the next place where a tag's length is confirmed by the one stored behind it."""
    if data[:3] != b"FLV" or len(data) < 9:
        return
    at = struct.unpack_from(">I", data, 5)[0] + 4
    kinds = {8: "audio", 9: "video", 18: "script"}

    def sound(p: int) -> bool:
        size = int.from_bytes(data[p + 1 : p + 4], "big")
        return data[p] in kinds and p + 15 + size <= len(data) and struct.unpack_from(">I", data, p + 11 + size)[0] == size + 11

    while at + 15 <= len(data):
        if not sound(at):
            at += 1
            continue
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        pts = int.from_bytes(data[at + 4 : at + 7], "big") | data[at + 7] << 24
        body, kind = data[at + 11 : at + 11 + size], kinds[data[at]]
        first = body[0] if body else 0
        codec, frame_type = (first & 15, first >> 4) if kind == "video" else (first >> 4, 0)
        yield at, kind, pts, kind == "audio" or kind == "video" and frame_type == 1, codec, frame_type, size, body
        at += 15 + size


#: Fixed tables of MPEG audio: kbit/s by layer and index (version 1; then versions 2 and 2.5), sample rates of version 1.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def mpeg_audio_packets(data: bytes) -> Iterator[tuple]:
    """Frames of layer 1 to 3, junk between them skipped; samples per frame by layer and version."""
    at = no = pts = 0
    while at + 4 <= len(data):
        h = int.from_bytes(data[at : at + 4], "big")
        version, layer, kbit, rate = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
        if h >> 21 != 0x7FF or version == 1 or layer == 4 or kbit in (0, 15) or rate == 3:
            at += 1
            continue
        old = 1 if version == 3 else 2
        hz = RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
        samples = 384 if layer == 1 else 1152 if layer == 2 or old == 1 else 576
        bits, pad = KBITS[old, layer][kbit] * 1000, h >> 9 & 1
        size = (12 * bits // hz + pad) * 4 if layer == 1 else samples // 8 * bits // hz + pad
        if at + size > len(data):
            return
        yield no, pts, hz, samples, True, size, data[at : at + size]
        at, no, pts = at + size, no + 1, pts + samples


def adts_packets(data: bytes) -> Iterator[tuple]:
    at = no = 0
    while at + 7 <= len(data):
        b = data[at : at + 7]
        size, rate = (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5, b[2] >> 2 & 15
        if b[0] != 0xFF or b[1] & 0xF6 != 0xF0 or size < 7 or rate >= len(ADTS_RATES):
            at += 1
            continue
        if at + size > len(data):
            return
        yield no, no * 1024, ADTS_RATES[rate], 1024, True, size, data[at : at + size]
        at, no = at + size, no + 1


def riff_chunks(data: bytes) -> Iterator[tuple]:
    """Chunks of a RIFF tree, lists entered."""
    stack = [(0, len(data), 0, "")]
    while stack:
        at, end, depth, parent = stack.pop()
        if at + 8 > end:
            continue
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack_from("<I", data, at + 4)[0]
        stop = min(end, at + 8 + size)
        stack.append((stop + (size & 1), end, depth, parent))
        if name in ("RIFF", "LIST"):
            kind = data[at + 8 : at + 12].decode("latin-1")
            yield depth, parent, f"{name}:{kind}", at, size
            stack.append((at + 12, stop, depth + 1, kind))
        else:
            yield depth, parent, name, at, size


def dpx_header(data: bytes) -> Iterator[tuple]:
    """(width, height, file_date, frame_rate, timecode) of a DPX file in either byte order."""
    order = {b"SDPX": ">", b"XPDS": "<"}.get(data[:4])
    if not order or len(data) < 2048:
        return
    text = lambda a, n: data[a : a + n].split(b"\0")[0].decode("ascii", "replace")
    w, h = struct.unpack_from(order + "II", data, 772)
    tc = struct.unpack_from(order + "I", data, 1920)[0]
    rate = struct.unpack_from(order + "f", data, 1940)[0]
    yield w, h, text(136, 24), float(rate), ":".join(f"{tc >> s & 255:02x}" for s in (24, 16, 8, 0))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, wav_packets, PACKET)


def read_y4m(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, y4m_packets, PACKET)


def read_ivf(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, ivf_packets, PACKET)


def read_flv(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, flv_tags, FLV_TAG)


def read_mpeg_audio(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, mpeg_audio_packets, PACKET)


def read_adts(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, adts_packets, PACKET)


def read_riff(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, riff_chunks, CHUNK)


def read_dpx(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, dpx_header, "width int, height int, file_date string, frame_rate double, timecode string")


def read_image_sequence(spark: SparkSession, glob: str, fps: int = 25) -> DataFrame:
    """Numbered image files as key frames of one tick; the sequence ends at its first missing number (per folder)."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").load(glob)
    no = F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("long")
    rows = files.select("path", F.regexp_replace("path", r"[^/]*$", "").alias("folder"), no.alias("n"), F.length("content").cast("long").alias("size"), F.col("content").alias("data")).where("n is not null")
    place = F.row_number().over(Window.partitionBy("folder").orderBy("n")) - 1
    first = F.min("n").over(Window.partitionBy("folder"))
    kept = rows.withColumns({"frame_no": place.cast("long"), "__f": first}).where((F.col("__f") <= 1) & (F.col("n") - F.col("__f") == F.col("frame_no")))
    return kept.select("path", "frame_no", F.col("frame_no").alias("pts"), F.lit(fps).alias("timescale"), F.lit(1).cast("long").alias("duration"), F.lit(True).alias("key"), "size", "data")
