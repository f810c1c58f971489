"""Media files as a sink: each group of packets becomes the bytes of one file, in a row (path, content).

The bytes of a file are made in one task, as the file is one object; groups run side by side. write_files() puts the rows where an
executor can write; nothing is collected to the driver.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame

FILE = "path string, content binary"


def wav_bytes(packets: list[bytes], rate: int, channels: int = 1, bits: int = 16) -> bytes:
    body = b"".join(packets)
    width = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def ivf_bytes(packets: list[bytes], pts: list[int], num: int, den: int, width: int = 0, height: int = 0, codec: bytes = b"VP80") -> bytes:
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, codec, width, height, num, den, len(packets), 0)
    return head + b"".join(struct.pack("<IQ", len(p), t) + p for p, t in zip(packets, pts, strict=True))


def y4m_bytes(frames: list[bytes], width: int, height: int, num: int = 25, den: int = 1) -> bytes:
    return f"YUV4MPEG2 W{width} H{height} F{num}:{den} C420\n".encode() + b"".join(b"FRAME\n" + f for f in frames)


def flv_bytes(tags: list[tuple[str, int, bytes]]) -> bytes:
    """(kind, pts in ms, body) tags."""
    kinds = {"audio": 8, "video": 9, "script": 18}
    out = [b"FLV\x01\x05\x00\x00\x00\x09\x00\x00\x00\x00"]
    for kind, pts, body in tags:
        out.append(bytes([kinds[kind]]) + len(body).to_bytes(3, "big") + (pts & 0xFFFFFF).to_bytes(3, "big") + bytes([pts >> 24 & 255]) + b"\0\0\0" + body + struct.pack(">I", len(body) + 11))
    return b"".join(out)


def _runs(values: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1][0] += 1
        else:
            out.append([1, v])
    return [tuple(r) for r in out]


def _box(tag: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + tag + body


def _table(tag: bytes, rows: list[tuple], fmt: str) -> bytes:
    return _box(tag, struct.pack(">II", 0, len(rows)), *(struct.pack(fmt, *r) for r in rows))


def mp4_bytes(packets: list[bytes], durations: list[int], keys: list[bool], timescale: int, handler: bytes = b"vide", codec: bytes = b"raw ", per_chunk: int = 8, edits: list[tuple[int, int]] = (), header_first: bool = False) -> bytes:
    """A one-track movie: media data in chunks of per_chunk samples and run-length tables."""
    sizes, total = [len(p) for p in packets], sum(durations)

    def header(base: int) -> bytes:
        offsets, at = [], base
        for i, size in enumerate(sizes):
            if i % per_chunk == 0:
                offsets.append(at)
            at += size
        full, rest = divmod(len(packets), per_chunk)
        stsc = ([(1, per_chunk, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
        tables = [_table(b"stsd", [], ">"), _table(b"stts", _runs(durations), ">II"), _table(b"stsc", stsc, ">III"), _box(b"stsz", struct.pack(">III", 0, 0, len(sizes)), *(struct.pack(">I", x) for x in sizes)), _table(b"stco", [(o,) for o in offsets], ">I")]
        tables[0] = _box(b"stsd", struct.pack(">II", 0, 1), struct.pack(">I4sIHH", 16, codec, 0, 0, 1))
        if not all(keys):
            tables.append(_table(b"stss", [(i + 1,) for i, k in enumerate(keys) if k], ">I"))
        mdhd = _box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, timescale, total, 0, 0))
        hdlr = _box(b"hdlr", struct.pack(">II4s", 0, 0, handler), b"\0" * 13)
        mdia = _box(b"mdia", mdhd, hdlr, _box(b"minf", _box(b"stbl", *tables)))
        tkhd = _box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, total), b"\0" * 60)
        edts = [_box(b"edts", _table(b"elst", [(d, m, 65536) for d, m in edits], ">iii"))] if edits else []
        mvhd = _box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, timescale, total), b"\0" * 80)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, *edts, mdia))

    ftyp, mdat = _box(b"ftyp", b"isom\0\0\2\0isom"), _box(b"mdat", *packets)
    if header_first:
        return ftyp + header(len(ftyp) + len(header(0)) + 8) + mdat
    return ftyp + mdat + header(len(ftyp) + 8)


def _element(eid: int, body: bytes) -> bytes:
    n = next(k for k in range(1, 9) if len(body) < (1 << 7 * k) - 1)
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + (len(body) | 1 << 7 * n).to_bytes(n, "big") + body


def mkv_bytes(frames: list[tuple[int, bool, bytes]], track: int = 1) -> bytes:
    """(time, key, bytes) frames of one track; a cluster begins at each key frame, so the first must be one."""
    clusters: list[list] = []
    for t, key, data in frames:
        if key or not clusters:
            clusters.append([t, []])
        clusters[-1][1].append(_element(0xA3, bytes([0x80 | track]) + struct.pack(">hB", t - clusters[-1][0], 0x80 if key else 0) + data))
    number = lambda x: x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big")
    info = _element(0x1549A966, _element(0x2AD7B1, number(1_000_000)))
    tracks = _element(0x1654AE6B, _element(0xAE, _element(0xD7, number(track)) + _element(0x83, b"\1")))
    body = info + tracks + b"".join(_element(0x1F43B675, _element(0xE7, number(t)) + b"".join(blocks)) for t, blocks in clusters)
    return _element(0x1A45DFA3, b"") + _element(0x18538067, body)


def png_bytes(width: int, height: int, pixels: bytes, channels: int = 3) -> bytes:
    """8-bit grey (1), RGB (3) or RGBA (4) pixels, unfiltered rows."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    step = width * channels
    raw = b"".join(b"\0" + pixels[y * step : (y + 1) * step] for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def mux(packets: DataFrame, container: str, **options) -> DataFrame:
    """Packets (path, frame_no, pts, timescale, duration, key, data) to one file row per path: wav, ivf, y4m, flv, mp4 or mkv."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        data, pts, scale = [bytes(x) for x in pdf["data"]], [int(x) for x in pdf["pts"]], int(pdf["timescale"].iloc[0])
        if container == "wav":
            content = wav_bytes(data, scale, **options)
        elif container == "ivf":
            content = ivf_bytes(data, pts, scale, 1, **options)
        elif container == "y4m":
            content = y4m_bytes(data, num=scale, **options)
        elif container == "flv":
            content = flv_bytes([(options.get("kind", "video"), t * 1000 // scale, d) for t, d in zip(pts, data, strict=True)])
        elif container == "mp4":
            content = mp4_bytes(data, [int(x) for x in pdf["duration"]], [bool(x) for x in pdf["key"]], scale, **options)
        elif container == "mkv":
            content = mkv_bytes([(t * 1000 // scale, bool(k), d) for t, k, d in zip(pts, pdf["key"], data, strict=True)])
        else:
            raise ValueError(f"no such container: {container}")
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [content]})

    return packets.select("path", "frame_no", "pts", "timescale", "duration", "key", "data").groupBy("path").applyInPandas(run, FILE)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each (path, content) row as folder/path on a file system that all executors share; rows of (path, size) come back when run."""

    def run(batches):
        import os

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                to = os.path.join(folder, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to + ".part", "wb") as f:
                    f.write(content)
                os.replace(to + ".part", to)  # a task that runs again leaves one whole file
                out.append((path, len(content)))
            yield pd.DataFrame(out, columns=["path", "size"])

    return files.mapInPandas(run, "path string, size long")
