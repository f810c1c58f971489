"""MPEG transport and program streams: fixed packets, program tables, elementary packets with 33-bit times."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .base import scan

TS_PACKET = "idx long, pid int, payload_start boolean, continuity int, payload binary"
PES = "pid int, stream_id int, pts long, dts long, pos long, size long, data binary"
PROGRAM = "program int, pmt_pid int, stream_type int, pid int"
NAL = "idx long, nal_type int, ref_idc int, offset long, size long"
#: Fixed kinds of stream types.
VIDEO_TYPES = {1, 2, 16, 27, 36}
AUDIO_TYPES = {3, 4, 15, 17, 129}


def ts_packets(data: bytes) -> Iterator[tuple]:
    for i in range(len(data) // 188):
        p = data[i * 188 : i * 188 + 188]
        if p[0] != 0x47:
            continue
        flags = p[3] >> 4 & 3
        at = 4 + (1 + p[4] if flags & 2 else 0)
        yield i, (p[1] & 31) << 8 | p[2], bool(p[1] & 64), p[3] & 15, p[at:] if flags & 1 else b""


def _sections(data: bytes, pid: int) -> Iterator[bytes]:
    held = b""
    for _, p, start, _, payload in ts_packets(data):
        if p != pid or not payload:
            continue
        if start:
            held = payload[1 + payload[0] :]
        elif held:
            held += payload
        if len(held) >= 3 and len(held) >= 3 + ((held[1] & 15) << 8 | held[2]):
            yield held[: 3 + ((held[1] & 15) << 8 | held[2])]
            held = b""


def programs(data: bytes) -> Iterator[tuple]:
    """Elementary streams of every program, from the first tables of each."""
    maps: dict[int, int] = {}
    for s in _sections(data, 0):
        for k in range(8, len(s) - 4, 4):
            number, pid = s[k] << 8 | s[k + 1], (s[k + 2] & 31) << 8 | s[k + 3]
            if number:
                maps.setdefault(number, pid)
        break
    for number, pmt in maps.items():
        for s in _sections(data, pmt):
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                yield number, pmt, s[at], (s[at + 1] & 31) << 8 | s[at + 2]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
            break


def read_time(b: bytes) -> int:
    """A 33-bit time from its five bytes."""
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def write_time(value: int, mark: int) -> bytes:
    """Five bytes of a 33-bit time with its four leading mark bits."""
    return bytes([mark << 4 | (value >> 30 & 7) << 1 | 1, value >> 22 & 255, (value >> 15 & 127) << 1 | 1, value >> 7 & 255, (value & 127) << 1 | 1])


def pes_header(p: bytes) -> tuple[int | None, int | None, int]:
    """(pts, dts, start of data) of an elementary packet of either version, from its start code on."""
    at = 6
    if p[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        return None, None, at
    if len(p) > 8 and p[6] & 0xC0 == 0x80:
        pts = read_time(p[9:14]) if p[7] & 0x80 and len(p) >= 14 else None
        dts = read_time(p[14:19]) if p[7] & 0xC0 == 0xC0 and len(p) >= 19 else None
        return pts, dts, 9 + p[8]
    while at < len(p) and p[at] == 0xFF:
        at += 1
    if at < len(p) and p[at] & 0xC0 == 0x40:
        at += 2
    if at < len(p) and p[at] & 0xF0 == 0x20:
        return read_time(p[at : at + 5]), None, at + 5
    if at < len(p) and p[at] & 0xF0 == 0x30:
        return read_time(p[at : at + 5]), read_time(p[at + 5 : at + 10]), at + 10
    return None, None, at + 1


def is_media(stream_id: int) -> bool:
    return 0xC0 <= stream_id <= 0xEF or stream_id == 0xBD


def ts_pes(data: bytes) -> Iterator[tuple]:
    """Elementary packets put together from transport packets."""
    held: dict[int, list] = {}

    def done(pid):
        pos, p = held.pop(pid)
        pts, dts, at = pes_header(p)
        return pid, p[3], pts, dts, pos, len(p) - at, bytes(p[at:])

    for i, pid, start, _, payload in ts_packets(data):
        if start and payload[:3] == b"\0\0\1" and len(payload) > 6:
            if pid in held:
                yield done(pid)
            held[pid] = [i * 188, bytearray(payload)]
        elif pid in held:
            held[pid][1] += payload
    for pid in sorted(held):
        yield done(pid)


def ps_pes(data: bytes) -> Iterator[tuple]:
    """Elementary packets of a program stream; a length of zero reaches to the next start code."""
    starts = re.compile(rb"\x00\x00\x01[\xb9-\xff]")
    at = 0
    while m := starts.search(data, at):
        p, sid = m.start(), data[m.end() - 1]
        at = m.end()
        if not is_media(sid) or p + 6 > len(data):
            continue
        n = data[p + 4] << 8 | data[p + 5]
        after = starts.search(data, at)
        end = p + 6 + n if n else (after.start() if after else len(data))
        packet = data[p : min(end, len(data))]
        pts, dts, head = pes_header(packet)
        yield 0, sid, pts, dts, p, len(packet) - head, packet[head:]
        at = max(at, end)


def nal_units(data: bytes) -> Iterator[tuple]:
    """Units between three- or four-byte start codes: number, type, reference level, offset, size."""
    marks = [m.span() for m in re.finditer(rb"\x00\x00\x00\x01|\x00\x00\x01", data)]
    for i, (_, a) in enumerate(marks):
        b = marks[i + 1][0] if i + 1 < len(marks) else len(data)
        if b > a:
            yield i, data[a] & 31, data[a] >> 5 & 3, a, b - a


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, ts_packets, TS_PACKET)


def read_ts_programs(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, programs, PROGRAM)


def read_ts_pes(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, ts_pes, PES)


def read_ps(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, ps_pes, PES)


def read_nal_units(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, nal_units, NAL)
