"""Still pictures: PNG decoding (all colour types and depths, filters, interlacing) to planes of 8-bit values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .base import scan

PICTURE = "width int, height int, channels int, pixels binary"
#: Fixed: channels by colour type; start and step of the seven interlace passes (x0, y0, dx, dy).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(kind: int, row: bytearray, above: bytes, step: int) -> None:
    for i in range(len(row)):
        a = row[i - step] if i >= step else 0
        b = above[i]
        if kind == 1:
            p = a
        elif kind == 2:
            p = b
        elif kind == 3:
            p = (a + b) >> 1
        else:
            c = above[i - step] if i >= step else 0
            e = a + b - c
            near = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))
            p = near[2]
        row[i] = (row[i] + p) & 255


def png_pictures(data: bytes) -> Iterator[tuple]:
    """One row; palettes become RGB (RGBA with transparency), 16-bit samples keep their high byte, missing rows are zero."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return
    at, packed, palette, alpha, head = 8, [], b"", b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            alpha = body
        at += 12 + size
    if not head or head[3] not in CHANNELS:
        return
    w, h, depth, colour, _, _, laced = head
    raw = zlib.decompressobj().decompress(b"".join(packed))
    n = CHANNELS[colour]
    out = bytearray(w * h * n)
    step, pos = max(1, n * depth // 8), 0
    top = (1 << depth) - 1
    for x0, y0, dx, dy in PASSES if laced else ((0, 0, 1, 1),):
        cols, lines = max(0, -(-(w - x0) // dx)), max(0, -(-(h - y0) // dy))
        if not cols:
            continue
        width = (cols * n * depth + 7) // 8
        above = bytes(width)
        for y in range(lines):
            if pos + 1 + width > len(raw):
                break
            row = bytearray(raw[pos + 1 : pos + 1 + width])
            if raw[pos]:
                _unfilter(raw[pos], row, above, step)
            pos += 1 + width
            above = bytes(row)
            if depth == 16:
                values = row[::2]
            elif depth == 8:
                values = row
            else:
                each = 8 // depth
                values = [row[i // each] >> (8 - depth * (i % each + 1)) & top for i in range(cols * n)]
                if colour == 0:
                    values = [v * 255 // top for v in values]
            for x in range(cols):
                to = ((y0 + y * dy) * w + x0 + x * dx) * n
                out[to : to + n] = bytes(values[x * n : x * n + n])
    if colour == 3:
        shades = [palette[3 * i : 3 * i + 3] + (bytes([alpha[i] if i < len(alpha) else 255]) if alpha else b"") for i in range(len(palette) // 3)]
        blank = bytes(4 if alpha else 3)
        out, n = b"".join(shades[v] if v < len(shades) else blank for v in out), 4 if alpha else 3
    yield w, h, n, bytes(out)


def read_png(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, png_pictures, PICTURE)
