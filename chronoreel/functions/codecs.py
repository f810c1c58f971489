"""Sample and pixel codecs that need no state between frames: packed 10-bit pictures, PPM and the PCM of discs."""

from __future__ import annotations

import struct

import numpy as np


def v210_to_planes(data: bytes, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4:2:2 10-bit rows (six pixels in four little-endian words, rows padded to 128 bytes) to planes."""
    stride = (width + 47) // 48 * 128
    words = np.frombuffer(data[: stride * height], "<u4").reshape(height, stride // 4)
    parts = np.stack([words & 1023, words >> 10 & 1023, words >> 20 & 1023], 2).reshape(height, -1)
    return parts[:, 1::2][:, :width], parts[:, 0::4][:, : (width + 1) // 2], parts[:, 2::4][:, : (width + 1) // 2]


def planes_to_v210(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> bytes:
    height, width = y.shape
    stride = (width + 47) // 48 * 128
    parts = np.zeros((height, stride // 4 * 3), np.uint32)
    parts[:, 1::2][:, :width] = y
    parts[:, 0::4][:, : u.shape[1]] = u
    parts[:, 2::4][:, : v.shape[1]] = v
    words = parts.reshape(height, -1, 3)
    return (words[:, :, 0] | words[:, :, 1] << 10 | words[:, :, 2] << 20).astype("<u4").tobytes()


def ppm(width: int, height: int, rgb: bytes) -> bytes:
    return f"P6 {width} {height} 255\n".encode() + rgb


def disc_pcm(data: bytes) -> tuple[int, int, int, list[int]]:
    """(rate, channels, bits, interleaved samples) of a disc's linear PCM packet behind its four-byte stream head.

    16-bit samples are big-endian; 20- and 24-bit ones come in groups of two samples a channel: the high 16 bits of all, then the rest.
    """
    form = data[5]
    bits, rate, channels = 16 + 4 * (form >> 6), (48000, 96000, 44100, 32000)[form >> 4 & 3], 1 + (form & 7)
    body = data[7:]
    if bits == 16:
        n = len(body) // 2
        return rate, channels, bits, list(struct.unpack(f">{n}h", body[: 2 * n]))
    out: list[int] = []
    per = 2 * channels
    size = per * 2 + (per if bits == 24 else per // 2)
    for at in range(0, len(body) - size + 1, size):
        high = struct.unpack(f">{per}h", body[at : at + 2 * per])
        low = body[at + 2 * per : at + size]
        for i, h in enumerate(high):
            rest = low[i] if bits == 24 else (low[i // 2] >> (4 if i % 2 == 0 else 0)) & 15
            out.append(h << (bits - 16) | rest)
    return rate, channels, bits, out

