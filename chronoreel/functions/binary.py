"""Bit, variable-length integer, start-code and PCM columns, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, i: Column | int) -> Column:
    """Unsigned byte at position i (from 0)."""
    at = (i if isinstance(i, Column) else F.lit(i)) + 1
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")


def bytes_of(data: Column) -> Column:
    """All bytes as an array of ints."""
    return F.when(F.length(data) > 0, F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def bits_of(data: Column) -> Column:
    """All bits as text of 0 and 1."""
    return F.array_join(F.transform(bytes_of(data), lambda b: F.lpad(F.bin(b.cast("long")), 8, "0")), "")


def read_bits(data: Column, at: int, n: int) -> Column:
    """n bits from bit at on, as a number."""
    return F.conv(F.substring(bits_of(data), at + 1, n), 2, 10).cast("long")


def uint_be(data: Column, at: int, n: int) -> Column:
    """n bytes from byte at on, most significant first."""
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")


def uint_le(data: Column, at: int, n: int) -> Column:
    return F.conv(F.array_join(F.array(*(F.substring(F.hex(data), 2 * (at + k) + 1, 2) for k in reversed(range(n)))), ""), 16, 10).cast("long")


def ber32(value: Column) -> Column:
    """A number under 2**28 as four bytes of seven bits, the first three marked as followed, in hex."""
    part = lambda k, mark: F.shiftright(value, 7 * k).bitwiseAND(F.lit(127)) + mark
    return F.concat(*(F.lpad(F.hex(part(k, 128 if k else 0).cast("long")), 2, "0") for k in (3, 2, 1, 0)))


def from_ber32(text: Column) -> Column:
    digit = lambda k: F.conv(F.substring(text, 2 * k + 1, 2), 16, 10).cast("long").bitwiseAND(F.lit(127))
    return F.shiftleft(digit(0), 21) + F.shiftleft(digit(1), 14) + F.shiftleft(digit(2), 7) + digit(3)


def ebml_length(value: Column) -> Column:
    """Bytes that an EBML number takes: the least n with value < 2**(7n) - 1."""
    out = F.lit(8)
    for n in range(7, 0, -1):
        out = F.when(value < (1 << (7 * n)) - 1, n).otherwise(out)
    return out


def ebml(value: Column) -> Column:
    """An EBML number in hex: the length marked by the place of the leading one."""
    n = ebml_length(value)
    out = F.lit(None).cast("string")
    for k in range(1, 9):
        out = F.when(n == k, F.lpad(F.hex((value + (1 << (7 * k))).cast("long")), 2 * k, "0")).otherwise(out)
    return out


def from_ebml(text: Column) -> Column:
    n = (F.length(text) / 2).cast("int")
    raw = F.conv(text, 16, 10).cast("long")
    return raw - F.call_function("shiftleft", F.lit(1).cast("long"), n * 7)


def golomb(value: Column) -> Column:
    """A signed number as its code number: 1, -1, 2, -2 as 1, 2, 3, 4."""
    return F.when(value > 0, value * 2 - 1).otherwise(value * -2)


def from_golomb(code: Column) -> Column:
    half = F.shiftright(code + 1, 1)
    return F.when(code % 2 == 1, half).otherwise(-half)


def exp_golomb_bits(code: Column) -> Column:
    """The exponential Golomb code of a number as text of bits."""
    b = F.bin((code + 1).cast("long"))
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def from_exp_golomb_bits(bits: Column) -> Column:
    """The number of the first code in bits."""
    zeros = F.length(F.regexp_extract(bits, "^0*", 0))
    return F.conv(F.substring(bits, zeros + 1, zeros + 1), 2, 10).cast("long") - 1


def pack(high: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(high.cast("long"), bits).bitwiseOR(low.cast("long").bitwiseAND(F.lit((1 << bits) - 1)))


def unpack_high(value: Column, bits: int) -> Column:
    return F.shiftright(value, bits)


def unpack_low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def escape_nal(text: Column) -> Column:
    """Start-code emulation prevented in hex text of whole bytes: 00 00 followed by 00-03 gets 03 between."""
    spaced = F.regexp_replace(text, "(..)", "$1 ")
    spaced = F.regexp_replace(spaced, "00 00 (?=0[0-3] )", "00 00 03 ")
    return F.replace(spaced, F.lit(" "), F.lit(""))


def unescape_nal(text: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(text, "(..)", "$1 "), "00 00 03 ", "00 00 ")
    return F.replace(spaced, F.lit(" "), F.lit(""))


def pcm16(data: Column, big_endian: bool = False) -> Column:
    """16-bit samples as an array of signed ints."""
    h = F.hex(data)
    n = F.floor(F.length(data) / 2).cast("int")

    def sample(i: Column) -> Column:
        a, b = F.substring(h, i * 4 - 3, F.lit(2)), F.substring(h, i * 4 - 1, F.lit(2))
        v = F.conv(F.concat(a, b) if big_endian else F.concat(b, a), 16, 10).cast("int")
        return F.when(v >= 32768, v - 65536).otherwise(v)

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), sample)).otherwise(F.array().cast("array<int>"))


def to_pcm16(x: Column) -> Column:
    """A level from -1 to 1 as a 16-bit sample, clipped."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)) * 32767 + 0.5).cast("int")


def fourcc(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "US-ASCII")


def fourcc_number(text: Column) -> Column:
    return F.conv(F.hex(F.substring(text, 1, 4)), 16, 10).cast("long")
