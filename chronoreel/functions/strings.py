"""Text and array helpers of the media model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(text: Column, pattern: str = r"\s+", most: int = -1) -> Column:
    """Parts without the empty ones; at most most."""
    parts = F.filter(F.split(text, pattern), lambda x: x != "")
    return F.slice(parts, 1, most) if most > 0 else parts


def capitalise(text: Column, delimiters: str = " ") -> Column:
    """First letter of each word in upper case, the rest as it is. Delimiters are kept."""
    out, first = text, delimiters[0]
    parts = F.transform(F.split(out, "[" + "".join("\\" + c for c in delimiters) + "]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.array_join(parts, first)


def zero_pad(number: Column, width: int) -> Column:
    """At least width digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def remove_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def dot_path(text: Column) -> Column:
    return F.split(text, r"\.")


def null_terminated(data: Column) -> Column:
    """Text before the first zero byte."""
    return F.regexp_extract(F.decode(data, "ISO-8859-1"), r"(?s)^([^\x00]*)", 1)


def fill_template(pattern: str, values: dict[str, Column]) -> Column:
    """$Name$ and $Name%0nd$ in pattern filled in."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$(\w+)(?:%0(\d+)d)?\$", pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        v = values[m[1]]
        parts.append(zero_pad(v, int(m[2])) if m[2] else v.cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def rotate(values: Column, by: int) -> Column:
    """Array moved left by by places, the front ones to the end."""
    n = F.size(values)
    k = F.when(n > 0, F.lit(by) % n).otherwise(0)
    return F.concat(F.slice(values, k + 1, n), F.slice(values, F.lit(1), k))


def permute(values: Column, order: list[int]) -> Column:
    return F.array(*(F.get(values, F.lit(i)) for i in order))


def bit_reverse8(b: Column) -> Column:
    out = F.lit(0)
    for k in range(8):
        out = out + F.shiftleft(F.shiftright(b, k).bitwiseAND(F.lit(1)), 7 - k)
    return out


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, 1).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin((n - 1).cast("long"))))).cast("long")


def log2_floor(n: Column) -> Column:
    return (F.length(F.bin(n.cast("long"))) - 1).cast("int")


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
