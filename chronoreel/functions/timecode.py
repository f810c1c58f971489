"""Tape timecode, calendar and duration columns. Integer arithmetic only; bad input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1904-01-01 to 1970-01-01.
MAC_EPOCH = 2082844800


def _div(a: Column, b: int) -> Column:
    """Division that truncates towards zero."""
    return ((a - a % b) / b).cast("long")


def drop_frame_number(frame: Column) -> Column:
    """Frame count to the count with dropped numbers put in: 18 for ten minutes, 2 for each other minute."""
    tens, rest = _div(frame, 17982), frame % 17982
    return frame + tens * 18 + _div(rest - 2, 1798) * 2


def format_timecode(frame: Column, fps: int, drop: bool = False) -> Column:
    f = drop_frame_number(frame) if drop else frame
    sec = _div(f, fps)
    return F.format_string("%02d:%02d:%02d" + (";" if drop else ":") + "%02d", _div(sec, 3600), _div(sec, 60) % 60, sec % 60, f % fps)


def parse_timecode(text: Column, fps: int) -> Column:
    """hh:mm:ss:ff, with ; before ff for drop-frame, to a frame count; null if it isn't one (hours of 2 to 12 digits, ff from 00 to 29)."""
    good = text.rlike(r"^[0-9]{2,12}:[0-5][0-9]:[0-5][0-9][:;][0-2][0-9]\z")
    part = lambda a: F.substring(text, a, 2).cast("long")
    minutes = F.substring_index(text, ":", 1).cast("long") * 60 + part(-8)
    count = (minutes * 60 + part(-5)) * fps + part(-2)
    dropped = F.when(F.substring(text, -3, 1) == ";", (minutes - _div(minutes, 10)) * 2).otherwise(0)
    return F.when(good, count - dropped)


def mac_to_unix(seconds: Column) -> Column:
    return seconds - MAC_EPOCH


def unix_to_mac(seconds: Column) -> Column:
    return seconds + MAC_EPOCH


def parse_period(text: Column) -> Column:
    """PT#H#M#S to milliseconds; null unless it starts with PT."""
    n = lambda unit, kind: F.coalesce(F.nullif(F.regexp_extract(text, rf"([0-9.]+){unit}", 1), F.lit("")).cast(kind), F.lit(0).cast(kind))
    total = n("H", "long") * 3600000 + n("M", "long") * 60000 + F.floor(n("S", "decimal(20,6)") * 1000 + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    return F.when(text.startswith("PT"), total)


def parse_dpx_date(text: Column) -> Column:
    """yyyy:MM:dd:HH:mm:ss with an optional :+hh or :+hhmm to epoch seconds UTC; null for anything else."""
    good = text.rlike(r"^[0-9]{4}(:[0-9]{2}){5}(:[+-][0-9]{2}([0-9]{2})?)?$")
    stamp = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd:HH:mm:ss"))
    zone = F.regexp_extract(text, r":([+-][0-9]{2})([0-9]{2})?$", 1)
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, r":[+-][0-9]{2}([0-9]{2})$", 1), F.lit("")).cast("long"), F.lit(0))
    offset = F.when(zone == "", 0).otherwise(F.coalesce(F.nullif(zone, F.lit("")).cast("long"), F.lit(0)) * 3600 + F.when(zone.startswith("-"), -60).otherwise(60) * minutes)
    return F.when(good, F.unix_timestamp(stamp) - offset)


def timecode_frame(value: Column, duration: int) -> Column:
    """Time value to the nearest frame: ((2 * value div duration) + 1) div 2."""
    return _div(_div(value * 2, duration) + 1, 2)
