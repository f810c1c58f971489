"""Virtual movies: lazily composed tracks, filters by name, and the byte and time look-ups of a server.

A virtual movie is a DataFrame of packet rows without bytes; data() joins bytes on at the very end, for the rows asked for only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edits, packets, repair

#: Filters by name, as a command line would ask for them: name=argument:argument.
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "limit": lambda df, n: packets.limit_frames(df, int(n)),
    "skip": lambda df, n: packets.skip_frames(df, int(n)),
    "clip": lambda df, a, b: packets.clip(df, int(a), int(b)),
    "shift": lambda df, by: repair.retime(df, shift=int(by)),
    "scale": lambda df, num, den: repair.retime(df, num=int(num), den=int(den)),
    "round": lambda df, grid: repair.retime(df, grid=int(grid)),
    "unwrap": lambda df, period: repair.unwrap(df, int(period)),
    "media": lambda df, kind: df.where(F.col("media") == kind.upper()),
    "interleave": lambda df, lead: packets.interleave(df, int(lead)),
}


def register(name: str, f: Callable[..., DataFrame]) -> None:
    FILTERS[name] = f


def apply(df: DataFrame, chain: str) -> DataFrame:
    """A chain of filters, such as "media=video,skip=10,limit=20"."""
    for item in filter(None, chain.split(",")):
        name, _, arguments = item.partition("=")
        if name not in FILTERS:
            raise ValueError(f"no such filter: {name}")
        df = FILTERS[name](df, *filter(None, arguments.split(":")))
    return df


class VirtualMovie:
    """Tracks laid out as one file of bytes: a header, then packets merged by time."""

    def __init__(self, tracks: DataFrame, header_bytes: int = 0):
        self.packets = tracks
        self.placed = packets.merge_positions(tracks, header_bytes)

    def byte_range(self, start: int, end: int) -> DataFrame:
        return packets.byte_range(self.placed, start, end)

    def at_time(self, points: DataFrame) -> DataFrame:
        return packets.seek(self.packets, points)

    def frames(self, track_id: int, first: int, last: int) -> DataFrame:
        return self.placed.where((F.col("track_id") == track_id) & F.col("frame_no").between(first, last))

    def info(self) -> DataFrame:
        return packets.track_meta(self.packets)

    def data(self, rows: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
        """Bytes for the rows asked for: rows is the small side and store is scanned with its keys only where they match."""
        return rows.join(store, key)

    def edited(self, edit_lists: DataFrame) -> DataFrame:
        return edits.edited_frames(self.packets.withColumn("duration", F.col("duration")), edit_lists)
