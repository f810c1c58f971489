"""Streaming manifests: segment rows of a DASH manifest, one for each media segment of each representation."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .base import scan

SEGMENT = "period int, adaptation int, representation string, mime string, bandwidth long, timescale long, number long, start long, duration long, url string"


def seconds(text: str | None) -> float | None:
    """PT#H#M#S; none for anything else."""
    m = re.fullmatch(r"PT(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?", text or "")
    return int(m[1] or 0) * 3600 + int(m[2] or 0) * 60 + float(m[3] or 0) if m else None


def fill(template: str, values: dict[str, object]) -> str:
    def one(m: re.Match) -> str:
        if m[1] == "":
            return "$"
        v = values[m[1]]
        return f"{int(v):0{m[2]}d}" if m[2] else str(v)

    return re.sub(r"\$(\w*)(?:%0(\d+)d)?\$", one, template)


def mpd_segments(data: bytes) -> Iterator[tuple]:
    """Segments from templates (by duration or timeline) and lists; inherited attributes come from the nearest parent that has them."""
    try:
        root = ET.fromstring(re.sub(rb'\sxmlns="[^"]*"', b"", data, count=1))
    except ET.ParseError:
        return
    if root.tag.rpartition("}")[2] != "MPD":
        return
    whole = seconds(root.get("mediaPresentationDuration"))
    for p, period in enumerate(root.iter("Period")):
        length = seconds(period.get("duration")) or whole
        for a, adaptation in enumerate(period.iter("AdaptationSet")):
            for rep in adaptation.iter("Representation"):
                above = [rep, adaptation, period]
                source = next((e.find(k) for e in above for k in ("SegmentTemplate", "SegmentList") if e.find(k) is not None), None)
                if source is None:
                    continue
                scale = int(source.get("timescale", 1))
                head = (p, a, rep.get("id"), rep.get("mimeType") or adaptation.get("mimeType"), int(rep.get("bandwidth", 0)), scale)
                first, step = int(source.get("startNumber", 1)), int(source.get("duration", 0))
                spans: list[tuple[int, int]] = []
                timeline = source.find("SegmentTimeline")
                if timeline is not None:
                    at = 0
                    for s in timeline.iter("S"):
                        at = int(s.get("t", at))
                        for _ in range(int(s.get("r", 0)) + 1):
                            spans.append((at, int(s.get("d"))))
                            at += int(s.get("d"))
                elif source.tag == "SegmentList":
                    spans = [(i * step, step) for i in range(len(source.findall("SegmentURL")))]
                elif step and length:
                    total = int(length * scale)
                    spans = [(t, min(step, total - t)) for t in range(0, total, step)]
                urls = [u.get("media") for u in source.findall("SegmentURL")]
                for i, (start, duration) in enumerate(spans):
                    url = urls[i] if urls else fill(source.get("media", ""), {"RepresentationID": rep.get("id"), "Number": first + i, "Time": start, "Bandwidth": head[4]})
                    yield *head, first + i, start, duration, url


def read_mpd(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, mpd_segments, SEGMENT)
