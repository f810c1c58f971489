"""Format probes: scores of a file's first bytes as column expressions; the highest positive score wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed signatures: format, byte offset, bytes in hex, score.
SIGNATURES = (
    ("mov", 4, "66747970", 100), ("mov", 4, "6D6F6F76", 90), ("mov", 4, "6D646174", 60), ("mov", 4, "77696465", 50), ("mkv", 0, "1A45DFA3", 100), ("avi", 0, "52494646", 30), ("wav", 8, "57415645", 100), ("webp", 8, "57454250", 100),
    ("flv", 0, "464C5601", 100), ("y4m", 0, "595556344D50454732", 100), ("ivf", 0, "444B4946", 100), ("png", 0, "89504E470D0A1A0A", 100), ("jpeg", 0, "FFD8FF", 90), ("mps", 0, "000001BA", 80), ("mxf", 0, "060E2B34", 90),
    ("mp3", 0, "494433", 70), ("dpx", 0, "53445058", 90), ("h264", 0, "0000000167", 60),
)


def scores(data: Column) -> Column:
    """array<struct<score, format>> of every signature that fits; a transport stream by its repeated sync byte."""
    def of(h: Column) -> Column:
        hits = [F.when(F.substring(h, 2 * at + 1, len(sig)) == sig, F.struct(F.lit(score).alias("score"), F.lit(name).alias("format"))) for name, at, sig, score in SIGNATURES]
        sync = (F.substring(h, 1, 2) == "47") & (F.substring(h, 377, 2) == "47") & (F.substring(h, 753, 2) == "47")
        hits.append(F.when(sync, F.struct(F.lit(100).alias("score"), F.lit("mpegts").alias("format"))))
        return F.array_compact(F.array(*hits))

    # a lambda variable, so that the hex text is made once a row
    return F.element_at(F.transform(F.array(F.hex(F.substring(data, 1, 600))), of), 1)


def detect(data: Column) -> Column:
    """The format with the highest score, null if none fits."""
    return F.array_max(scores(data))["format"]
