"""Media files as rows: Spark reads the files (any path it can read), a parser turns each file's bytes into rows.

A parser is a generator bytes -> tuples; scan() gives its rows with the file's path in front. Files are dealt over tasks as Spark deals
binary files (one file is one row, up to 2 GB). Bytes that are no such file give no rows; a cut-off file gives what is whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 4096


def parse_files(files: DataFrame, parser: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """files has path and content."""
    out = StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        rows: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for r in parser(content.as_py() or b""):
                    rows.append((path.as_py(), *r))
                    if len(rows) >= ROWS_AT_ONCE:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return files.select("path", "content").mapInArrow(run, out)


def scan(spark: SparkSession, path: str, parser, schema: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path), parser, schema)
