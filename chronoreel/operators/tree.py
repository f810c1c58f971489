"""Element trees as edge tables: (file, node, parent, depth, path, tag, offset, size), and path queries over them.

A tree of any depth is rows; a path query is an array comparison, so it needs no recursion. Wildcards are nulls in the pattern.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = "file long, node int, parent int, depth int, path array<string>, tag string, offset long, size long"
TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?(/?)>", re.S)
#: Steps of paths that one batch of edges holds.
STEPS = 1 << 16
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def markup_edges(text: str) -> Iterator[tuple[int, int, int, list[str], str, int, int]]:
    """(node, parent, depth, path, tag, offset, size) of every element; unclosed ones end with their parent. Paths are made as they are asked for."""
    open_: list[list] = []
    done = []
    n = 0
    for m in TAG.finditer(text):
        tag = sys.intern((m[2] or "").lower())
        if not tag:
            continue
        if m[1]:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][3] == tag), None)
            while at is not None and len(open_) > at:
                e = open_.pop()
                e[5] = (m.end() if len(open_) == at else m.start()) - e[4]
            continue
        e = [n, open_[-1][0] if open_ else -1, len(open_) + 1, tag, m.start(), m.end() - m.start()]
        n += 1
        done.append(e)
        if tag not in VOID and not m[3]:
            open_.append(e)
    for e in open_:
        e[5] = len(text) - e[4]
    path: list[str] = []
    for node, parent, depth, tag, offset, size in done:
        path[depth - 1 :] = [tag]  # in document order the last element of each lesser depth is an ancestor
        yield node, parent, depth, path.copy(), tag, offset, size


def markup_tree(pages: DataFrame, key: str = "page_id", text: str = "html") -> DataFrame:
    """Every element of every page as an edge row. Null pages have none.

    A worker holds one page's elements and at most STEPS steps of paths (or one path) beside the batch it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
        names = ["file", "node", "parent", "depth", "path", "tag", "offset", "size"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        rows, steps = [], 0
        for b in batches:
            for i in range(b.num_rows):
                file = b.column(0)[i].as_py()
                for e in markup_edges(b.column(1)[i].as_py() or ""):
                    rows.append((file, *e))
                    steps += e[2]
                    if steps >= STEPS:
                        yield packed(rows)
                        rows, steps = [], 0
        yield packed(rows)

    return pages.select(F.col(key).cast("long").alias("file"), text).mapInArrow(run, EDGES)


def path_matches(path: Column, pattern: list[str | None]) -> Column:
    """Whether a path is the pattern, where null stands for any one step."""
    out = F.size(path) == len(pattern)
    for i, step in enumerate(pattern):
        if step is not None:
            out = out & (F.get(path, F.lit(i)) == step)
    return out


def find_all(tree: DataFrame, pattern: list[str | None]) -> DataFrame:
    return tree.where(path_matches(F.col("path"), pattern))


def find_first(tree: DataFrame, pattern: list[str | None]) -> DataFrame:
    """The first match of each file in document order."""
    hits = find_all(tree, pattern)
    return hits.groupBy("file").agg(F.min_by(F.struct(*[c for c in tree.columns if c != "file"]), "node").alias("n")).select("file", "n.*")


def find_deep(tree: DataFrame, tag: str) -> DataFrame:
    """Elements of a name that don't lie in another of that name."""
    return tree.where((F.col("tag") == tag) & (F.array_position("path", tag) == F.col("depth")))


def has_path(files: DataFrame, tree: DataFrame, pattern: list[str | None]) -> DataFrame:
    """Files (a column file) with a match."""
    return files.join(find_all(tree, pattern).select("file").distinct(), "file", "left_semi")


def illegal_children(tree: DataFrame, legal: DataFrame) -> DataFrame:
    """Elements whose (parent tag, tag) isn't in legal; roots are legal. Parents are the step before the last of the path."""
    pairs = tree.withColumn("parent_tag", F.get("path", F.col("depth") - 2)).where("depth > 1")
    return pairs.join(F.broadcast(legal), [pairs["parent_tag"] == legal["outer"], pairs["tag"] == legal["inner"]], "left_anti")


def hide(tree: DataFrame, tags: list[str]) -> DataFrame:
    """Elements renamed to free, with what they were kept in hidden_tag."""
    gone = F.col("tag").isin(tags)
    return tree.withColumns({"hidden_tag": F.when(gone, F.col("tag")), "tag": F.when(gone, "free").otherwise(F.col("tag"))})


def reveal(tree: DataFrame) -> DataFrame:
    return tree.withColumn("tag", F.coalesce("hidden_tag", "tag")).drop("hidden_tag")


def remove_children(tree: DataFrame, tags: list[str]) -> DataFrame:
    """The tree without the elements of these names and all below them."""
    return tree.where(~F.arrays_overlap("path", F.array(*map(F.lit, tags))))


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """A dimension look-up that falls back to the key itself: PID replacement, codec and extension maps. table has key and value."""
    return rows.join(table.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce("__v", F.col(key).cast(table.schema[value].dataType))).drop("__v")


def latest_version(versions: DataFrame, key: str, order: list[str], back: int = 0) -> DataFrame:
    """The latest row per key, or the one back versions earlier; keys with fewer versions have none."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return versions.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == back + 1).drop("__r")
