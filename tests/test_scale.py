"""Keys and tables past the sizes of the test data."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoreel.functions import binary as B
from chronoreel.functions import timecode as T
from chronoreel.operators import movies as M
from chronoreel.operators import tree
from chronoreel.plans import movie_queries


@pytest.mark.parametrize("drop", [False, True])
def test_timecodes_of_hundred_hours_and_more(spark, drop):
    frames = [0, 1799, 1800, 10799999, 10800000, 10800001, 10810809, 99699003, 107999999, 5981999003]
    rows = spark.createDataFrame([(x,) for x in frames], "f long").select("f", T.parse_timecode(T.format_timecode(F.col("f"), 30, drop), 30).alias("back")).collect()
    assert [r["back"] for r in rows] == [r["f"] for r in rows] == frames


def test_what_is_no_timecode_is_null(spark):
    texts = ["1:00:00:00", "100:60:00:00", "100:00:00:30", "100:00:00:00\n", "x100:00:00:00", "9999999999999:00:00:00", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.parse_timecode(F.col("t"), 30).alias("f")).collect()
    assert [r["f"] for r in rows] == [None] * len(texts)


def test_ebml_lengths(spark):
    edges = [(n + 1, (1 << 7 * n) - 1) for n in range(1, 8)] + [(n, (1 << 7 * n) - 2) for n in range(1, 9)]
    rows = spark.createDataFrame(edges, "n int, v long").select("n", "v", B.ebml_length(F.col("v")).alias("length"), B.ebml(F.col("v")).alias("text"), B.from_ebml(B.ebml(F.col("v"))).alias("back")).collect()
    assert [(r["length"], len(r["text"]) // 2, r["back"]) for r in rows] == [(r["n"], r["n"], r["v"]) for r in rows]


def test_edges_leave_in_small_batches(spark):
    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    deep, flat = "<a>" * 300, "<ul>" + "<li>x</li>" * 2000 + "</ul>"
    texts = ([deep, None, flat, ""] * 20)[:-1]
    pages = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["file", "html"])
    out = list(tree.markup_tree(Pages())(iter([pages, pages])))
    assert max(sum(len(p) for p in b.column(4)) for b in out) < 65536 + 300
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, *e) for i, t in [*enumerate(texts)] * 2 for e in tree.markup_edges(t or "")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_sorts_runs_and_no_samples(spark, data):
    text = plan(movie_queries.split_chunks(spark, data))
    assert not {"Sort", "Exchange", "Window"} & set(text[: text.index("Generate explode")].replace("[", " ").split())
    assert text.count("Exchange hashpartitioning") == 1


def test_samples_of_odd_runs(spark):
    rows = spark.createDataFrame([(1, 0, 2, 5), (1, 1, 3, None), (1, 2, 1, 7), (2, 0, 1, 4), (None, 0, 2, 3)], "track_id long, run int, count int, duration long")
    got = {tuple(r) for r in movie_queries.samples(rows).collect()}
    assert got == {(1, 0, 0, 5), (1, 1, 5, 5), (1, 2, 10, None), (1, 3, 10, None), (1, 4, 10, None), (1, 5, 10, 7), (2, 0, 0, 4), (None, 0, 0, 3), (None, 1, 3, 3)}


def test_split_with_and_without_known_times(spark, data):
    rows = movie_queries.samples(movie_queries.sample_runs(spark, data)).withColumn("cut", F.lit(100))
    for up in (False, True):
        assert not M.split_chunks(rows, "cut", up).exceptAll(M.split_chunks(rows, "cut", up, "start")).take(1)


def test_cutting_sorts_samples_once(spark, data):
    text = plan(movie_queries.cut_chunks_edits(spark, data))
    assert text.count("Generate explode(sequence(0") <= 2
    assert sum("sample#" in line for line in text.splitlines() if "- Sort [" in line) == 1


def test_samples_between_many_gaps(spark):
    durations = {t: [1 + (t * 7 + i * i) % 9 for i in range(40)] for t in range(6)}
    samples, gaps, kept, edits = [], [], [], []
    for t, each in durations.items():
        start, new, where = 0, 0, []
        own = [(a, a + 3 + 5 * k) for k, a in enumerate(range(5 * t, sum(each) - 40, 37))][: 2 * t]  # that of track 1 and later ends inside; track 0 has none
        gaps += [(t, a, b) for a, b in own]
        for i, d in enumerate(each):
            samples.append((t, i, start, d))
            if not any(a <= start and start + d <= b + 1 for a, b in own):
                kept.append((t, i, start, d, new))
                where.append((start, new))
                new += d
            start += d
        bounds = [(a, b) for a, b in zip([0, *(g[1] + 1 for g in own)], [*(g[0] for g in own), start], strict=True) if b > a]
        for k, (a, b) in enumerate(bounds):
            s, n = max(x for x in where if x[0] <= a)
            edits.append((t, k, n + a - s, b - a))
    assert gaps
    a, b = M.cut_to_gaps(spark.createDataFrame(samples, "track_id long, sample long, start long, duration long"), spark.createDataFrame(gaps, "track_id long, gap_start long, gap_end long"))
    assert sorted(map(tuple, a.collect())) == kept
    assert sorted(map(tuple, b.collect())) == edits
