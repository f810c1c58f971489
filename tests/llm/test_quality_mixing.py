"""Quality rules and mixing: SQL agreement on real rows, and odd input."""

import duckdb
from pyspark.sql import functions as F

from chronoreel.llm import mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __w int, key string"


def odd(spark):
    long = " ".join(f"word{i}" for i in range(30000))
    rows = [
        (1, None, "en", "a", 0, 1, "x"), (2, "", None, None, 0, 1, "x"), (3, "a b c d e f g h i j", "en", "a", 19, 1, "x"), (4, long, "en", "b", len(long), 1, "x"), (5, "la " * 40, "en", "b", 120, 1, "x"),
        (5, "la " * 40, "en", "b", 120, 1, "x"), (None, "one two\x0bthree\tfour\nfive\n\nfive\nsix seven eight nine ten eleven #$|", None, "a", 60, None, None), (7, " \n ", "en", "", 3, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_base_statistics(spark):
    got = {r["doc_id"]: r for r in quality.base_statistics(odd(spark).select("doc_id", "text", "lang", "source")).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and got[2]["base_failed"] and got[7]["n_words"] == 0
    assert not got[3]["base_failed"] and got[3]["word_chars"] == 10
    assert got[4]["n_words"] == 30000 and got[4]["n_repeat_words"] == 0
    assert got[5]["n_repeat_words"] == 40 and got[5]["base_failed"]
    assert got[None]["n_symbols"] == 3 and got[None]["n_dup_lines"] == 1 and got[None]["n_words"] == 13


def test_repeat_words_against_brute_force(spark):
    import random

    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(200)]

    def brute(t):
        w = t.split()
        seen = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)})

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_repeat_words"] for x in quality.base_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rules_keep_columns_and_small_groups(spark):
    out = quality.apply_rules(odd(spark))
    assert out.columns == odd(spark).columns
    assert {r["doc_id"] for r in out.collect()} == {3, 4, None}
    assert quality.assess(odd(spark).limit(0)).count() == 0


def test_outliers_go(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(60 + i % 50)), "en", "s", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(f"#{k}$|" for k in range(i * 50, i * 50 + 50)), "en", "s", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(df).collect()}
    assert not any(kept[1000 + i] for i in range(10))
    assert all(kept[i] for i in range(300))


def test_mix_hits_targets(spark):
    rows = [(s * 1000 + i, "w " * (1 + (i * i) % 90), "en", None if s == 3 else f"s{s}", 0) for s in range(4) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.copies(df).toPandas()
    assert len(got) == 800 and (got["taken"] <= 3 * got["size"]).all()
    by = got.groupby(got["source"].fillna("none")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 45).all()
    assert abs(by["target"].sum() - got["size"].sum()) < 1e-6
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df).count() == got["n_copies"].sum()


def test_mix_odd_input(spark):
    df = odd(spark)
    got = mixing.copies(df).collect()
    assert len(got) == df.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.copies(df.limit(0)).count() == 0
    again = mixing.copies(df)
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))


def test_mix_agrees_with_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    want = c.sql(mixing.oracle_copies()).fetchall()
    got = [tuple(r) for r in mixing.copies(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(want)


def test_assess_agrees_with_sql(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{data}/documents.parquet'")
    rel = c.sql(quality.oracle_assess())
    got = [tuple(r) for r in quality.assess(docs).select(*rel.columns).collect()]
    assert sorted(got) == sorted(rel.fetchall())
    assert docs.select(F.count("*")).first()[0] == len(got)


def test_estimate_agrees_with_a_plain_search(spark):
    """Many random starts in numpy, each led to its end, and the least determinant of all."""
    import numpy as np

    r = np.random.default_rng(5)
    p, n = quality.P, 600
    shape = r.normal(0, 1, (p, p)) * 900 + np.eye(p) * 2500
    x = r.normal(0, 1, (n, p)) @ shape + 20000
    x[:110] = x[:110] * 0.2 + r.normal(0, 300, (110, p)) + 45000  # a tight crowd of outliers
    x = np.floor(x).astype(int)
    rows = [("o", "l", *map(int, v)) for v in x]
    names = [f"x{i}" for i in range(p)]
    est = quality.estimates(spark.createDataFrame(rows, "own string, of_lang string, " + ", ".join(f"{c} long" for c in names))).collect()
    assert len(est) == 1
    center = np.array([est[0][f"m{i}"] for i in range(p)])
    k = np.array([[est[0][f"k{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    h, best = -(-3 * n // 4), (np.inf, None)
    for _ in range(200):
        pick = r.choice(n, p + 1, replace=False)
        for _ in range(60):
            m, c = x[pick].mean(0), np.cov(x[pick].T, bias=True) + 1e-6 * np.eye(p)
            new = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        if np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], pick)
    m, c = x[best[1]].mean(0), np.cov(x[best[1]].T, bias=True) * quality.CONSISTENCY + np.diag(np.square(quality.FLOOR))
    want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    got = np.square((x - center) @ k.T).sum(1)
    assert np.abs(center - m).max() < 0.05 * np.sqrt(np.diag(c)).min()
    assert np.allclose(got, want, rtol=0.06) and (got[:110] > quality.CUTOFF).all() and (got[110:] < quality.CUTOFF).all()


def test_small_groups_are_judged(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 997}" for k in range(60 + i % 50)), "en", f"s{i % 40}", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(f"#{k}$|" for k in range(i * 50, i * 50 + 50)), "xx" if i else None, "alone", 0) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert not got[1000]["kept"] and not got[1001]["kept"] and all(got[i]["kept"] and got[i]["distance2"] is not None for i in range(300))


def test_clashing_names_stay(spark):
    text = "one two three four five six seven eight nine ten"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, `__row` long, id int, copy int, n int, `a b` string, own string, kept int, rid int"
    df = spark.createDataFrame([(i, text + f" {i}", "en", "s", 60, 7, 7, 8, 9, 10, "x", "o", 3, 4) for i in range(20)] + [(None, text, None, None, None, 7, 7, 8, 9, 10, "x", "o", 3, 4)] * 2, schema)
    for out in (quality.apply_rules(df), mixing.mix(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and {(r["row"], r["__row"], r["id"], r["copy"], r["n"], r["a b"], r["own"], r["kept"], r["rid"]) for r in rows} == {(7, 7, 8, 9, 10, "x", "o", 3, 4)}
    assert quality.apply_rules(df).count() == 22 and mixing.mix(df).count() == mixing.copies(df).agg(F.sum("n_copies")).first()[0]
