"""Top-k, near-duplicates, long repeats, tool calls and the pipeline against brute force, and odd input."""

import hashlib
import json
import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F

from chronoreel.llm import minhash, suffixes, toolcalls, topk
from chronoreel.llm.components import components

VEC = "vec_id long, embedding array<float>, score long"


def test_top_k_with_ties_and_bad_vectors(spark):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-2, 2)) / 4 for _ in range(6)], 0) for i in range(150)]
    rows += [(1000, None, 0), (1020, [float("nan")] * 6, 0), (1040, [None] * 6, 0), (1060, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (7, rows[7][1], 0), (1080, [], 0), (1100, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, query_block=3, shard_rows=40).collect()]
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in good if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute_components(rows):
    sets, up = shingle_sets(rows), {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(7)
    word = lambda: "w%d" % r.randint(0, 400)
    rows, n = [], 0
    for _ in range(25):  # families whose members differ from their parent, not from each other alone
        base = [word() for _ in range(r.choice([3, 5, 8, 30, 120]))]
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "İ x")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, id int")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(df).collect()}
    want, sets = brute_components(rows)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(x["n_shingles"] == len(sets[i]) and x["kept"] == (want[i] == i) for i, x in got.items())
    assert minhash.dedup(df).count() == len(set(want.values())) and minhash.dedup(df).columns == df.columns


def test_near_duplicates_agree_with_sql(spark, data, tmp_path):
    c = duckdb.connect()
    odd = [(1, "One two three four five six"), (1, "ten nine eight seven six five four"), (7, "TEN nine eight seven six five four"), (3, "one  two three four five six"), (9, None), (None, "x y"), (None, None), (8, "x y"), (8, "x y"), (2, ""), (5, "\u0130 x"), (4, "x\x0by")]
    spark.createDataFrame(odd, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "odd"))
    for path in (str(tmp_path / "odd"), f"{data}/documents.parquet"):
        c.sql(f"create or replace view documents as select * from '{path}{'/*.parquet' if path.endswith('odd') else ''}'")
        rel = c.sql(minhash.ORACLE)
        got = [tuple(r) for r in minhash.near_duplicates(spark.read.parquet(path)).select(*rel.columns).collect()]
        assert sorted(map(str, got)) == sorted(map(str, rel.fetchall()))


def test_outsiders_link_through_mixed_buckets(spark):
    """Chains of near copies that start far from their bucket's head."""
    r = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        t = [f"w{r.randint(0, 5000)}" for _ in range(60)]
        for _ in range(25):
            rows.append((n, " ".join(t)))
            n += 1
            t = list(t)
            t[r.randrange(60)] = f"w{r.randint(0, 5000)}"
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)[0]


def test_near_duplicates_odd_input(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F")], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["component_id"], x["kept"]) for x in minhash.near_duplicates(df).collect())
    assert got == [("3", 3, True), ("3", 3, True), ("9", 3, False), ("None", None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[200:1200])
    regs = minhash.registers([a, b])
    est = minhash.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([1000]), np.array([1000]))[0]
    assert abs(est - 800 / 1200) < 0.13


def test_components_of_chains(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                cov[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(c for c, m in zip(b, cov, strict=True) if not m)
        out[i] = (len(b), sum(cov), sum(1 for j in range(len(cov)) if cov[j] and not (j and cov[j - 1])), hashlib.sha256(left).hexdigest())
    return out


def test_long_repeats_agree_with_sql(spark, data, tmp_path):
    c = duckdb.connect()
    r = random.Random(4)
    noise = "".join(r.choice("abcdefgh") for _ in range(300))
    odd = [(4, "m" * 220), (4, noise), (None, "k" * 150), (None, noise), (None, None), (9, ""), (2, noise[:150] + "\u00e9" * 80), (2, noise[:150] + "\u00e9" * 80)]
    spark.createDataFrame(odd, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "odd"))
    for path in (f"{data}/documents.parquet", str(tmp_path / "odd")):
        c.sql(f"create or replace view documents as select * from '{path}{'/*.parquet' if path.endswith('odd') else ''}'")
        rel = c.sql(suffixes.ORACLE)
        got = [tuple(r) for r in suffixes.repeats(spark.read.parquet(path)).select(*rel.columns).collect()]
        want = rel.fetchall()
        if path.endswith("odd"):  # rows of one doc_id: which of them is the earlier one is not said
            got, want = ([(i, n) for i, n, _, _, _ in x] for x in (got, want))
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_rows_of_one_doc_id_lose_only_what_repeats(spark):
    r = random.Random(5)
    noise = "".join(r.choice("abcdefgh") for _ in range(300))
    for i in (4, None):
        got = {x["n_bytes"]: x["n_removed"] for x in suffixes.repeats(spark.createDataFrame([(i, "m" * 220), (i, noise)], "doc_id long, text string")).collect()}
        assert got == {220: 219, 300: 0}


def test_an_anchor_of_many_strings_is_met_in_bounded_memory():
    import tracemalloc

    n, step = 200_000, 10_000
    every = [(np.full(step, suffixes.RUN), np.full(step, 7), np.arange(at, at + step), np.zeros(step, int), np.full(step, 3), np.arange(at, at + step) // 2) for at in range(0, n, step)]
    every.append((np.array([suffixes.RUN] * 2), np.array([8, 8]), np.array([1, 2]), np.array([0, 0]), np.array([3, 3]), np.array([5, 6])))
    tracemalloc.start()
    base, runs, marks, last = tracemalloc.get_traced_memory()[0], 0, 0, []
    for b in suffixes._meet(suffixes._batch(*x) for x in every):
        kind, key, c = (b.column(k).to_numpy() for k in ("kind", "key", "c"))
        runs += int(((kind == suffixes.RUN) & (key == 7) & (c == 1)).sum())
        marks += int((kind == suffixes.MARK).sum())
        last += c[key == 8].tolist()
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert runs + marks == n and marks >= n // 2 - n // step and last == [0, 0] and peak < 12_000_000


def test_long_repeats_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (99, 100, 130, 400)]
    rows = []
    for i in range(60):
        t = text(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            t += r.choice(shared)[r.randint(0, 5) :] + text(r.randint(0, 80))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "ab" * 400), (103, "x" * 100), (104, "x" * 99), (105, "q" * 5000), (106, rows[5][1]), (107, text(60000))]
    df = spark.createDataFrame([(i, t, b"z") for i, t in rows], "doc_id long, text string, data binary")
    want = brute_repeats(rows)
    for hot in (2000, 1):
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.repeats(df).collect()}
        assert got == want
    odd = spark.createDataFrame([(None, "k" * 150), (4, "m" * 120), (4, "m" * 120)], "doc_id long, text string")
    assert len(suffixes.repeats(odd).collect()) == 3 and suffixes.repeats(odd.limit(0)).count() == 0


def surrounded(r, lengths, n):
    text = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    passages = [text(k) for k in lengths]
    return [(i, text(r.randint(0, 90)) + passages[i % len(passages)] + text(r.randint(0, 90))) for i in range(n)]


def test_one_passage_in_many_surroundings_against_brute_force(spark, monkeypatch):
    rows = surrounded(random.Random(11), (33, 65, 66, 67, 68, 99, 100, 101, 140), 400)
    rows += [(1000 + i, t[i % 7 : len(t) - i % 5]) for i, t in rows[:100]]
    want = brute_repeats(rows)
    for hot in (2000, 20, 2):
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want


def test_strings_alike_in_their_anchor_only_cost_little(monkeypatch):
    """No text travels for anchors of many strings, and strings that share no more than an anchor are not compared."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    # of many passages the one that is the anchor of almost any window around it
    passage = min((text(40) for _ in range(3000)), key=lambda p: suffixes.gram_hashes(np.frombuffer(p.encode(), np.uint8), suffixes.GRAM).min())
    rows = [(i, text(r.randint(40, 90)) + passage + text(r.randint(40, 90))) for i in range(300)]
    docs = pa.table({"doc": [i for i, _ in rows], "packed": [zstandard.compress(t.encode()) for _, t in rows]})
    for hot in (2000, 20):
        monkeypatch.setattr(suffixes, "HOT", hot)
        runs = pa.Table.from_batches(suffixes._find_runs(docs.to_batches())).sort_by("key")
        met = pa.Table.from_batches(suffixes._meet(runs.to_batches()))
        met = met.filter(pc.equal(met["kind"], suffixes.RUN)).to_pylist()
        assert len(met) > 250 and (sum(x["c"] for x in met) > 250) == (hot == 20)
        wanted = [[x for x in met if x["doc"] == i] for i, _ in rows]
        batch = docs.append_column("wanted", pa.array([[{c: x[c] for c in ("key", "at", "n", "c")} for x in w] for w in wanted])).filter(pa.array([bool(w) for w in wanted])).combine_chunks().to_batches()
        strings = pa.Table.from_batches(suffixes._strings(batch)).sort_by([(c, "ascending") for c in ("key", "n", "doc", "at")])
        if hot == 20:
            assert len(strings) > 10_000 and sum(len(x or b"") for x in strings["data"].to_pylist()) < 10_000
        compared = []
        monkeypatch.setattr(suffixes, "repeated_windows", lambda strings, *a: compared.extend(strings) or (np.empty(0, np.int64),) * 2)
        assert not list(suffixes._compare(strings.combine_chunks().to_batches())) and not compared


def test_merged_transforms_give_sorted_suffixes_and_prefixes():
    """Small alphabets, many shards: marked windows against a dictionary."""
    r = random.Random(3)
    for _ in range(150):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 20))) for _ in range(r.randint(1, 12))]
        doc, at = np.array([r.randint(0, 3) for _ in strings]), np.arange(len(strings)) * 1000
        n = np.array([len(s) - 5 for s in strings])
        d, a = suffixes.repeated_windows(strings, doc, at, n, symbol=2, shards=3, length=6)
        first = {}
        every = [(s[p : p + 6], (int(dd), int(aa) + p)) for s, dd, aa in zip(strings, doc, at, strict=True) for p in range(len(s) - 5)]
        for w, place in every:
            first[w] = min(first.get(w, place), place)
        assert sorted(zip(d.tolist(), a.tolist(), strict=True)) == sorted(p for w, p in every if p > first[w])


def test_tool_calls(spark):
    schemas = {"add": {"properties": {"x": "integer", "y": "number", "o": "object"}, "required": ["x"]}}
    calls = [("a", None, "add", '{"y": 1.5, "x": 2, "o": {"b": 1, "a": [true, null]}}'), ("b", "a", "add", '{"x": "two"}'), ("c", "b", "add", "[1]"), ("d", "zz", "sub", "{}"), ("e", "f", "add", "{"), ("f", "e", "add", None), (None, None, "add", "{}"), ("a", None, "add", '{"y": 1.5, "x": 2, "o": {"b": 1, "a": [true, null]}}')]
    results = [("a", "3\n\"q\""), ("a", "9"), (None, "x"), ("c", None)]
    df = spark.createDataFrame(calls, "call_id string, after string, name string, arguments string")
    got = {r["call_id"]: r for r in toolcalls.link(df, spark.createDataFrame(results, "call_id string, content string"), schemas).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e", "f"] and got["a"]["n_rows"] == 2
    assert [got[k]["level"] for k in "abcdef"] == [0, 1, 2, 0, None, None]
    assert [got[k]["errors"] for k in "abcdef"] == ["", "x is not integer", "not an object", "unknown tool", "not an object", "not an object"]
    a = got["a"]["canonical"]
    assert a == '{"arguments":{"o":{"a":[true,null],"b":1},"x":2,"y":1.5},"id":"a","level":0,"name":"add","result":"3\\n\\"q\\""}' and json.loads(a)
    assert [got[k]["linked"] for k in "abcd"] == [True, False, True, False]
    assert toolcalls.link(df.limit(0), spark.createDataFrame([], "call_id string, content string"), schemas).count() == 0


def test_tool_calls_agree_with_sql(spark, data):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    rel = c.sql(toolcalls.ORACLE)
    out = toolcalls.link(*toolcalls.turns_as_calls(spark.read.parquet(f"{data}/conversations.parquet")), toolcalls.REPLY)
    assert sorted(map(str, (tuple(r) for r in out.select(*rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_orphan_results_and_all_turns(spark, data, tmp_path):
    calls = spark.createDataFrame([("a", None, "add", "{}")], "call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([("a", "2"), ("a", "1"), ("zz", "lost"), ("zz", "lost too")], "call_id string, content string")
    got = {r["call_id"]: r for r in toolcalls.link(calls, results, {"add": {"properties": {}}}).collect()}
    assert sorted(got) == ["a", "zz"] and got["a"]["linked"] and [got[k]["n_results"] for k in ("a", "zz")] == [2, 2]
    zz = got["zz"]
    assert (zz["linked"], zz["n_rows"], zz["valid"], zz["errors"], zz["level"]) == (False, 0, False, "no call", None)
    assert json.loads(zz["canonical"]) == {"arguments": None, "id": "zz", "level": None, "name": None, "result": "lost"}
    odd = [(1, 0, "system", "be \"kind\""), (1, 0, "system", "be brief"), (1, 1, "assistant", "hello"), (1, 2, "user", "hi"), (1, 3, "assistant", "x"), (1, 3, "assistant", "w"), (2, 0, "system", None), (2, 1, "tool", "t"), (2, 2, None, "?"), (2, 9, "assistant", None)]
    spark.createDataFrame(odd, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "odd"))
    for path in (str(tmp_path / "odd"), f"{data}/conversations.parquet"):
        c = duckdb.connect()
        c.sql(f"create view conversations as select * from '{path}{'/*.parquet' if path.endswith('odd') else ''}'")
        rel = c.sql(toolcalls.ORACLE_ALL)
        out = toolcalls.link(*toolcalls.all_turns_as_calls(spark.read.parquet(path)), toolcalls.TURNS)
        assert out.columns == rel.columns
        rows = out.collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, rel.fetchall()))
        n = c.sql("select count(*) from conversations").fetchall()[0][0]
        assert sum(r["n_rows"] + r["n_results"] for r in rows) == n


def test_long_chains_take_few_rounds(spark):
    rows = [(str(i), str(i - 1) if i else None, "t", "{}") for i in range(500)]
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(spark.createDataFrame(rows, "call_id string, after string, name string, arguments string").select("call_id", "after")).collect()}
    assert got == {str(i): i for i in range(500)}


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    from chronoreel.llm import mixing, pieces, quality, secrets
    from chronoreel.llm.common import materialize

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, data))
        assert docs.columns == names
        after[name] = (before, docs)
    before, kept = after["quality_rules"]
    assert {r["doc_id"] for r in quality.assess(before).where("kept").collect()} == {r["doc_id"] for r in kept.collect()}
    before, kept = after["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert {r["doc_id"] for r in kept.collect()} == set(brute_components(rows)[0].values())
    before, clean = after["secret_scan"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {i: secrets.redacted(t) for i, t in texts.items()}
    before, mixed = after["mix_sources"]
    n = defaultdict(int)
    for r in mixed.collect():
        n[r["doc_id"]] += 1
    assert dict(n) == {r["doc_id"]: r["n_copies"] for r in mixing.copies(before).where("n_copies > 0").collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, mixed, data).collect()
    model = pieces.Model(pieces.load())
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == sum(n.values()) and all(model.decode(r["token_ids"]) == texts[r["doc_id"]] and r["round_trip"] for r in out)


def test_pipeline_stages_take_odd_tables(spark, data):
    import corpus_pipeline

    from chronoreel.llm.common import materialize

    text = "one two three four five six seven eight nine ten "
    rows = [(1, None, "en", "a", 0, 5), (2, "", None, None, 0, 5), (3, text + "x1", "en", "a", 52, 5), (3, text + "x1", "en", "a", 52, 5), (None, text + "y2", None, None, 52, 5), (7, text + "token = abcdef123", "en", "b", 66, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    for docs, last in ((odd, {3, None, 7}), (odd.limit(0), set())):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, data))
            assert docs.columns == names
        out = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
        assert {r["doc_id"] for r in out} <= last and all(r["round_trip"] for r in out) and bool(out) == bool(last)
