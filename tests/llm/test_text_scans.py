"""Secrets, pieces, classifier and pages: brute force, round trips, held-out accuracy, odd input."""

import pathlib
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoreel.llm import bytecnn, pages, pieces, secrets
from chronoreel.llm.common import shared_dir


def test_secret_spans_against_plain_rules():
    r = random.Random(3)
    bits = ["password", "PASSWD", "token", "api_key", "apikey", " ", ":", "=", "'", '"', "abc", "Zk3+/9==", "AKIA", "ABCD1234EFGH5678XY", "deadbeef01", "é", "\n", "secret=token: abcdefgh"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want)


def test_random_tokens_are_told_from_words():
    r = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hits = sum(bool(secrets.random_spans("x " + "".join(r.choice(b64) for _ in range(40)) + " y", [])) for _ in range(200))
    assert hits >= 180
    assert not secrets.random_spans("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 abcabcabcabcabcabcabcabcabcabc1", [])


def test_ordinary_tokens_are_left_alone():
    names = ["internationalization2024", "Chapter12TheReturnOfTheKing", "getElementsByTagNameNS", "erschlichchstscher", "9807915762804490", "2024/05/17/some-title-of-a-page", "SPARK_SQL_ADAPTIVE_ENABLED", "user_id_12345_session_67890", "a" * 40]
    assert not [t for t in names if secrets.random_spans(t, [])]
    r = random.Random(8)
    base36 = "abcdefghijklmnopqrstuvwxyz0123456789"
    assert sum(bool(secrets.random_spans("".join(r.choice(base36) for _ in range(40)), [])) for _ in range(200)) >= 160
    counts = next(secrets._scan(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["key = 04dbebab91ab85687d33eeaaf9ac699e1188f962"])], ["doc_id", "text"])])))
    assert [counts.column(c)[0].as_py() for c in ("n_hex", "n_random", "n_tested", "n_judged")] == [1, 0, 1, 1]


def test_battery_against_plain_sums():
    from fractions import Fraction
    from math import comb, exp, lgamma

    for n, x, p in ((5, 2, Fraction(1, 2)), (30, 9, Fraction(3, 20)), (400, 250, Fraction(1, 2)), (7, 0, Fraction(1, 2)), (7, 7, Fraction(3, 20))):
        want = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
        assert abs(secrets.binomial_upper(x, n, float(p)) - float(want)) < 1e-9
    assert abs(secrets.binomial_upper(1050, 2001, 0.5) - sum(exp(lgamma(2002) - lgamma(k + 1) - lgamma(2002 - k) - 2001 * 0.6931471805599453) for k in range(1050, 2002))) < 1e-3
    # equal pairs among digits: mean and variance from every word of three digits
    share = [d / sum(secrets.DIGITS) for d in secrets.DIGITS]
    words = [(share[a] * share[b] * share[c], (a == b) + (a == c) + (b == c)) for a in range(10) for b in range(10) for c in range(10)]
    mean = sum(p * k for p, k in words)
    _, squares, cubes = secrets.CLASSES["0123456789abcdef"][1]
    assert abs(mean - 3 * squares) < 1e-12 and abs(sum(p * (k - mean) ** 2 for p, k in words) - (3 * squares * (1 - squares) + 6 * (cubes - squares**2))) < 1e-12
    # Fisher's sum of three against integrating the product of uniform numbers
    r = random.Random(6)
    draws = [r.random() * r.random() * r.random() for _ in range(40000)]
    bare = "Zk3Qw9Lp2Xv7Tn4B"
    product = secrets.uniformity_p(bare, secrets.encoding(bare)[1]) * secrets.runs_p(bare) * secrets.serial_p(bare)
    assert abs(secrets.ordinary_p(bare) - sum(d <= product for d in draws) / len(draws)) < 0.01


def test_rejection_against_every_cut():
    r = random.Random(12)
    for _ in range(300):
        m = r.randint(1, 12)
        p, n = [r.random() ** r.choice((1, 6)) for _ in range(m)], [r.randint(16, 80) for _ in range(m)]
        q = [x / (k * m / sum(n)) for x, k in zip(p, n, strict=True)]
        best = set()
        for t in q:  # every rejection region that keeps the estimated false share under the level
            inside = {i for i in range(m) if q[i] <= t}
            if t * m / len(inside) <= 0.05 and len(inside) > len(best):
                best = inside
        assert {i for i, x in enumerate(secrets.rejected(p, n, 0.05)) if x} == best
    assert secrets.rejected([], []) == []


def test_mixed_and_partly_covered_tokens_reach_the_battery():
    r = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda n: "".join(r.choice(b64) for _ in range(n))
    mixed = ["sk-" + draw(20) + "/" + draw(20) for _ in range(200)]
    assert sum(secrets.redacted(f"x {t} y") == "x [SECRET] y" for t in mixed) >= 170
    partly = [draw(20) + "G" + "".join(r.choice("0123456789abcdef") for _ in range(24)) + "G" + draw(20) for _ in range(200)]
    assert sum(secrets.redacted(f"x {t} y") == "x [SECRET] y" for t in partly) >= 170
    words = "the-quick/brown_fox-jumps/over_the-lazy/dog_number-1"
    assert secrets.redacted(words) == words
    covered = "deadbeef01" * 4
    assert secrets.all_spans(covered)[1] == [(0, 2, 40)]
    path = "some/words-of_a/path-" + covered
    assert secrets.redacted(path) == "some/words-of_a/path-[SECRET]"


def test_scan_odd_input(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "password: hunter22 " * 3000, 0), (3, "password: hunter22 " * 3000, 0), (None, "token=abcdef", 0)], "doc_id long, text string, spans int")
    got = secrets.scan(df).collect()
    assert [r["n_assign"] for r in got] == [0, 0, 3000, 3000, 1] and got[0]["spans"] == "" and got[2]["base_sha256"] == got[3]["base_sha256"]
    red = secrets.redact(df.withColumn("n_chars", F.length("text").cast("long")))
    assert red.columns == [*df.columns, "n_chars"]
    assert [r["text"] for r in red.collect()][4] == "[SECRET]" and secrets.scan(df.limit(0)).count() == 0


def test_pieces_equal_the_library():
    spm = pytest.importorskip("sentencepiece")
    try:
        model = pieces.Model(pieces.load())
    except OSError:
        pytest.skip("no tokenizer files here")
    sp = spm.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    texts = ["", " ", "Hello  world\nfoo   bar", "日本 é ① \t x", "a" * 50000, "=" * 33, *(" " * k + "the" * j for k in range(40) for j in (0, 2))]
    texts += ["".join(r.choice("aaab  enthis\n\t日é①x   ") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice(list(model.ids)[:2000]) for _ in range(r.randint(1, 5))).replace("▁", " ") for _ in range(3000)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(t) and model.decode(ids.tolist()) == t


def test_unigram_models_take_the_best_sum():
    """A small unigram model written here: Viterbi against trying all cuts."""
    import struct

    def field(k, b):
        return bytes([k << 3 | 2]) + bytes([len(b)]) + b

    vocab = {"▁": -3.0, "▁a": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "ba": -2.4, "aba": -4.1, "bb": -3.9}
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s)) for p, s in vocab.items())
    model = pieces.Model(data + field(2, b"\x18\x01") + field(3, b"\x20\x00"))

    def best(w):
        return max(((0.0,),), key=lambda x: x[0])[0] if not w else max(s + best(w[len(p) :]) for p, s in vocab.items() if w.startswith(p))

    r = random.Random(2)
    for t in ("".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(100)):
        ids = model.encode([t])[0].tolist()
        assert abs(sum(model.score[i] for i in ids) - best("▁" + t)) < 1e-5


def test_encode_table(spark):
    try:
        data = pieces.load()
    except OSError:
        pytest.skip("no tokenizer files here")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "same words " * 20000, 1), (3, "same words " * 20000, 1), (None, "x", 1)], "doc_id long, text string, token_ids int")
    got = pieces.encode(df, data).collect()
    assert [r["n_tokens"] for r in got][:2] == [0, 0] and all(r["round_trip"] for r in got) and got[2]["token_ids"] == got[3]["token_ids"]
    assert pieces.encode(df.limit(0), data).count() == 0


def test_classifier_learns(spark, data):
    rows = duckdb.sql("select d.doc_id, text, quality from '/root/testdata/sf0.01/documents.parquet' d join '/root/testdata/sf0.01/labels.parquet' l using (doc_id)").df()
    docs = spark.createDataFrame(rows[["doc_id", "text"]])
    labels = spark.createDataFrame(rows[["doc_id", "quality"]])
    net = bytecnn.train(docs, labels)
    got = bytecnn.score(docs, net).toPandas().merge(rows, on="doc_id")
    out = got[got["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > max(0.93, out["quality"].mean())


def small_net(seed=3):
    import numpy as np

    net, r = bytecnn.Net(seed), np.random.default_rng(seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["v"], net.p["b"], net.p["c"] = r.normal(0, 1, 2 * bytecnn.FILTERS), r.normal(0, 0.1, bytecnn.FILTERS), np.array([0.2])
    return net, r


def test_classifier_responses_are_a_convolution():
    import numpy as np

    net, r = small_net()
    chunks = r.integers(0, 256, (300, bytecnn.CHUNK)).astype(np.uint8)
    kernel = net.p["w"].reshape(bytecnn.WIDTH, bytecnn.EMBED, bytecnn.FILTERS)
    want = np.full((300, bytecnn.FILTERS), -np.inf)
    for at in range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE):
        want = np.maximum(want, sum(net.p["e"][chunks[:, at + j]] @ kernel[j] for j in range(bytecnn.WIDTH)))
    assert np.allclose(net.responses(chunks), np.maximum(want + net.p["b"], 0), atol=1e-4)
    value, top = net.strongest(chunks)
    assert np.allclose(value, want, atol=1e-4) and (top < bytecnn.POSITIONS).all()


def test_classifier_gradients_are_finite_differences():
    import numpy as np

    net, r = small_net()
    docs = [bytecnn.chunk_bytes(bytes(r.integers(97, 123, n).astype(np.uint8))) for n in (0, 40, 700, 5000)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    g, loss = net.gradients(docs, y)
    scores = np.array([net.score(net.responses(d), np.zeros(1, int))[0] for d in docs])
    assert abs(loss + np.mean(np.log(np.where(y > 0.5, scores, 1 - scores)))) < 1e-4
    for k in net.p:
        flat, at = net.p[k].reshape(-1), np.argsort(-np.abs(g[k].reshape(-1)))[:12]
        for i in at:
            old, step = flat[i], 1e-6
            ends = []
            for d in (step, -step):
                flat[i] = old + d
                ends.append(net.gradients(docs, y)[1])
            flat[i] = old
            want = (ends[0] - ends[1]) / (2 * step)
            assert abs(want - g[k].reshape(-1)[i]) < 0.02 * max(abs(want), 0.02), (k, i, want)


def test_training_reads_whole_texts_of_bounded_rows(spark):
    import zlib

    long = "early words " * 30000 + "the end"
    docs = spark.createDataFrame([(i, long if i == 2 else f"text {i}", 0) for i in range(60) for _ in range(2)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    every = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = bytecnn.training_rows(docs, labels)
    assert [i for i, _, _ in got] == every and [q for _, q, _ in got] == [i % 2 for i in every]
    assert {i: zlib.decompress(t).decode() for i, _, t in got} == {i: long if i == 2 else f"text {i}" for i in every}
    assert len(bytecnn.training_rows(docs, labels, 7)) == 7


def test_classifier_covers_whole_texts_and_odd_input(spark):
    for n in (0, 1, 127, 128, 129, 240, 241, 5000):
        data = bytes(i % 250 + 1 for i in range(n))
        c = bytecnn.chunk_bytes(data)
        step = bytecnn.CHUNK - bytecnn.OVERLAP
        assert b"".join(x[:step].tobytes() for x in c[:-1]) + c[-1].tobytes().rstrip(b"\0") == data
    df = spark.createDataFrame([(1, None), (2, ""), (4, "x" * 300000), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in bytecnn.score(df, bytecnn.train(df, labels)).collect()} == {0.5}
    net = bytecnn.Net()
    net.trained = True
    got = bytecnn.score(df, net).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    assert bytecnn.score(df.limit(0), net).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(1500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        for cells in (pages.CELLS, 0, 12):
            sub = [x for x, k in zip(a, pages.common_lines(a, b, cells), strict=True) if k]
            rest = iter(b)
            assert len(sub) == t[-1][-1] and all(x in rest for x in sub)


def test_long_line_lists_are_halved():
    r = random.Random(3)
    a, b = ([r.randint(0, 3000) for _ in range(6000)] for _ in range(2))
    assert sum(pages.common_lines(a, b)) == sum(pages.common_lines(a, b, 1 << 20)) == pages._lengths(a, b)[-1]


def test_odd_markup_takes_time_in_proportion():
    import time

    for odd in ("<a ", "<a '", '<a "', "<a \"'>", "<![CDATA[", "<noscript>", "<title>", "<!--", "<!", "<p", "</p", "<a x='\">"):
        page = "<article>" + odd * (1_000_000 // len(odd)) + "</article>"
        began = time.time()
        pages.lines_of(page)
        assert time.time() - began < 20, odd
        assert pages.lines_of(f"<p>ok</p>{odd}")[0] == (pages.OPEN, "ok")
    assert pages.lines_of("<p title=don't>one</p><p>two</p>") == [(pages.OPEN, "one"), (pages.OPEN, "two")]


def test_extract_against_a_plain_rule(spark, data):
    """Deleting what the nearest page shares, then the guard, over real pages and their articles as plain strings."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    parsed = {(i, u): pages.lines_of(h) for i, u, h in rows}
    seen = sorted((*pages.address(u), pages._key(i, u, h), [t for _, t in parsed[i, u]], i, u) for i, u, h in rows)
    want = {}
    for k, (host, path, _, lines, i, u) in enumerate(seen):
        best = None
        for side in (seen[:k][::-1], seen[k + 1 :]):
            other = next((x for x in side if x[0] == host and x[3] != lines), None)
            near = other and len(pages.os.path.commonprefix([path, other[1]]))
            if other and (best is None or near > best[0]):
                best = (near, other[3])
        shared = pages.common_lines(lines, best[1]) if best else [False] * len(lines)
        places = [p for p, _ in parsed[i, u]]
        article = pages.KEEP in places
        stays = [p == pages.KEEP or not s and p == pages.OPEN and not article for p, s in zip(places, shared, strict=True)]
        deleted = sum(s and p != pages.KEEP for p, s in zip(places, shared, strict=True))
        want[i, u] = (" ".join(t for t, s in zip(lines, stays, strict=True) if s), deleted, sum(s and p == pages.KEEP for p, s in zip(places, shared, strict=True)), len(lines) - sum(stays) - deleted)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_shared"], r["n_restored"], r["n_guarded"]) for r in pages.extract(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    assert got == want
    assert any(n for _, n, _, _ in got.values()) and any(n for _, _, n, _ in got.values())


PAGES = "page_id long, url string, html string, text string"


def test_pages_with_and_without_articles(spark):
    shell = "<div>Site name</div>{}<div>All rights kept</div>"
    rows = [
        (1, "http://h/a/1", "<nav>x</nav><div class='ad'>y</div><article><h1>T &amp; t</h1><p><b>one<br>two  \n three</article><footer>z</footer>", None),
        (2, "http://h/b/1", shell.format("<p>Body one</p>"), None), (3, "http://h/b/2", shell.format("<p>Body two</p>"), None),
        (4, "http://alone/", shell.format("<p>Body</p>"), None), (5, None, None, None), (6, "http://h/c", "", None), (3, "http://h/b/2", shell.format("<p>Body two</p>"), None),
        (7, "http://h/d", "<article><p>ok</p><section id='comments'><p>no</p></section><form>no</form></article><aside>no", None),
    ]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect())
    texts = [t for _, t, _ in got]
    assert texts == ["T & t one two three", "Body one", "Body two", "Body two", "Site name Body All rights kept", "", "", "ok"]
    assert all(n == len(t) for _, t, n in got)
    assert pages.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_pages_look_past_runs_of_mirrors(spark):
    shell = "<div>Site name</div>{}<div>All rights kept</div>"
    mirrors = [(i, f"http://h/m/{i:03}", shell.format("<p>Mirrored</p>"), None) for i in range(40)]
    others = [(100, "http://h/z/1", shell.format("<p>Other</p>"), None), (101, "http://g/1", shell.format("<p>Alone</p>"), None), (102, "http://g/2", shell.format("<p>Alone</p>"), None)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(mirrors + others, PAGES)).collect()}
    assert {got[i] for i in range(40)} == {"Mirrored"} and got[100] == "Other"
    assert got[101] == got[102] == "Site name Alone All rights kept"


def test_texts_of_pages_are_not_stored(spark):
    """Tables in the shared folder hold line hashes only, and rows alike share one decision."""
    r = random.Random(8)
    rows = [(i, f"http://h/{i:03}", f"<p>Site name</p><p>{r.randbytes(4000).hex()}</p>", None) for i in range(100)]
    where = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    stored = lambda: sum(f.stat().st_size for f in where.rglob("*.parquet"))
    before = stored()
    got = pages.extract(spark.createDataFrame(rows + rows[:30], PAGES)).collect()
    assert 0 < stored() - before < 200_000
    assert len(got) == 130 and all(x["n_chars"] == 8000 and x["n_shared"] == 1 for x in got)


def test_neighbours_against_a_plain_search(spark):
    r = random.Random(6)
    for _ in range(3):
        rows = [(i, f"http://h{r.randint(0, 2)}/{r.choice('ab')}/{i:03}", "".join(f"<p>{r.choice('xy') * r.choice((1, 1, 1, 2))}</p>" for _ in range(r.choice((1, 1, 2)))), None) for i in range(120)]
        seen = sorted((*pages.address(u), pages._key(i, u, h), [pages._line_hash(t) for _, t in pages.lines_of(h)]) for i, u, h, _ in rows)
        want = {}
        for k, (host, path, key, lines) in enumerate(seen):
            best = None
            for side in (seen[:k][::-1], seen[k + 1 :]):
                other = next((x for x in side if x[0] == host and x[3] != lines), None)
                near = other and len(pages.os.path.commonprefix([path, other[1]]))
                if other and (best is None or near > best[0]):
                    best = (near, other[3])
            want[key] = pages.common_lines(lines, best[1]) if best else [False] * len(lines)
        got = {bytes(x["key"]): x["shared"] for x in pages.shared_lines(pages.parsed_pages(spark.createDataFrame(rows, PAGES))).collect()}
        assert got == want
