"""MinHash near-dedup with HyperMinHash registers, and exact confirmation.

Sets. A text's words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) give its distinct 5-word shingles, or the whole sequence as one where there
are fewer words; shingles are 64-bit hashes. Texts with the same word sequence form a class, which goes on as one.

Registers. REGISTERS hash functions each keep their minimum compressed to 16 bits: the number of leading zeros and the next ten
mantissa bits. BANDS bands of four registers are exact 64-bit keys; a pair at similarity 0.75 meets in at least one with probability
1 - 1e-8. The estimate of similarity is the share of equal registers, corrected for the chance that unlike minima compress to the same
register given both set sizes; pairs estimated under LEAST (nearly five standard deviations below the threshold) are not confirmed.

Candidates, without emitting all pairs of a bucket: a bucket's members point to its least class, and each class is compared
to the one it points to in most bands. Then, in buckets that still hold several components, the members outside the bucket's
largest component are compared to all its members, in blocks, by the registers alone, each pair in the first band where it meets. Pairs
that pass are confirmed block by block, a text travelling once to a block where it has such a pair; of links between the same components one is enough. Every
confirmation takes the full shingle sets of both whole texts. Components come from distributed star steps.

Nulls and odd input: null or wordless texts have an empty set and link to nothing; a null doc_id is not linked and is kept; rows
that share a doc_id are one node of the graph, linked by whatever any of their texts links; equal rows get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, free_name, materialize
from .components import components

SHINGLE = 5
NUM, DEN = 75, 100
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
LEAST = 0.6
#: Members and outsiders compared at once in a bucket, and pairs compared at once in a task.
MEMBERS, OUTSIDERS, PAIRS = 4096, 1024, 1 << 17
#: Registers compared at first in a bucket, and how many must be equal: at 0.75 fewer are with probability 1e-7.
FEW, FEW_LEAST = 48, 20
#: Words whose hashes a task remembers, and shingles hashed at once.
WORDS, AT_ONCE = 500_000, 1 << 15
_U = np.uint64
_r = np.random.default_rng(20240601)
MULTIPLY = [int(x) | 1 for x in _r.integers(0, 2**63, REGISTERS)]
FLIP = [int(x) for x in _r.integers(0, 2**63, REGISTERS)]
PLACE = [int(x) | 1 for x in _r.integers(0, 2**63, SHINGLE + 1)]


class Shingles:
    """Distinct shingle hashes of texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> list[bytes]:
        return text.encode().lower().split()  # bytes: only A-Z change, and the separators are the six

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, _U)
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), _U, len(words))
        k = min(SHINGLE, len(h))
        n = len(h) - k + 1
        x = np.full(n, k * 0x9E3779B97F4A7C15 & (2**64 - 1), _U)
        for j in range(k):
            x += (h[j : j + n] ^ (h[j : j + n] >> _U(29))) * _U(PLACE[j])
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
        return np.unique(x)


def compress(v: np.ndarray) -> np.ndarray:
    """64-bit minima to 16-bit registers: leading zeros (6 bits) and the bits after the leading one (MANTISSA)."""
    hi = v >> _U(32)
    _, e1 = np.frexp(hi.astype(np.float64))
    _, e2 = np.frexp((v & _U(0xFFFFFFFF)).astype(np.float64))
    bits = np.where(hi > 0, e1 + 32, e2)  # position of the leading one, from 1; 0 for zero
    lz = np.minimum(63, 64 - bits).astype(_U)
    rest = np.where(lz >= 63, _U(0), v << np.minimum(lz + _U(1), _U(63)))
    return ((lz << _U(MANTISSA)) | (rest >> _U(64 - MANTISSA))).astype(np.uint16)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Non-empty sets to (n, REGISTERS) registers."""
    out = np.empty((len(sets), REGISTERS), np.uint16)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= AT_ONCE):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        low, x = np.empty((REGISTERS, end - at), _U), np.empty_like(h)
        for k in range(REGISTERS):
            np.bitwise_xor(h, _U(FLIP[k]), out=x)
            np.multiply(x, _U(MULTIPLY[k]), out=x)
            np.minimum.reduceat(x, starts, out=low[k])
        out[at:end] = compress(low).T
        at = end
    return out


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that unlike minima of sets of n and m elements compress to one register."""
    edge = 0.5 ** np.arange(65)
    edge[64] = 0.0

    def held(x):
        below = (1 - edge[None, :]) ** np.asarray(x, float)[:, None]  # P(min >= edge)
        return below[:, 1:] - below[:, :-1]

    return (held(n) * held(m)).sum(1) / 2**MANTISSA


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    c = collision(n, m)
    return (equal / REGISTERS - c) / (1 - c)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sh = Shingles()
    for b in batches:
        words = [sh.words(t.as_py() or "") for t in b.column(1)]
        sets = [sh.of(w) for w in words]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        if full:
            packed = registers([sets[i] for i in full]).view(np.int64)
            for i, row in zip(full, packed, strict=True):
                bands[i] = row
        digests = list(map(_digest, words))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"]
        )


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, BANDS).view(np.uint16).reshape(-1, REGISTERS)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ra, rb) -> (a, b, est) for the pairs worth confirming."""
    for b in batches:
        if not b.num_rows:
            continue
        na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
        equal = (_matrix(b.column("ra")) == _matrix(b.column("rb"))).sum(1)
        good = (equal >= LEAST * REGISTERS) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))  # correction only lowers
        est = np.zeros(len(equal))
        est[good] = estimate(equal[good], na[good], nb[good])
        good &= est >= LEAST
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good)), pa.array(est[good])], ["a", "b", "est"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ta, tb) with deflated whole texts -> the linked pairs."""
    sh, unpack, held = Shingles(), zstandard.ZstdDecompressor(), (None, None)
    for b in batches:
        out = []
        for x, y, tx, ty in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
            tx, ty = tx.as_py(), ty.as_py()
            if held[0] != tx:
                held = (tx, sh.of(unpack.decompress(tx).split()))
            s, t = held[1], sh.of(unpack.decompress(ty).split())
            both = len(s) + len(t) - len(np.union1d(s, t))
            if DEN * both >= NUM * (len(s) + len(t) - both):
                out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _digest(words: list[bytes]) -> bytes | None:
    """Of a class: the same for texts of the same words."""
    return hashlib.md5(b" ".join(words)).digest() if words else None


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        words = [(t.as_py() or "").encode().lower() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([_digest(w.split()) for w in words], pa.binary()), pa.array([pack.compress(w) for w in words], pa.binary())], ["least", "digest", "packed"])


def _near_pairs(g, band, ids, comp, n, out_side, regs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of whole blocks, in order of g: places of outsiders and members of other components that a few registers and then the estimate call
    near, in the first band where they meet."""
    head = np.concatenate([[True], g[1:] != g[:-1]])
    of = np.cumsum(head) - 1
    o, m = np.nonzero(out_side)[0], np.nonzero(~out_side)[0]
    n_m = np.bincount(of[m], minlength=int(head.sum()))
    first_m = np.cumsum(n_m) - n_m
    each = n_m[of[o]]  # members that an outsider meets
    ends = np.cumsum(each)
    at = 0
    while at < len(o):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        k = each[at:stop]
        x = np.repeat(o[at:stop], k)
        y = m[np.repeat(first_m[of[o[at:stop]]], k) + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)]
        at = stop
        good = (comp[x] != comp[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y]))
        x, y = x[good], y[good]
        few = np.count_nonzero(regs[x, :FEW] == regs[y, :FEW], axis=1) >= FEW_LEAST
        x, y = x[few], y[few]
        same = regs[x] == regs[y]
        equal = np.count_nonzero(same, axis=1)
        good = (equal >= LEAST * REGISTERS) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[x])  # the correction only lowers the estimate
        x, y, equal = x[good], y[good], equal[good]
        if len(x):
            good = estimate(equal, n[x], n[y]) >= LEAST
            yield x[good], y[good]


BLOCK = "g long, band int, id long, component long, n long, outsider boolean, bands array<long>"


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of blocks, in order of g, those that are in a near pair. A block is held at a time."""
    names = ("g", "band", "id", "component", "n", "outsider")

    def kept(part: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [part[c].to_numpy() for c in names]
        regs = _matrix(part["bands"].combine_chunks()) if part.num_rows else np.empty((0, REGISTERS), np.uint16)
        hit = np.zeros(part.num_rows, bool)
        for x, y in _near_pairs(*cols, regs):
            hit[x] = hit[y] = True
        if hit.any():
            yield from part.filter(pa.array(hit)).to_batches()

    rest = None
    for b in batches:
        part = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        if part.num_rows:
            g = part["g"].to_numpy()
            edge = int(np.searchsorted(g, g[-1]))
            yield from kept(part.slice(0, edge))
            rest = part.slice(edge)
    if rest is not None:
        yield from kept(rest)


def _confirm_block(pdf):
    """Of a block, enough links to join what its near pairs join, on full sets."""
    import pandas as pd

    regs = np.array(pdf["bands"].tolist(), np.int64).view(np.uint16).reshape(-1, REGISTERS)
    ids, comp, texts = pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["packed"].tolist()
    sh, unpack, sets, up, links = Shingles(), zstandard.ZstdDecompressor(), {}, {}, []

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x] = up[up[x]]
        return x

    def shingles(i):
        if i not in sets:
            sets[i] = sh.of(unpack.decompress(texts[i]).split())
        return sets[i]

    for x, y in _near_pairs(pdf["g"].to_numpy(), pdf["band"].to_numpy(), ids, comp, pdf["n"].to_numpy(), pdf["outsider"].to_numpy(), regs):
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            cu, cv = find(comp[u]), find(comp[v])
            if cu != cv:
                s, t = shingles(u), shingles(v)
                both = len(s) + len(t) - len(np.union1d(s, t))
                if DEN * both >= NUM * (len(s) + len(t) - both):
                    links.append((min(ids[u], ids[v]), max(ids[u], ids[v])))
                    up[cu] = cv
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept; one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sig = materialize(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    classes = sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))
    reps = classes.select("id", "n", "bands")
    keys = reps.select("id", F.posexplode("bands").alias("band", "value"))

    # each bucket's least class, for buckets of two or more; of its buckets' heads each class meets the one it shares most bands with
    heads = materialize(keys.groupBy("band", "value").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last"))
    stars = keys.join(heads, ["band", "value"]).where("id > head").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    first = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    sides = first.join(reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bands").alias("rb")), "b").join(reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bands").alias("ra")), "a")
    first = materialize(sides.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated, "a long, b long, est double"))

    def texts_of(ids: DataFrame) -> DataFrame:
        """id, packed: one text of each class, from a row of its least doc_id."""
        ids = ids.distinct().join(classes.select("id", "least", "digest"), "id")
        found = docs.where("doc_id is not null").mapInArrow(_packed_texts, "least long, digest binary, packed binary").join(ids, ["digest", "least"])
        return materialize(found.groupBy("id").agg(F.min("packed").alias("packed")))

    # classes of one doc_id are one node
    own = sig.where("digest is not null and doc_id is not null").select("doc_id", "digest").join(classes.select("digest", "id"), "digest").select("doc_id", "id")
    shared = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a")
    shared = materialize(own.join(shared, "doc_id").where("id > a").select("a", F.col("id").alias("b")))

    texts = texts_of(first.select(F.explode(F.array("a", "b")).alias("id")))
    both = first.select("a", "b").join(texts.withColumnsRenamed({"id": "b", "packed": "tb"}), "b").join(texts.withColumnsRenamed({"id": "a", "packed": "ta"}), "a")
    links = materialize(both.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").unionByName(shared))
    drop(first, texts)
    comp = materialize(components(links))

    # buckets that still hold several components: outsiders of the largest one against all members
    at = reps.select("id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    member = materialize(keys.join(heads.select("band", "value"), ["band", "value"], "left_semi").join(at, "id"))
    sizes = member.groupBy("band", "value", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band", "value").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"), F.max("c").alias("most")).where("size > most")
    mixed = materialize(mixed)
    if not mixed.isEmpty():
        chunks, blocks = F.ceil(F.col("size") / MEMBERS).cast("int"), F.ceil((F.col("size") - F.col("most")) / OUTSIDERS).cast("int")
        spread = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
        split = member.join(mixed, ["band", "value"]).withColumns({"chunks": chunks, "blocks": blocks})
        cols = ["id", "component", "band"]
        block = F.xxhash64("band", "value", "chunk", "block").alias("g")
        inner = split.select(*cols, "value", spread(F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("outsider"))
        outer = split.where("component <> main").select(*cols, "value", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), spread(F.col("blocks")).alias("block"), F.lit(True).alias("outsider"))
        rows = inner.unionByName(outer).select(block, *cols, "outsider").join(reps, "id")
        near = rows.select("g", "band", "id", "component", "n", "outsider", "bands").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_near_rows, BLOCK)
        near = materialize(near)
        texts = texts_of(near.select("id"))
        found = near.join(texts, "id").groupBy("g").applyInPandas(_confirm_block, "a long, b long")
        comp = components(links.unionByName(materialize(found)))

    least = materialize(classes.select("id", "digest", "least").join(comp, "id", "left").select("digest", "least", F.coalesce("component", "id").alias("component")))
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = materialize(least.join(ids, "component").select("digest", "component_id"))
    drop(least, member, mixed, heads)
    out = sig.select("doc_id", "n_shingles", "digest").join(ends, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns; rows of a null doc_id stay. Of rows that share a doc_id all stay or go."""
    mine = free_name(docs, "id")
    kept = near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(kept, docs["doc_id"] == kept[mine], "left_semi").unionByName(docs.where("doc_id is null"))


#: The same rule by all pairs of texts that share a shingle.
ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as t from documents),
c as materialized (select t, row_number() over (order by t) as k, string_split(t, ' ') as w from (select distinct t from d where t <> '')),
s as materialized (select distinct k, unnest(case when len(w) < 5 then [t] else list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) end) as s from c),
n as materialized (select k, count(*) as n from s group by k),
p as (select a.k as x, b.k as y, count(*) as both_ from s a join s b on a.s = b.s and a.k < b.k group by a.k, b.k),
l as materialized (select x, y from p join n nx on p.x = nx.k join n ny on p.y = ny.k where 100 * both_ >= 75 * (nx.n + ny.n - both_)),
e as materialized (select doc_id as i, k from d join c on d.t = c.t where doc_id is not null),
g as materialized (select a.i as a, b.i as b from e a join e b on a.k = b.k and a.i <> b.i union select a.i, b.i from l join e a on a.k = x join e b on b.k = y union select b.i, a.i from l join e a on a.k = x join e b on b.k = y),
reach as (select distinct i as a, i as b from e union select reach.a, g.b from reach join g on reach.b = g.a),
comp as (select a as i, min(b) as component from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(component, d.doc_id) as component_id, d.doc_id is null or coalesce(component, d.doc_id) = d.doc_id as kept
from d left join c on d.t = c.t left join n on c.k = n.k left join comp on d.doc_id = comp.i"""
