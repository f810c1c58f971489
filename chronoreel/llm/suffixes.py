"""Suffix-array dedup: long repeats found by merging shard Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string over it also starts earlier (smaller doc_id, or earlier in the document). Every LENGTH-byte window
belongs to the least GRAM-byte hash inside it (the leftmost of equals), its anchor; windows in a row with one anchor are one run.
Equal windows have equal anchors, so runs are dealt by anchor and each task sees all that may repeat in its runs.

1. Rows are numbered in order of doc_id (nulls last; rows that share a doc_id in order of a hash of their text), and from here on a document is
   its number. Each document's bytes give its runs. Runs that are the same string in one task are merged there (only the earliest travels).
2. By anchor: runs whose anchor came once have no repeat. Equal runs are merged; where all runs of an anchor are one string there is
   nothing left to compare. The earliest of each distinct string of the other anchors fetches its bytes, in two parts: the windows with
   HALF bytes of context before the anchor, and the others, which have as many after it. A part's key is the hash of anchor and context.
3. By key: strings that came alone have no repeat, and equal strings are merged. What is left is dealt into shards. Each shard's suffixes, read in symbols of SYMBOL bytes, are sorted
   once and give the shard's transform. The shards' transforms are then merged by refining their interleave: one stable distribution of
   the current order by the preceding symbol sorts all suffixes by one symbol more, without looking at the suffixes again. The round in
   which two neighbours part is their common prefix; after LENGTH / SYMBOL rounds the unparted stretches are the intervals of repeated
   LENGTH-byte strings, of which all but the earliest start are marked.
4. Marks are united per document, and the rest of the bytes hashed.

Anchors with more than HOT distinct strings are cut into single windows, runs of one, that are dealt by their own hash and merged like equal
runs, without their text: so a window costs a row and not LENGTH bytes. Their runs are sent on as soon as HOT is passed, and windows are merged
in sorted order, so a task holds a bounded number of runs whatever share of them one anchor has. Strings are told apart by two 64-bit hashes,
by their bytes or by the transform over 64-bit symbol hashes.

Nulls and odd input: a null text is empty; a null doc_id counts as larger than all others; rows that share a doc_id (or have none) are documents of
their own, a repeat between them is removed from the later in number; empty and short texts lose nothing; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize

LENGTH, GRAM, SYMBOL, SHARDS, HOT = 100, 32, 25, 4, 2000
#: Bits of a position inside a segment; a segment's windows; runs merged and bytes compared at once.
BITS, SEGMENT, RUNS_AT_ONCE, BYTES_AT_ONCE = 24, 1 << 23, 1 << 20, 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(99).integers(1, 2**63, 256).astype(U)
RUN, MARK, WINDOW = 0, 1, 2
#: Bytes of context beside the anchor that every window holds on one of its sides.
HALF = (LENGTH - GRAM) // 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def gram_hashes(d: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-byte string, by joining halves."""
    if len(d) < k:
        return np.empty(0, U)
    h, p, m, left, out, width = _VALUES[d], _BASE, 1, k, None, 0
    while True:
        if left & 1:
            n = len(d) - (width + m) + 1
            out = h if out is None else out[:n] * U(p) + h[width : width + n]
            width += m
        left >>= 1
        if not left:
            return _mix(out)
        h = h[:-m] * U(p) + h[m:]
        p = p * p & (2**64 - 1)
        m *= 2


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def at_least(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                steps = np.full(n + 1, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))


def runs_of(d: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and string hash of every run of a document."""
    parts = []
    w = LENGTH - GRAM + 1
    for base in range(0, max(0, len(d) - LENGTH + 1), SEGMENT):
        seg = d[base : base + SEGMENT + LENGTH - 1]
        g = gram_hashes(seg, GRAM)
        low = (g & U(~((1 << BITS) - 1) & (2**64 - 1))) | np.arange(len(g), dtype=U)
        m = 1
        while 2 * m <= w:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if m < w:
            low = np.minimum(low[: len(low) - (w - m)], low[w - m :])
        anchor = (low & U((1 << BITS) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(anchor[1:] != anchor[:-1])[0] + 1])
        n = np.diff(np.append(first, len(anchor)))
        powers.at_least(len(seg) + 1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(_VALUES[seg] * powers.up[: len(seg)], dtype=U)])
        c = _mix((total[first + n + LENGTH - 1] - total[first]) * powers.down[first])
        parts.append((g[anchor[first]], first + base, n, c))
    if not parts:
        return (np.empty(0, U), *(np.empty(0, np.int64),) * 2, np.empty(0, U))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _later_equals(keys: tuple, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys then (doc, at); whether each row in that order equals an earlier one in keys and comes after the first of them."""
    order = np.lexsort((at, doc, *keys[::-1]))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    head = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
    first = np.nonzero(head)[0][np.cumsum(head) - 1] if len(order) else np.empty(0, np.int64)
    tie = (doc[order] == doc[order[first]]) & (at[order] == at[order[first]])
    return order, ~head & ~tie


def _batch(kind, key, doc, at, n, c) -> pa.RecordBatch:
    cols = [np.broadcast_to(np.asarray(x), (len(doc),)) for x in (kind, key, doc, at, n, c)]
    types = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x if x.dtype != U else x.view(np.int64)).astype(t, copy=False)) for x, t in zip(cols, types, strict=True)], ["kind", "key", "doc", "at", "n", "c"])


RUNS = "kind int, key long, doc long, at long, n long, c long"


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, held, size = Powers(), [], 0

    def flush():
        h, at, n, c, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order, later = _later_equals((h, c, n), doc, at)
        h, at, n, c, doc = (x[order] for x in (h, at, n, c, doc))
        for mark in (False, True):
            pick = later == mark
            # marks stay spread as they are: they need no meeting by anchor
            key = _mix(h[pick] + at[pick].astype(U) * U(_BASE) + doc[pick].astype(U)) if mark else h[pick]
            yield _batch(MARK if mark else RUN, key, doc[pick], at[pick], n[pick], c[pick])

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        for i, t in zip(b.column("doc").to_pylist(), b.column("packed"), strict=True):
            d = np.frombuffer(unpack.decompress(t.as_py()), np.uint8)
            if len(d) >= LENGTH:
                found = runs_of(d, powers)
                held.append((*found, np.full(len(found[0]), i, np.int64)))
                size += len(found[0])
                if size >= RUNS_AT_ONCE:
                    yield from flush()
                    size = 0
    if held:
        yield from flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By anchor, in order of it: marks for later equal runs; of anchors with several strings the earliest run of each, with c telling
    whether the anchor is hot. Of the anchor that is being read, up to HOT strings (and a batch) are held."""
    rest, hot = None, None

    def merged(key, doc, at, n, c):
        """Marks for later equal runs, and the others in order."""
        order, later = _later_equals((key, c, n), doc, at)
        cols = [x[order] for x in (key, doc, at, n, c)]
        if later.any():
            yield _batch(MARK, *(x[later] for x in cols))
        key, doc, at, n, c = cols
        head = np.concatenate([[True], (key[1:] != key[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])]) if len(key) else np.empty(0, bool)
        return [x[head] for x in cols]

    def settle(*cols):
        key, doc, at, n, c = yield from merged(*cols)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        wide = (count[which] > HOT) | (key == hot if hot is not None else False)
        several = (count[which] > 1) | wide
        if several.any():
            yield _batch(RUN, key[several], doc[several], at[several], n[several], wide[several].astype(np.int64))

    for b in batches:
        cols = [x.to_numpy() for x in b.columns]
        mark = cols[0] == MARK
        if mark.any():
            yield _batch(*(x[mark] for x in cols))
        cols = [x[~mark] for x in cols[1:]]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if len(cols[0]):
            # all but the last anchor are complete
            last = cols[0][-1]
            done = cols[0] != last
            yield from settle(*(x[done] for x in cols))
            rest = [x[~done] for x in cols]
            if hot != last:
                hot = None
            if len(rest[0]) > HOT:
                rest = yield from merged(*rest)
                if len(rest[0]) > HOT or hot is not None:  # what is left to come of this anchor goes the same way
                    hot = last
                    yield _batch(RUN, *rest[:4], 1)
                    rest = [x[:0] for x in rest]
    if rest is not None and len(rest[0]):
        yield from settle(*rest)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        texts = [(t.as_py() or "").encode() for t in b.column(1)]
        ties = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ties, pa.int64()), pa.array(list(map(pack.compress, texts)), pa.binary())], ["doc_id", "tie", "packed"])


def numbered(docs: DataFrame, parts: int) -> DataFrame:
    """documents -> doc_id, packed (deflated bytes) and doc, a number of its own for each row in order of doc_id."""
    packed = materialize(docs.mapInArrow(_packed_texts, "doc_id long, tie long, packed binary"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    out = materialize(packed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "packed", F.monotonically_increasing_id().alias("doc")))
    drop(packed)
    return out


STRINGS = "kind int, key long, doc long, at long, n long, data binary"


def _rows(kind: int, key, doc, at, n, data=None) -> pa.RecordBatch:
    """A batch of STRINGS."""
    cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, doc, at, n)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *cols, pa.nulls(len(doc), pa.binary()) if data is None else pa.array(data, pa.binary())], ["kind", "key", "doc", "at", "n", "data"])


def _spans(d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and number of the windows in a row among those that start at (d, a)."""
    order = np.lexsort((a, d))
    d, a = d[order], a[order]
    head = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)]) if len(d) else np.empty(0, bool)
    first = np.nonzero(head)[0]
    return d[first], a[first], np.diff(np.append(first, len(d)))


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, ..., count - 1 for each count: whose it is, and the number."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _windows(key, doc, at, n, start, flat) -> Iterator[pa.RecordBatch]:
    """Runs of hot anchors as windows, by hash; the text is not needed, as equal windows are merged like equal runs. Marks for those met here."""
    of, p = _each(n)
    h = gram_hashes(flat, LENGTH)[start[of] + p]
    key, doc, at = key[of], doc[of], at[of] + p
    order, later = _later_equals((h, key), doc, at)
    if later.any():
        d, a, m = _spans(doc[order][later], at[order][later])
        yield _rows(MARK, _mix(a.astype(U) * U(_BASE) + d.astype(U)), d, a, m)
    pick = order[~later]
    yield _rows(WINDOW, h[pick], doc[pick], at[pick], key[pick])


def _halves(key, doc, at, n, start, flat) -> Iterator[pa.RecordBatch]:
    """Runs cut in two where the anchor passes the middle of the window. A window of the first part holds the HALF bytes before the anchor, one
    of the second at least as many after it; the anchor with these is the key, which fewer strings share by chance."""
    # the anchor is the first place with its hash in the run's first window
    of, p = _each(np.full(len(n), LENGTH - GRAM + 1))
    hit = np.nonzero(gram_hashes(flat, GRAM)[start[of] + p] == key.view(U)[of])[0]
    _, first = np.unique(of[hit], return_index=True)
    anchor = p[hit[first]]
    long = gram_hashes(flat, GRAM + HALF)
    text = flat.tobytes()
    left = np.clip(anchor - HALF + 1, 0, n)
    for side, lo, hi, gram in ((0, np.zeros(len(n), np.int64), left, anchor - HALF), (1, left, n, anchor)):
        some = np.nonzero(lo < hi)[0]
        begin, end = (start + lo)[some], (start + hi + LENGTH - 1)[some]
        yield _rows(RUN, _mix(long[(start + gram)[some]] + U(side)), doc[some], (at + lo)[some], (hi - lo)[some], [text[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, packed, wanted: list of key, at, n, hot) -> strings to compare, and hot anchors' windows with marks for equal ones met here."""
    unpack = zstandard.ZstdDecompressor()

    def cut_up(cols, texts):
        key, doc, at, n, hot = cols
        for mark, way in ((0, _halves), (1, _windows)):
            pick = np.nonzero(hot == mark)[0]
            if len(pick):
                size = n[pick] + LENGTH - 1
                flat = np.frombuffer(b"".join(texts[k] for k in pick.tolist()), np.uint8)
                yield from way(key[pick], doc[pick], at[pick], n[pick], np.cumsum(size) - size, flat)

    for b in batches:
        wanted = b.column("wanted")
        count = wanted.value_lengths().to_numpy()
        key, at, n, hot = (wanted.flatten().field(c).to_numpy() for c in ("key", "at", "n", "c"))
        cols = (key, np.repeat(b.column("doc").to_numpy(), count), at, n, hot)
        texts, size, done, end = [], 0, 0, 0
        for packed, k in zip(b.column("packed"), count.tolist(), strict=True):
            data, end = unpack.decompress(packed.as_py()), end + k
            for x, m in zip(at[end - k : end].tolist(), n[end - k : end].tolist(), strict=True):
                texts.append(data[x : x + m + LENGTH - 1])
                size += len(texts[-1])
                if size > BYTES_AT_ONCE:
                    to = done + len(texts)
                    yield from cut_up([c[done:to] for c in cols], texts)
                    texts, size, done = [], 0, to
        if texts:
            yield from cut_up([c[done:] for c in cols], texts)


class Shard:
    """Strings in symbols, all phases: suffix order, transform."""

    def __init__(self, sym: np.ndarray, pos: np.ndarray, prev: np.ndarray, nxt: np.ndarray):
        """sym: symbol of each suffix, unique low numbers for ends; prev, nxt: the suffix a symbol before and after (-1: none)."""
        _, rank = np.unique(sym, return_inverse=True)
        step = nxt.copy()
        while rank.max(initial=-1) < len(rank) - 1:
            key = rank * (len(rank) + 1) + np.where(step >= 0, rank[step] + 1, 0)
            _, rank = np.unique(key, return_inverse=True)
            step = np.where(step >= 0, step[step], -1)
        self.order = np.empty(len(rank), np.int64)
        self.order[rank] = np.arange(len(rank))
        before = prev[self.order]
        self.transform = np.where(before >= 0, sym[before], -1)
        self.place = pos[self.order]


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine the interleave of the shards' suffixes; the source shard of each place, and the first round at which it parts from the place before (rounds + 1: not yet)."""
    z = np.concatenate([np.full(len(s.order), k, np.int64) for k, s in enumerate(shards)])
    n_ends = [int((s.transform < 0).sum()) for s in shards]
    ends = np.concatenate([np.full(n, k, np.int64) for k, n in enumerate(n_ends)])
    lcp = np.full(len(z), rounds + 1, np.int64)
    lcp[:1] = 0
    at = np.empty(len(z), np.int64)
    for t in range(1, rounds + 1):
        b = np.empty(len(z), np.int64)
        for k, s in enumerate(shards):
            b[z == k] = s.transform
        real = np.nonzero(b >= 0)[0]
        real = real[np.argsort(b[real], kind="stable")]
        # neighbours part in this round if their symbols differ, or where what follows parted in an earlier one
        block = np.cumsum(lcp < t)
        at = b[real]
        parted = np.concatenate([[True], (at[1:] != at[:-1]) | (block[real][1:] != block[real][:-1])]) if len(real) else np.empty(0, bool)
        z = np.concatenate([ends, z[real]])
        lcp = np.concatenate([np.zeros(len(ends), np.int64), np.where(parted, t, rounds + 1)])
        if not (lcp > t).any():
            break
    return z, lcp


def repeated_windows(strings: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, symbol: int = SYMBOL, shards: int = SHARDS, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window (n of them from at in each string) that also starts earlier in another string or place."""
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    grams = gram_hashes(flat, symbol)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = size - symbol + 1
    of = np.repeat(np.arange(len(strings)), count)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    _, sym = np.unique(grams[start[of] + inside], return_inverse=True)
    made = []
    for k in range(shards):
        mine = np.nonzero(of % shards == k)[0]
        if not len(mine):
            continue
        m = len(mine)
        o, p = of[mine], inside[mine]
        back = np.full(len(of), -1, np.int64)
        back[mine] = np.arange(m)
        has_next = p + symbol < count[o]
        last = np.nonzero(~has_next)[0]  # suffixes whose next is an end
        nxt = np.full(m + len(last), -1, np.int64)
        nxt[:m][has_next] = back[mine[has_next] + symbol]
        nxt[last] = m + np.arange(len(last))
        prev = np.full(m + len(last), -1, np.int64)
        prev[:m][p >= symbol] = back[mine[p >= symbol] - symbol]
        prev[m:] = last
        letters = np.concatenate([sym[mine] + len(of), np.arange(len(last))])
        shard = Shard(letters, np.concatenate([mine, np.full(len(last), -1)]), prev, nxt)
        shard.transform = np.where(shard.transform >= len(of), shard.transform - len(of), -1)
        made.append(shard)
    z, lcp = merge(made, length // symbol)
    place = np.empty(len(z), np.int64)
    for k, s in enumerate(made):
        place[z == k] = s.place
    interval = np.cumsum(lcp <= length // symbol)
    good = place >= 0
    place, interval = place[good], interval[good]
    good = inside[place] < n[of[place]]
    place, interval = place[good], interval[good]
    d, a = doc[of[place]], at[of[place]] + inside[place]
    order, later = _later_equals((interval,), d, a)
    return d[order][later], a[order][later]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings and windows in order of key, n, doc, at -> marks. Of strings alike one is compared; a key of one string needs no comparison."""
    held, size, rest, last = [], 0, None, None

    def marks(d, a, n):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, a, n)], ["doc", "at", "n"])

    def settle(rows):
        doc, at, n = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        d, a, m = _spans(*repeated_windows([r[4] for r in rows], doc, at, n))
        if len(d):
            yield marks(d, a, m)

    def meet(cols, complete):
        """Keys in order, of which the last may go on: into held the earliest of each string where a key has several; marks for the others."""
        nonlocal held, size
        key = cols.column("key").to_numpy()
        begin = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        count = np.diff(np.append(begin, len(key)))
        several = count > 1
        several[-1] &= complete
        rows = list(zip(*(c.to_pylist() for c in cols.filter(pa.array(np.repeat(several, count))).columns), strict=True))
        later, at = [], 0
        for k in count[several].tolist():
            first = {}
            for r in rows[at : at + k]:
                if first.setdefault(r[4], r) is not r:
                    later.append(r[1:4])
            at += k
            if len(first) > 1:
                held += first.values()
                size += sum(map(len, first))
            if size > BYTES_AT_ONCE:
                yield from settle(held)
                held, size = [], 0
        if later:
            yield marks(*zip(*later, strict=True))
        return None if complete else cols.slice(int(begin[-1]))

    for b in batches:
        kinds = b.column("kind").to_numpy()
        if (kinds == MARK).any():
            yield b.filter(pa.array(kinds == MARK)).select(["doc", "at", "n"])
        if (kinds == WINDOW).any():
            key, doc, at, anchor = (b.column(c).to_numpy()[kinds == WINDOW] for c in ("key", "doc", "at", "n"))
            before = [np.append(x[:1] if last is None else y, x[:-1]) for x, y in zip((key, anchor), last or (0, 0), strict=True)]
            again = (key == before[0]) & (anchor == before[1])
            again[0] &= last is not None
            last = key[-1], anchor[-1]
            if again.any():
                yield marks(doc[again], at[again], np.ones(int(again.sum()), np.int64))
        strings = b.filter(pa.array(kinds == RUN)).select(["key", "doc", "at", "n", "data"])
        if len(strings):
            rest = pa.Table.from_batches([strings] if rest is None else [*rest.to_batches(), strings]).combine_chunks()
            rest = yield from meet(rest, False)
    if rest is not None:
        yield from meet(rest, True)
    if held:
        yield from settle(held)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(data: bytes, marks: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of data without the windows starting in each (at, n); bytes removed; maximal runs removed."""
    kept, spans, end, removed = [], 0, -1, 0
    pos = 0
    for at, n in sorted(marks):
        stop = min(len(data), at + n + LENGTH - 1)
        if stop <= end or at >= len(data):
            continue
        if at > end:
            spans += 1
            kept.append(data[pos:at])
            removed += stop - at
        else:
            removed += stop - end
        pos = end = stop
    kept.append(data[pos:])
    return b"".join(kept), removed, spans


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for i, packed, marks in zip(b.column("doc_id").to_pylist(), b.column("packed"), b.column("marks").to_pylist(), strict=True):
            data = unpack.decompress(packed.as_py())
            left, removed, spans = cut(data, [(m["at"], m["n"]) for m in marks or ()])
            rows.append((i, len(data), removed, spans, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*(pa.int64(),) * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per input row."""
    parts = max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts)
    runs = packed.select("doc", "packed").mapInArrow(_find_runs, RUNS).repartition(parts, "key").sortWithinPartitions("key")
    met = materialize(runs.mapInArrow(_meet, RUNS))
    wanted = met.where(F.col("kind") == RUN).groupBy("doc").agg(F.collect_list(F.struct("key", "at", "n", "c")).alias("wanted"))
    strings = packed.select("doc", "packed").join(wanted, "doc").select("doc", "packed", "wanted").mapInArrow(_strings, STRINGS)
    marks = materialize(strings.repartition(parts, "key").sortWithinPartitions("key", "n", "doc", "at").mapInArrow(_compare, "doc long, at long, n long"))
    marks = marks.unionByName(met.where(F.col("kind") == MARK).select("doc", "at", "n"))
    by_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    return packed.join(by_doc, "doc", "left").select("doc_id", "packed", "marks").mapInArrow(_results, OUT)


#: The same rule by every window of the texts.
ORACLE = r"""
with d as (select row_number() over (order by doc_id nulls last, coalesce(text, '')) as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as materialized (select r, o, substr(h, 2 * o + 1, 2 * 611) as h from (select r, h, unnest(range(0, len(h) // 2 - 99, 512)) as o from d)),
w as (select r, o, unnest(range(least(512, len(h) // 2 - 99))) as q, h from b),
k as (select r, o + q as p, md5(substr(h, 2 * q + 1, 200)) as s from w),
f as (select s, min((r, p)) as first from k group by s),
m as (select r, p from k join f using (s) where (r, p) > first),
e as (select r, p, max(p) over (partition by r order by p rows between unbounded preceding and 1 preceding) as before from m),
g as (select r, p, sum(case when before is null or p > before + 100 then 1 else 0 end) over (partition by r order by p) as span from e),
s as (select r, span, min(p) as a, max(p) + 100 as b from g group by r, span),
c as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as from_, lead(a) over (partition by r order by a) as nxt from s),
x as (select d.r, sum(b - a)::bigint as removed, count(*) as spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || case when nxt is null then substr(h, 2 * b + 1) else '' end, '' order by a) as kept from c join d on c.r = d.r group by d.r)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join x on d.r = x.r"""
