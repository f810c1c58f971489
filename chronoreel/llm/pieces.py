"""SentencePiece encoding and decoding with a given model file, sharing forward states between words with a common prefix.

The text is marked as the library does (a leading mark, spaces to marks) and cut into marked words; no piece may cross such a cut, which
is checked on the vocabulary. The distinct words of a slice of rows are sorted, which lists their trie depth first: the walk keeps
a stack of forward states, one per character of the current path, drops back to the prefix shared with the next word and goes on.

The forward state depends on the model. For a unigram model it is Viterbi's: the best sum of scores so far and the piece it ends in.
A pair-merge (BPE) model has no additive scores, and maximising their sum does not give its encoding; there the state is the
last piece of the prefix's own encoding. A piece t ending at position j with the state at its start in piece s is right exactly if
the merges of s + t give (s, t) back, and one candidate always is; pair answers are remembered. Either way ids equal the library's.
Which lengths a last piece may have is looked up by the last ENDING characters, so that absent pieces are hardly ever asked for.

Whole texts are encoded. Nulls and odd input: a null or empty text has no ids; characters that the vocabulary lacks become byte pieces
(or the unknown piece where a model has none); repeated rows give equal ids; other columns are ignored; an empty table gives an empty
result. Decoding returns the text, but for U+2581, which the format itself cannot tell from a space.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Where the public tokenizer files lie unless a path is given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bounds of what a task remembers and of the text it handles at once.
WORDS, PAIRS, SLICE = 300_000, 1_000_000, 4 << 20
#: Characters of a prefix's end by which the lengths of possible last pieces are looked up.
ENDING = 4


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


class Model:
    """A parsed model file and its word encoder."""

    def __init__(self, data: bytes):
        top = list(_fields(data))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if normal.get(2):
            raise ValueError("only models without a normalisation table are supported")
        if normal.get(4, 1):
            raise ValueError("only models that keep extra spaces are supported")
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.dummy = bool(normal.get(3, 1))
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.unk = 0
        for i, (_, v) in enumerate((k, v) for k, v in top if k == 1):
            f = dict(_fields(v))
            piece, kind = f[1].decode(), f.get(3, NORMAL)
            self.score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            self.bytes_of.append(piece.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"")
            if kind == USER:
                raise ValueError("user-defined pieces are not supported")
            if kind == NORMAL:
                self.ids[piece] = i
            elif kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif kind == UNKNOWN:
                self.unk = i
                self.bytes_of[i] = b" \xe2\x81\x87 "
        self.text = [""] * len(self.score)
        for p, i in self.ids.items():
            self.text[i] = p
        crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        lines = not any("\n" in p for p in self.ids)
        self.cut = None if crosses else re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.endings: dict[str, tuple[int, ...]] = {}
        long: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) >= ENDING:
                long.setdefault(p[-ENDING:], set()).add(len(p))
        self.long_endings = {k: tuple(sorted(v, reverse=True)) for k, v in long.items()}
        self.known: dict[str, bytes] = {}
        self.floor = min(self.score, default=0.0) - 10.0

    def merge(self, word: str | list[str], stop: int = 1) -> list[str]:
        """Pair merging of one short word as defined: the best-scored adjacent pair first, the leftmost of equals; down to stop parts."""
        s = list(word)
        while len(s) > stop:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.ids.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def _parts(self, t: int) -> tuple[int, int] | None:
        """The two pieces that a piece is last merged from; (t, t) for a single character; None unless every merge on the way comes earlier
        in merge order than the one it serves."""
        if t in self.parts:
            return self.parts[t]
        s, out = list(self.text[t]), (t, t)
        if len(s) > 1:
            halves = self.merge(s, 2)
            a, b = map(self.ids.get, halves) if len(halves) == 2 else (None, None)
            served = lambda x: x is not None and self._parts(x) is not None and (len(self.text[x]) == 1 or self.score[x] > self.score[t])
            out = (a, b) if served(a) and served(b) else None
        self.parts[t] = out
        return out

    def _stay(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of two pieces while they form: the pieces at the border are taken apart from the last merge
        back, and at each time their joint must not be a piece whose turn comes before the next merge (the left one of equals first)."""
        ids, text, score, parts, never = self.ids, self.text, self.score, self.parts, float("-inf")
        least, right = never, False  # score of the next merge at the border, and whether it is on the right side
        while True:
            joint = ids.get(text[a] + text[b])
            if joint is not None and (score[joint] > least or right and score[joint] == least):
                return False
            x, y = parts[a], parts[b]
            one, other = x[0] == a, y[0] == b
            if one and other:
                return True
            if other or not one and score[a] < score[b]:
                least, right, a = score[a], False, x[1]
            else:
                least, right, b = score[b], True, y[0]

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece b after piece a stays as it is (negative: a character outside the vocabulary)."""
        if a < 0 or b < 0:
            return True
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if self._parts(a) and self._parts(b):
                out = self._stay(a, b)
            else:
                x, y = self.text[a], self.text[b]
                out = self.merge(x + y) == [x, y]
            self.pairs[a, b] = out
        return out

    def lengths(self, end: str) -> tuple[int, ...]:
        """Lengths of the pieces that may end a prefix whose last ENDING characters are end, longest first: a longer piece that ends so, or
        a shorter one that ends it."""
        out = self.endings.get(end)
        if out is None:
            if len(self.endings) >= PAIRS:
                self.endings.clear()
            short = [n for n in range(min(len(end), ENDING - 1), 1, -1) if end[-n:] in self.ids]
            out = self.endings[end] = (*self.long_endings.get(end, ()), *short, 1)
        return out

    def encode_words(self, words: list[str]) -> None:
        """Add sorted distinct words to self.known, walking their trie depth first."""
        ids, bpe, follows, score = self.ids, self.kind == BPE, self._follows, self.score
        endings, lengths, pairs = self.endings, self.lengths, self.pairs
        starts, last = [0], [0]  # per prefix length: start and id of its last piece
        best = [0.0]  # Viterbi scores
        prev = ""
        for w in words:
            n, most = 0, min(len(prev), len(w))
            while n < most and prev[n] == w[n]:
                n += 1
            del starts[n + 1 :], last[n + 1 :]
            if bpe:
                for j in range(n + 1, len(w) + 1):
                    end = w[j - ENDING : j] if j > ENDING else w[:j]
                    for k in endings.get(end) or lengths(end):
                        i = j - k
                        if i < 0:
                            continue
                        t = ids.get(w[i:j])
                        if t is None:
                            if k > 1:
                                continue
                            t = -ord(w[i])
                        if i:
                            good = pairs.get((last[i], t))
                            if good is None:
                                good = follows(last[i], t)
                        else:
                            good = self._whole(w[:j], t)
                        if good:
                            starts.append(i)
                            last.append(t)
                            break
                    else:
                        raise AssertionError(f"no last piece for {w[:j]!r}")
            else:
                del best[n + 1 :]
                for j in range(n + 1, len(w) + 1):
                    pick = None
                    for k in lengths(w[max(0, j - ENDING) : j]):
                        i = j - k
                        if i < 0:
                            continue
                        t = ids.get(w[i:j])
                        if t is None:
                            if k > 1:
                                continue
                            t = -ord(w[i])
                        s = best[i] + (score[t] if t >= 0 else self.floor)
                        if pick is None or s > pick[0]:
                            pick = (s, i, t)
                    best.append(pick[0])
                    starts.append(pick[1])
                    last.append(pick[2])
            out, j = [], len(w)
            while j:
                out.append(last[j])
                j = starts[j]
            out.reverse()
            self.known[w] = array("i", out if min(out) >= 0 else self._final(out)).tobytes()
            prev = w

    def _whole(self, word: str, t: int) -> bool:
        """Whether a whole prefix is one piece in its own encoding."""
        if t < 0:
            return True
        out = self.pairs.get((t, -1))
        if out is None:
            out = self.pairs[t, -1] = self.merge(word) == [word]
        return out

    def _final(self, pieces: list[int]) -> list[int]:
        out: list[int] = []
        for t in pieces:
            if t >= 0:
                out.append(t)
            elif self.byte_id:
                out += [self.byte_id[c] for c in chr(-t).encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def cut_words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.dummy else "") + text.replace(" ", MARK)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.cut_words(t) for t in texts]
        if len(self.known) > WORDS:
            self.known.clear()
        fresh = {w for ws in cut for w in ws if w not in self.known}
        self.encode_words(sorted(fresh))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32) for ws in cut]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


SCHEMA = "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """documents -> doc_id, n_tokens, token_ids, round_trip (decoding the ids gives the text, marks read as spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model)
        for b in batches:
            lengths = [len(x) if x else 0 for x in b.column(1).to_pylist()]
            for i, j in _slices(lengths, SLICE):
                texts = [x or "" for x in b.column(1).slice(i, j - i).to_pylist()]
                ids = m.encode(texts)
                good = [m.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                n = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), lists, pa.array(good)], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def load(path: str = MODEL) -> bytes:
    """The model file's bytes, which travel with the plan (half a megabyte), so executors need no copy of it."""
    with open(path, "rb") as f:
        return f.read()
