"""Secret scans: three fixed patterns, then a randomness test battery over token-like runs.

Base. Leftmost non-overlapping matches of each kind; those that are too short are dropped after matching.

Battery. Candidates are maximal runs of token characters with MIN_TOKEN letters and digits or more. Each gets the smallest encoding that
explains it (hex, base32, base36, base64), which says which letters and digits it may hold. The hypothesis is "ordinary text": names, words run
together, numbers. Three tests ask whether the token is more random than that:

* uniformity: chi-squared over the encoding's alphabet, that is the number of equal pairs of characters of a class, is lower than letters of
  text and digits of numbers give (normal approximation with the exact mean and variance of that count);
* runs: there are more runs of a class of characters (small, capital, digit) than words and numbers run together have (binomial tail;
  a capital before small letters begins a word and is not a change to them);
* serial correlation: vowels and consonants alternate less than they do in words, whose lag-1 correlation is negative (binomial tail).

Fisher's sum joins the three p values. Over a document's tokens (those under base spans too) Benjamini-Hochberg rejects the hypothesis with
weights in proportion to length (long tokens have the power to be told apart, so they get more of the error budget), so of the tokens called random
a share of LEVEL at most is expected to be ordinary. Rejected tokens are added as kind random, unless base spans cover all of them; of
a token that they cover in part the rest is tested (all of it where the rest is short) and the whole is marked. n_tested and n_judged count the
tokens tested and the rejected ones, both with those under base spans.

Nulls and odd input: a null or empty text has no spans; whole texts are scanned; duplicates get equal results; other columns are
kept by redact() and ignored by scan(); an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 or more: the same as dropping shorter maximal runs
NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
MIN_TOKEN = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN)
SEPARATORS = str.maketrans("", "", "+/-_")
LEVEL = 0.01
#: The letters and digits of each encoding, the smallest first; separators of base64 don't count as characters.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
)
# Usual shares of the letters a to z in text, per mille, and of the digits 0 to 9 in numbers (a first digit's, rounded, with zeros).
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
DIGITS = (200, 230, 130, 95, 75, 65, 60, 50, 50, 45)
#: Of neighbouring characters of ordinary tokens, the share that changes class, and of neighbouring letters, the share that goes from vowel to consonant or back.
CHANGES, ALTERNATES = 0.15, 0.5
VOWELS = frozenset("aeiouAEIOU")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> tuple[str, str] | None:
    has = set(token.translate(SEPARATORS))
    return next((x for x in ALPHABETS if has <= set(x[1])), None)


def binomial_upper(x: int, n: int, p: float) -> float:
    """P(at least x of n), exact up to 2,000 trials, else by the normal law."""
    if x <= 0:
        return 1.0
    if n > 2000:
        return 0.5 * math.erfc((x - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p)))
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p))
    total = 0.0
    for k in range(x, n + 1):
        total += term
        term *= (n - k) / (k + 1) * p / (1 - p)
    return min(1.0, total)


def _classes(alphabet: str) -> list[tuple[str, float, float]]:
    """Characters of each class of an alphabet, with the sums of squares and of cubes of their usual shares among themselves."""
    out = []
    for kind in (str.islower, str.isupper, str.isdigit):
        chars = "".join(filter(kind, alphabet))
        if chars:
            f = np.array([DIGITS[int(c)] if c.isdigit() else LETTERS[ord(c.lower()) - 97] for c in chars], float)
            f /= f.sum()
            out.append((chars, float((f**2).sum()), float((f**3).sum())))
    return out


CLASSES = {alphabet: _classes(alphabet) for _, alphabet in ALPHABETS}


def uniformity_p(token: str, alphabet: str) -> float:
    """Of a token without separators: chance that ordinary text has as few equal pairs in the classes of the alphabet."""
    counts, seen, mean, var = Counter(token), 0, 0.0, 0.0
    for chars, squares, cubes in CLASSES[alphabet]:
        c = [counts[x] for x in chars if x in counts]
        n = sum(c)
        seen += sum(k * (k - 1) // 2 for k in c)
        pairs = n * (n - 1) / 2
        mean += pairs * squares
        var += pairs * squares * (1 - squares) + n * (n - 1) * (n - 2) * (cubes - squares**2)
    return 0.5 * math.erfc((mean - seen - 0.5) / math.sqrt(2 * var)) if var > 0 else 1.0


def runs_p(token: str) -> float:
    """Of a token without separators: chance that ordinary text changes class as often."""
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in token]
    changes = sum(a != b and not (a == "u" and b == "l" and (i == 0 or kind[i - 1] != "u")) for i, (a, b) in enumerate(zip(kind, kind[1:], strict=False)))
    return binomial_upper(changes, len(token) - 1, CHANGES)


def serial_p(token: str) -> float:
    """Of a token without separators: chance that unlike neighbouring letters of ordinary text alternate between vowels and consonants as seldom."""
    pairs = [(a in VOWELS) != (b in VOWELS) for a, b in zip(token, token[1:], strict=False) if a.isalpha() and b.isalpha() and a.lower() != b.lower()]
    return binomial_upper(len(pairs) - sum(pairs), len(pairs), 1 - ALTERNATES)


def ordinary_p(token: str) -> float:
    """Fisher's sum of the three tests: the p value of "ordinary text"."""
    bare = token.translate(SEPARATORS)
    half = -sum(math.log(max(p, 1e-300)) for p in (uniformity_p(bare, encoding(bare)[1]), runs_p(bare), serial_p(bare)))
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def rejected(p: list[float], length: list[int], level: float = LEVEL) -> list[bool]:
    """Weighted Benjamini-Hochberg: which hypotheses go, the weights being in proportion to length and one on average."""
    mean = sum(length) / max(1, len(length))
    q = [x * mean / n for x, n in zip(p, length, strict=True)]
    last = max((x for k, x in enumerate(sorted(q), 1) if x <= level * k / len(q)), default=-1.0)
    return [x <= last for x in q]


def tested(token: str, taken: list[tuple[int, int]]) -> str:
    """What the battery looks at: the token without its base spans, or all of it where less than MIN_TOKEN is left; nothing where base
    spans cover it all."""
    rest, at = [], 0
    for s, e in sorted(taken):
        rest.append(token[at : max(at, s)])
        at = max(at, e)
    left = "".join([*rest, token[at:]])
    return left if len(left) >= MIN_TOKEN or not left else token


def battery(text: str, taken: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int, int]:
    """Spans of tokens called random that base spans don't cover; how many tokens were tested and how many called random."""
    found = []
    for m in TOKEN.finditer(text):
        under = [(s - m.start(), e - m.start()) for s, _, e in taken if s < m.end() and m.start() < e]
        left = tested(m[0], under)
        bare = (left or m[0]).translate(SEPARATORS)
        if len(bare) >= MIN_TOKEN:
            found.append((m.start(), m.end(), len(bare), ordinary_p(bare), bool(left)))
    if not found:
        return [], 0, 0
    gone = rejected([f[3] for f in found], [f[2] for f in found])
    return [(f[0], 3, f[1]) for f, r in zip(found, gone, strict=True) if r and f[4]], len(found), sum(gone)


def random_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return battery(text, taken)[0]


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base))


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


NAMES_OUT = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "n_tested", "n_judged", "base_sha256", "spans"]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, n_tested long, n_judged long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            more, n_tested, n_judged = battery(text, base)
            spans = sorted(base + more)
            kinds = [k for _, k, _ in spans]
            rows.append((*(kinds.count(k) for k in range(4)), n_tested, n_judged, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], NAMES_OUT)


def scan(docs: DataFrame) -> DataFrame:
    """documents -> per row its span counts, the digest of its base spans and all spans."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """text with every span replaced by mark; overlapping spans become one."""
    if not text:
        return text
    out, at, open_to = [], 0, -1
    for s, _, e in all_spans(text)[1]:
        if s >= open_to:
            out += [text[at:s], mark]
        at = open_to = max(open_to, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """documents with secrets replaced in text, and n_chars counted anew where it changed; other columns as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns)
            old = arrays[at].to_pylist()
            new = [redacted(t) for t in old]
            arrays[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([n if x == y or y is None else len(y) for n, x, y in zip(arrays[k].to_pylist(), old, new, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
