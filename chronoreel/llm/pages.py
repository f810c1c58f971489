"""HTML extraction by nearest-URL page differencing.

Each page becomes text lines, one per block. Pages of a host are ordered by URL path; of the two neighbours the one with the longer common path
(the earlier of equals) is the page's pair. The longest common subsequence of the two line lists holds the lines they share, and these
are deleted first: menus, footers, notices and whatever else a site repeats. A structural guard corrects the rest, as the contract asks for the whole
article and nothing else: a deleted line inside an article (or main) element is restored (articles share license lines and passages),
and a line that is not shared goes all the same if it lies in a known boilerplate container (nav, header, footer, aside, forms, class or id
names of adverts, notices, comments and the like, whose text differs from page to page) or outside the article of a page that has one.
n_shared, n_restored and n_guarded count the lines that differencing deleted for good, that were restored, and that only the guard deleted.

A page whose lines are all the same (a mirror) says nothing: a page's neighbours are the nearest ones with other lines, however many
mirrors lie between. A page with none on its host keeps its lines, but for the guard.

Scale. Pages are ordered with only line hashes on board, by range partitioning on (host, path), so a host of any size is
spread over tasks; partition edges are stitched from one row each. Pages are parsed a second time for their text, which moves once, deflated, to
meet its decisions: a table of the texts beside that would take as much disk again, and parsing is cheap. Parsing takes time in
proportion to the page, whatever it holds: a tag whose quotes don't close ends at its first ">", and after PATIENCE page lengths of vain search quotes
are ignored. The common subsequence takes memory for CELLS bits at most (beyond it the lists are halved).

Nulls and odd input: a null or empty html gives empty text; a null url is a host of its own; rows alike in page_id, url and html share a
decision; unclosed containers hold nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: Page lengths of search for closing quotes that may be in vain; bits held for a common subsequence.
PATIENCE, CELLS = 8, 1 << 27
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes", "template"}
#: Elements that never hold main text.
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "fieldset", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id and role names that mark boilerplate.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "bannerad", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted",
    "promotion", "related", "replies", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "topbar", "widget",
}
KEEP, OPEN, DROP = 1, 0, -1


def _is_marked(attributes: str) -> bool:
    for name, value in ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            if any(w in MARKED for w in re.split(r"[^a-z0-9]+", value)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def tokens_of(page: str) -> list[tuple[int, int, bool | None, str, str]]:
    """(start, end, opening, name, attributes) of all markup; opening is None for comments and raw elements, which come as one token."""
    tokens, at, vain, endless = [], 0, 0, set()

    def find(what: str, start: int) -> int:
        """Where what ends, or -1; a search that fails once is not made again."""
        k = -1 if what in endless else page.find(what, start)
        if k < 0:
            endless.add(what)
            return -1
        return k + len(what)

    while m := MARKUP.search(page, at):
        start, at, name = m.start(), m.end(), ""
        if m[1]:
            at = find("-->", at)
            tokens.append((start, at if at >= 0 else len(page), None, "", ""))
            if at < 0:
                break
            continue
        if m[2] and (end := find("]]>", at)) >= 0:
            tokens.append((start, end, None, "", ""))
            at = end
            continue
        if m[5]:
            end = ATTRIBUTES.match(page, at).end() if vain <= PATIENCE * len(page) else at
            if page[end : end + 1] == ">":
                name, attributes, at = m[5].lower(), page[at:end], end + 1
            else:
                vain += end - at
        if not name:  # a declaration, or a tag whose quotes don't close
            end = find(">", at)
            if end < 0:
                break  # no markup can follow
            name, attributes, at = (m[5] or "").lower(), page[at : end - 1] if m[5] else "", end
        if name in RAW and not m[4]:
            close = None if name in endless else re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                endless.add(name)
                if name in ("script", "style"):
                    at = len(page)
            name = ""
        tokens.append((start, at, None if not name else not m[4], name, attributes))
    return tokens


def lines_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of every line that has text, in page order; character references decoded, white space made single spaces."""
    tokens = tokens_of(page)
    # Where each container that matters closes: unclosed ones hold nothing, unclosed articles the rest.
    closes, waiting = {}, {}
    for k, (_, _, opening, name, _) in enumerate(tokens):
        if opening and name not in VOID:
            waiting.setdefault(name, []).append(k)
        elif opening is False and waiting.get(name):
            closes[waiting[name].pop()] = k
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    drop_to, articles, pos, place = -1, [], 0, OPEN

    def end_line() -> None:
        if piece and (text := " ".join(html.unescape("".join(piece)).split())):
            out.append((place, text))
        piece.clear()

    for k, (start, end, opening, name, attributes) in enumerate(tokens):
        piece.append(page[pos:start])
        pos = end
        if opening is None:
            continue
        if name not in INLINE:
            end_line()
        if opening and k > drop_to:
            inside = bool(articles)
            if name in OUTSIDE or name == "header" and not inside or (attributes and name not in ("html", "body", "article", "main") and _is_marked(attributes)) or (name == "article" and attributes and _is_marked(attributes)):
                if k in closes:
                    if name in INLINE:
                        end_line()
                    drop_to = closes[k]
            elif name in ("article", "main"):
                articles.append(closes.get(k, len(tokens)))
        if k == drop_to and name in INLINE:
            end_line()
        while articles and articles[-1] <= k:
            articles.pop()
        place = DROP if k < drop_to else KEEP if articles else OPEN
    piece.append(page[pos:])
    end_line()
    return out


def address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower(), m[2]) if m else ("", url or "")


def _rows(x: list, y: list) -> Iterator[int]:
    """For each prefix of x, bits over y whose zeros among the low j count the longest common subsequence with the first j of y."""
    where: dict = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    row = full = (1 << len(y)) - 1
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: list, y: list) -> np.ndarray:
    """Length of the longest common subsequence of x and the first j of y, for each j."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list, b: list, cells: int = CELLS) -> list[bool]:
    """Which items of a lie in one longest common subsequence of a and b. Bit-parallel, with the rows kept for tracing back where they
    have cells bits at most; otherwise a is halved and b cut where the halves' lengths add up to most."""
    used = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        used[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        used[-1 - hi] = True
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(x) * len(y) > cells and len(x) > 1:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        used[lo : len(a) - hi] = common_lines(x[:half], y[:cut], cells) + common_lines(x[half:], y[cut:], cells)
        return used
    rows = list(_rows(x, y))
    j, full = len(y), (1 << len(y)) - 1
    for i in range(len(x) - 1, -1, -1):
        # zeros among the low j bits count the subsequence's length; drop columns that add nothing, then see whether row i is needed
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if not j:
            break
        above = rows[i - 1] if i else full
        if (above & ((1 << j) - 1)).bit_count() > (rows[i] & ((1 << j) - 1)).bit_count():
            used[lo + i] = True
            j -= 1
    return used


def _key(page_id, url, page) -> bytes:
    return hashlib.md5(f"{page_id}\n{url}\n".encode() + (page or "").encode()).digest()


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


OUTLINES = "key binary, host string, path string, lines array<long>"
PACKED = "key binary, page_id long, url string, packed binary"
PLACES = "-?="


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line hashes of each page."""
    kinds = (pa.binary(), pa.string(), pa.string(), pa.list_(pa.int64()))
    for b in batches:
        rows = [(_key(i, u, h), *address(u), [_line_hash(t) for _, t in lines_of(h or "")]) for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "host", "path", "lines"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deflated the places of each page's lines and the text of those that may stay."""
    for b in batches:
        keys, out = [], []
        for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = lines_of(h or "")
            article = any(p == KEEP for p, _ in lines)
            held = [t for p, t in lines if p == KEEP or p == OPEN and not article]
            keys.append(_key(i, u, h))
            out.append(zlib.compress("\n".join(["".join(PLACES[p + 1] for p, _ in lines), *held]).encode(), 3))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0), b.column(1), pa.array(out, pa.binary())], ["key", "page_id", "url", "packed"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            best = None
            for side in ("prev", "next"):
                if r[f"{side}_host"] == r["host"] and r[f"{side}_lines"] is not None and r[f"{side}_lines"] != r["lines"]:
                    near = len(os.path.commonprefix([r["path"], r[f"{side}_path"]]))
                    if best is None or near > best[0]:
                        best = (near, r[f"{side}_lines"])
            out.append(common_lines(r["lines"], best[1]) if best else [False] * len(r["lines"]))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.bool_()))], ["key", "shared"])


RESULT = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_restored long, n_guarded long"


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for packed, shared in zip(b.column("packed").to_pylist(), b.column("shared").to_pylist(), strict=True):
            places, *held = zlib.decompress(packed).decode().split("\n")
            article, texts, kept, n = "=" in places, iter(held), [], [len(places), 0, 0, 0]
            for place, gone in zip(places, shared or [False] * len(places), strict=True):
                text = next(texts) if place == "=" or place == "?" and not article else None
                if gone and place == "=":
                    n[2] += 1
                elif gone:
                    n[1] += 1
                    continue
                elif text is None:
                    n[3] += 1
                    continue
                kept.append(text)
            text = " ".join(kept)
            rows.append((text, len(text), *n))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), *(pa.int64(),) * 5), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *arrays], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_restored", "n_guarded"])


def _columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), "url", "html")


def parsed_pages(pages: DataFrame) -> DataFrame:
    return materialize(_columns(pages).mapInArrow(_outlines, OUTLINES))


def shared_lines(parsed: DataFrame) -> DataFrame:
    """parsed_pages() -> key (of page_id, url, html), shared: for each line whether the nearest page of the host shares it."""
    order = ["host", "path", "key"]
    n = max(16, int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows of one key lie in one range
    ranged = materialize(parsed.repartitionByRange(n, *order).dropDuplicates(order).withColumn("part", F.spark_partition_id()))
    me = F.struct("host", "path", "lines")
    same = lambda x, y: x["host"].eqNullSafe(y["host"]) & x["lines"].eqNullSafe(y["lines"])

    def past_mirrors(*by) -> Column:
        """The row before this row's run of equal lines, in a partition; null where the run begins it."""
        w = Window.partitionBy("part").orderBy(*by)
        last = F.lag(me).over(w)
        begins = F.when(last.isNull() | ~same(last, me), F.struct(last.alias("x")))
        return F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["x"]

    ranged = ranged.withColumns({"p": past_mirrors(*order), "n": past_mirrors(*map(F.desc, order))})
    # of each partition the first and the last row, and the row after the first's run and before the last's; one row per partition
    at = F.struct(*order)
    edges = ranged.groupBy("part").agg(F.min_by(me, at).alias("head"), F.max_by(me, at).alias("tail"), F.min_by("n", at).alias("head_n"), F.max_by("p", at).alias("tail_p"))

    def beyond(first: str, inner: str, mine: str, *by) -> Column:
        """The nearest other row in the partitions before: the last one's row, or what lies before its run where that goes on here."""
        w = Window.orderBy(*by)
        row = F.lag(first).over(w)
        other = F.when(row.isNotNull() & ~same(row, F.col(mine)), row)
        before_run = F.last(F.coalesce(inner, other), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(other, before_run)

    edges = edges.select("part", beyond("tail", "tail_p", "head", "part").alias("before"), beyond("head", "head_n", "tail", F.desc("part")).alias("after"))
    near = ranged.join(F.broadcast(edges), "part")
    near = near.withColumns({"p": F.coalesce("p", "before"), "n": F.coalesce("n", "after")})
    sides = [F.col(f"{a}.{c}").alias(f"{b}_{c}") for a, b in (("p", "prev"), ("n", "next")) for c in ("host", "path", "lines")]
    return near.select("key", "host", "path", "lines", *sides).mapInArrow(_decide, "key binary, shared array<boolean>")


def extract(pages: DataFrame) -> DataFrame:
    """pages -> page_id, url, text, n_chars and line counts; one row per page."""
    packed = _columns(pages).mapInArrow(_packed, PACKED)
    return packed.join(shared_lines(parsed_pages(pages)), "key", "left").select("page_id", "url", "packed", "shared").mapInArrow(_join_lines, RESULT)
