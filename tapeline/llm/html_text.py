"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and each is compared with the nearer of its two neighbours: their text lines are
aligned by a longest common subsequence, and lines that both share are the site's and not the page's. Markup is evidence
beside that: scripts, menus, forms and other boilerplate elements never count; an ``article`` or ``main`` element is the text,
lines that a neighbour quotes included, unless the page has more than twice as many words of its own outside it (then the
element was a teaser, and the page's own lines are the text). A page whose every line is shared is a copy of its neighbour,
and differencing says nothing about it.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import batches, materialize, rows_of

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.DOTALL
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: Elements whose content is not text of the page: raw text elements are skipped up to their end tag.
RAW = frozenset({"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"})
BOILERPLATE = frozenset({"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "audio", "video", "object", "math"})
MAIN = frozenset({"article", "main"})
#: Elements that do not break a line; all other tags do.
INLINE = frozenset(
    {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
)
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Words of class, id and role values that mark menus, adverts, notices, side bars and reader comments.
MARKERS = frozenset(
    {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo",
     "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup",
     "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
)
#: Words that say where or how a marked element is laid out. Any other word beside a marker speaks of something else
#: (``related-work``, ``article-header``), and the element is text.
LAYOUT = frozenset(
    {"area", "articles", "bar", "block", "bottom", "box", "btn", "container", "content", "global", "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "media",
     "outer", "page", "panel", "posts", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "stories", "top", "unit", "user", "wrap", "wrapper", "zone"}
)
#: An element with such a marker is still text if it is one of these.
NEVER_MARKED = frozenset({"html", "body"})


@dataclass
class Line:
    text: str
    main: bool
    boilerplate: bool


def _marked(rest: str) -> bool:
    for found in _MARKS.finditer(rest):
        for name in (found[1] or found[2] or found[3] or "").split():
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()))
            if words & MARKERS and words <= MARKERS | LAYOUT:
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """Text lines in page order: what stands between two tags that break a line, white space turned to one space.

    Unclosed elements end with their parent. A main element inside an unclosed menu is main all the same.
    """
    out: list[Line] = []
    parts: list[str] = []
    open_: list[tuple[str, int]] = []  # name and kind of open elements: 1 boilerplate, 2 main
    hidden = main = at = 0
    raw = None

    def flush() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Line(text, main > 0, hidden > 0))
            parts.clear()

    while True:
        if raw:  # skip to the end tag
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if not end:
                break
            at, raw = end.start(), None
        found = _TAG.search(page, at)
        if not found:
            parts.append(page[at:])
            break
        if found.start() > at:
            parts.append(page[at : found.start()])
        at = found.end()
        if not (name := found["name"]):
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if not found["close"]:
            if name in RAW:
                raw = name if not found["rest"].rstrip().endswith("/") else None
                continue
            if name in MAIN:
                if not main:
                    hidden = 0
                    open_ = [(n, 0 if k == 1 else k) for n, k in open_]
                kind = 2
            elif name == "header" and main:
                kind = 0
            elif name in BOILERPLATE or (name not in NEVER_MARKED and "=" in found["rest"] and _marked(found["rest"])):
                kind = 1
            else:
                kind = 0
            if found["rest"].rstrip().endswith("/") and name in ("svg", "math"):
                continue
            if name == "body":  # ends an unclosed head
                hidden = main = 0
                open_ = []
            if kind and name in INLINE:
                flush()
            if name in ("p", "li", "option", "td", "th", "tr", "dt", "dd") and not kind:
                # these may stay unclosed without harm: they hold no state; a marked one ends with its parent or a sibling
                while open_ and open_[-1][0] == name:
                    kind_ = open_.pop()[1]
                    hidden, main = hidden - (kind_ == 1), main - (kind_ == 2)
                continue
            open_.append((name, kind))
            hidden, main = hidden + (kind == 1), main + (kind == 2)
        else:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    if any(k for _, k in open_[i:]):
                        flush()
                    for _, k in open_[i:]:
                        hidden, main = hidden - (k == 1), main - (k == 2)
                    del open_[i:]
                    break
    flush()
    return out


def common_subsequence(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.

    Common ends are taken first. The rest is split in halves of ``a`` (linear memory); lengths come from a bit-parallel
    recurrence over machine-independent integers, so a page of thousands of lines takes milliseconds.
    """
    out: list[int] = []

    def lengths(rows: Sequence[int], columns: Sequence[int]) -> np.ndarray:
        """Length of the common subsequence of ``rows`` with every prefix of ``columns``."""
        n, places = len(columns), {}
        for j, value in enumerate(columns):
            places[value] = places.get(value, 0) | 1 << j
        full = (1 << n) - 1
        state = full
        for value in rows:
            if hit := state & places.get(value, 0):
                state = ((state + hit) | (state - hit)) & full
        bits = np.unpackbits(np.frombuffer(state.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.append(j - 1)
            j, m = j - 1, m - 1
        if i >= j or k >= m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                out.append(i)
            continue
        half = (i + j) // 2
        left, right = lengths(a[i:half], b[k:m]), lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        split = k + int((left + right).argmax())
        todo += [(i, half, k, split), (half, j, split, m)]
    return sorted(out)


def main_text(lines: Sequence[Line], neighbour: Sequence[int] | None) -> str:
    """The page's own lines, joined by one space; ``neighbour`` holds the line hashes of the nearest page of the host."""
    mine = [x for x in lines if not x.boilerplate]
    shared = set(common_subsequence(hashes(mine).tolist(), neighbour)) if neighbour else set()
    if len(shared) == len(mine):
        shared = set()
    words = lambda kept: sum(x.text.count(" ") + 1 for x in kept)
    article, own = [x for x in mine if x.main], [x for i, x in enumerate(mine) if i not in shared]
    outside = [x for x in own if not x.main]
    return " ".join(x.text for x in (article if article and words(outside) <= 2 * words(article) else own))


def hashes(lines: Sequence[Line]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.text) for x in lines], np.uint64)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host without case and path without query, fragment and closing slash; a broken URL is its own path."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


SLIM = pa.schema([("_key", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())])


def neighbours(pages: DataFrame) -> DataFrame:
    """Row key and line hashes of the nearest other page of the host, for pages that have one.

    A host may hold a third of all pages: pages are sorted by host and path in ranges, neighbours are looked up inside each
    range, and what the first and last page of every range and host lack comes from one window over these alone. Only hashes
    of lines move; equal rows are one page.
    """

    def parse(source):
        for batch in batches(source, 256):
            rows: list[list] = [[] for _ in SLIM]
            for key, url, page in zip(*(batch.column(n).to_pylist() for n in ("_key", "url", "html"))):
                for column, value in zip(rows, (key, *host_and_path(url), hashes(lines_of(page)).tobytes())):
                    column.append(value)
            yield rows_of(SLIM, rows)

    slim = pages.mapInArrow(parse, "_key long, host string, path string, lines binary").dropDuplicates(["_key"])
    ranged = materialize(slim.repartitionByRange("host", "path", "_key").withColumn("_range", F.spark_partition_id()))

    def beside(before: str, after: str, *by: str) -> dict:
        w = Window.partitionBy(*by).orderBy("path", "_key")
        return {before: F.lag(F.struct("path", "lines")).over(w), after: F.lead(F.struct("path", "lines")).over(w)}

    inside = ranged.withColumns(beside("_before", "_after", "host", "_range"))
    ends = F.col("_before").isNull() | F.col("_after").isNull()
    edges = inside.filter(ends).withColumns(beside("_b", "_a", "host"))
    # inside a range the neighbour found there is the nearest; only a missing one is that of the range beside it
    edges = edges.withColumns({"_before": F.coalesce("_before", "_b"), "_after": F.coalesce("_after", "_a")}).drop("_b", "_a")
    pairs = inside.filter(~ends).unionByName(edges).select("_key", "path", "_before", "_after")

    def choose(source):
        for batch in source:
            rows: list[list] = [[], []]
            for r in batch.to_pylist():
                found = [x for x in (r["_before"], r["_after"]) if x]
                if found:
                    rows[0].append(r["_key"])
                    rows[1].append(max(found, key=lambda x: len(os.path.commonprefix([x["path"], r["path"]])))["lines"])
            yield rows_of(pa.schema([("_key", pa.int64()), ("lines", pa.binary())]), rows)

    return pairs.mapInArrow(choose, "_key long, lines binary")


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    A null html is the empty page and gives the empty text; a null url belongs to a host of its own. Repeated rows are one page
    to their neighbours and come out as often as they came in. Other columns are ignored.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = slim.withColumn("_key", F.xxhash64("page_id", "url", "html"))
    told = keyed.join(materialize(neighbours(keyed)), "_key", "left")

    def run(source):
        for batch in batches(source, 256):
            rows: list[list] = [[], [], [], []]
            for page_id, url, page, lines in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "lines"))):
                text = main_text(lines_of(page), np.frombuffer(lines, np.uint64).tolist() if lines else None)
                for column, value in zip(rows, (page_id, url, text, len(text))):
                    column.append(value)
            yield rows_of(TEXT, rows)

    return told.select("page_id", "url", "html", "lines").mapInArrow(run, "page_id long, url string, text string, n_chars long")
