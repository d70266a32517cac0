from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm.common import table
from tapeline.llm.html_text import common_subsequence, extract, hashes, host_and_path, lines_of, main_text

PAGES = "page_id long, url string, html string, path string, host string"


def own(page, neighbour=None):
    return main_text(lines_of(page), neighbour)


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><script>var t='</p><article>no</article>';</script></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n three<br>four</p></article><footer>f</footer></body></html>", "A & B onetwo three four"),
    ("<article><p><b>bold.<br><p>next &copy 2 &#233;&nbsp;x", "bold. next © 2 é x"),
    ("<nav>open menu<article>text</article> after", "text"),
    ("<main><header><h1>Title</h1></header><div class='comments'><p>nice!</p></div><aside>x</aside><p>body</p><form><input>f</form></main>", "Title body"),
    ("<p>plain <i>page</i></p><div id=sidebar><p>s</p></div><div class='ad-box'>buy<div>more</div></div><!-- <p>no</p> --><p>1 < 2 and a<b</p>", "plain page 1 < 2 and a"),
    ("<body><div title='a>b' class=\"cookieNotice\">c</div><section>real</section><style>p{}</style><script>unclosed", "real"),
    ("", ""), ("just text", "just text"), ("<div", ""), ("<!-- open", ""), ("<article></article><p>outside</p>", "outside"),
])
def test_markup(page, text):
    assert own(page) == text


@pytest.mark.parametrize("page, text", [
    ("<div class='content share-enabled'><p>story</p></div>", "story"),
    ("<article><div class='article-header'><h1>Title</h1></div><p>body</p></article>", "Title body"),
    ("<p class=related-work>a</p><div class='notice-of-race'>b</div><div id='ad-hoc-networks'>c</div>", "a b c"),
    ("<div class='site-header'>x</div><div id=topAdBox>x</div><ul class='comments list'><li>x</li></ul><p>y</p>", "y"),
    ("<article class='teaser'><p>Read on</p></article><div><p>the real text is longer by far</p><p>and goes on</p></div>", "Read on the real text is longer by far and goes on"),
    ("<article><p>one two three</p></article><p>four five six seven</p>", "one two three"),
])
def test_markers_are_evidence(page, text):
    assert own(page) == text


def nearest_by_scan(pages):
    """Text of every page against its nearest page, found by looking at all pages of the host in order."""
    order = sorted({(*host_and_path(r["url"]), r["_key"], r["html"]) for r in pages})
    out = {}
    for i, (host, path, key, page) in enumerate(order):
        near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][0] == host]
        alike = [next((k for k, (x, y) in enumerate(zip(n[1], path)) if x != y), min(len(n[1]), len(path))) for n in near]
        seen = hashes(lines_of(near[alike.index(max(alike))][3])).tolist() if near else None
        mine = [x for x in lines_of(page) if not x.boilerplate]
        drop = set()
        if seen:
            at = hashes(mine).tolist()
            # the lines of these pages differ within a page, so any longest common subsequence of shared lines in order is one
            drop = {k for k, h in enumerate(at) if h in seen}
            assert longest(at, seen) == len(drop)
        if len(drop) == len(mine):
            drop = set()
        article = [x.text for x in mine if x.main]
        out[key] = " ".join(article or [x.text for k, x in enumerate(mine) if k not in drop])
    return out


@pytest.mark.parametrize("partitions", [1, 2, 7, 16])
def test_differencing_against_a_scan(spark, partitions):
    """Pages with and without a main element, mixed, give the same text however many ranges they are sorted into."""
    rows = []
    for i in range(60):
        host, part = f"h{i % 3 % 2}.org", f"/s{i % 5}/{i * 7 % 60:02d}"
        top = f"<div>Section {i % 5}</div><div>Host {host}</div>"
        body = f"<article><p>Quoted {host}</p><p>main {i} and some more words of it</p></article>" if i % 4 == 0 else f"<p>only {i}</p>"
        rows.append((i, f"http://{host}{part}", f"{top}{body}<div>End of {host}</div>", "", ""))
    pages = spark.createDataFrame(rows + rows[:5], PAGES)
    keyed = pages.withColumn("_key", F.xxhash64("page_id", "url", "html")).collect()
    want = nearest_by_scan(keyed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = extract(pages.repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((r["page_id"], want[r["_key"]]) for r in keyed)


def longest(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_alignment_is_longest():
    rng = np.random.default_rng(2)
    for n in range(120):
        a, b = (rng.integers(0, rng.integers(1, 9), rng.integers(0, 25)).tolist() for _ in range(2))
        at = common_subsequence(a, b)
        assert len(at) == longest(a, b) and at == sorted(set(at))
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in at)
    assert len(common_subsequence([1] * 5000, [1, 2] * 4000)) == 4000


def test_lines_shared_with_the_nearest_page_go(spark):
    shell = "<div>Site name</div><div>%s</div><div>Read more here</div>"
    rows = [(i, f"http://h.org/a/{i:03d}?q={i}", shell % f"own text {i}", "clash", "clash") for i in range(40)]
    rows += [(100, "http://single.org/x", shell % "alone", "", ""), (101, None, None, None, None), (102, "http://[bad", "", None, None), (0, rows[0][1], rows[0][2], "", "")]
    rows += [(200 + i, f"http://copy.org/{i}", "<p>the same</p><p>page</p>", "", "") for i in range(2)]
    got = {}
    for r in extract(spark.createDataFrame(rows, PAGES).repartition(5)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {i: got[i] for i in range(40)} == {i: [f"own text {i}"] * (2 if i == 0 else 1) for i in range(40)}
    assert got[100] == ["Site name alone Read more here"] and got[101] == got[102] == [""]
    assert got[200] == got[201] == ["the same page"]
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_every_page_against_its_article(spark):
    """The article element by a plain cut of the page source."""
    import html

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        want[r["page_id"]] = " ".join(x for x in blocks if x)
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == want


def test_urls():
    assert host_and_path("HTTP://WWW.A.org:80/x/y/?q#f") == ("www.a.org", "/x/y")
    assert host_and_path(None) == ("", "")
