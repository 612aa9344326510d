import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np
import pytest

from cinderlake.llm import pages

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


def test_documents_have_their_article(spark):
    src = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = pages.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(src)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", src[r.page_id].html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == src[r.page_id].url


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div id="main-menu"><a>m</a></div>
<main><header><h1>A &amp; B</h1></header><p>one&nbsp;two<br>three<!-- c --> <i>fo</i>ur<script>x="</p>"</script><p title="a>b">five</p>
<div class="cookie-notice"><p>cookies</p></div><aside>side</aside><form><p>form</p></form><section class="comments"><p>reader</p></section>
<ul><li>x<li>y</ul></main><footer>foot</footer>tail</body></html>"""


def test_structure(spark):
    assert [t for t, k in pages.blocks(PAGE) if k == pages.CONTENT] == ["A & B", "one two three four", "five", "x", "y"]
    assert ("tail", pages.NEUTRAL) in pages.blocks(PAGE)
    assert pages.blocks(None) == pages.blocks("") == [] and pages.blocks("a < b") == [("a < b", 0)]
    assert [t for t, _ in pages.blocks("<p>a <b>b<p>c</p> d &#233; &bogus; <")] == ["a b", "c", "d é &bogus; <"]


def test_differencing_deletes_what_neighbours_share(spark):
    def page(n):
        return f"<body><div>Top line</div><div>Shop | Blog | Contact</div><div>Story {n}</div><div>Text of story {n}, part one.</div><div>Part two of {n}.</div><div>All rights kept</div></body>"

    rows = [(i, f"http://h.example/{i // 3}/{i:03d}?q={i}", page(i)) for i in range(30)]
    rows += [(100 + i, f"http://copy.example/{i}", page(7)) for i in range(3)]  # copies delete nothing of each other
    rows += [(200, None, page(8)), (201, "http://alone.example/", page(9)), (202, "http://x.example/1", None), (0, "http://h.example/0/000?q=0", page(0))]
    got = {}
    for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got[0]) == 2
    for i in range(30):
        assert got[i][0].text == f"Story {i}\n\nText of story {i}, part one.\n\nPart two of {i}." and got[i][0].n_shared == 3
    for i in (100, 101, 102, 200, 201):
        assert got[i][0].text.startswith("Top line") and got[i][0].n_shared == 0
    assert (got[202][0].text, got[202][0].n_chars) == ("", 0)
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_marked_template_makes_no_copies(spark):
    """Two pages under one large menu lose their unmarked boilerplate; copies under it lose nothing."""
    menu = "<nav>" + "".join(f"<div>Menu {k}</div>" for k in range(60)) + "</nav>"

    def page(n):
        own = "".join(f"<div>Paragraph {k} of story {n}.</div>" for k in range(6))
        return f"<body>{menu}<div>Top</div><div>Shop</div>{own}<div>Write to us</div><div>Terms</div><div>All rights kept</div></body>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(10 + i, f"http://copy.example/{i}", page(7)) for i in range(3)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(6):
        assert got[i].text == "\n\n".join(f"Paragraph {k} of story {i}." for k in range(6)) and got[i].n_shared == 5
    assert all(got[10 + i].n_shared == 0 and got[10 + i].text.startswith("Top") for i in range(3))


def model(rows, structure=True):
    """Plain pairing by host and path, one LCS a pair, and deletion; the LCS itself is tested below."""
    lines = {}
    for i, url, h in rows:
        got = pages.blocks(h, structure)
        ids = np.array([hash(t) & (1 << 62) - 1 for t, _ in got], np.uint64)
        lines[i] = (pages.host_path(url), url, got, ids)
    drop = {i: set() for i in lines}
    order = sorted((i for i in lines if lines[i][1] and lines[i][0][0]), key=lambda i: (lines[i][0], lines[i][1]))
    for i, j in zip(order, order[1:]):
        if lines[i][0][0] == lines[j][0][0]:
            a, b = pages.lcs(lines[i][3], lines[j][3])
            own = [[k != pages.TEMPLATE for _, k in lines[x][2]] for x in (i, j)]
            least = min(map(sum, own))
            if least > 3 and sum(own[0][x] and own[1][y] for x, y in zip(a, b)) >= pages.COPY * least:
                continue
            drop[i] |= set(a.tolist())
            drop[j] |= set(b.tolist())
    return {i: "\n\n".join(t for n, (t, k) in enumerate(v[2]) if k == pages.CONTENT or k == pages.NEUTRAL and n not in drop[i]) for i, v in lines.items()}, drop


@pytest.mark.parametrize("structure, most", [(True, 1 << 20), (False, 1 << 20), (True, 0)])
def test_equals_plain_differencing(spark, structure, most):
    src = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in src.collect()]
    got = pages.extract(src.repartition(5), structure, most).collect()
    want, drop = model(rows, structure)
    assert {r.page_id: r.text for r in got} == want
    assert sum(r.n_shared + r.n_both for r in got) > 0 and (structure or sum(r.n_shared for r in got) == sum(map(len, drop.values())))


def test_names_inside_an_article_take_containers_only():
    html = '<article><h2 id="search">Search trees</h2><p class="notice">A notice was read.</p><math><mi>x</mi></math><div id="side">text</div><div class="ad">Buy</div><section role="search">find</section></article><p class="notice">cookies</p>'
    assert [t for t, k in pages.blocks(html) if k == pages.CONTENT] == ["Search trees", "A notice was read.", "x", "text"]
    assert ("cookies", pages.TEMPLATE) in pages.blocks(html)


@pytest.mark.parametrize("piece", ["<script ", '<a href="', "<a '\">", "<div><b>", "</p>", "<!-", "<a<", '<a ">" ', "<x y='", "&amp", "<p>text <i>"])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    t = time.process_time()
    for _ in pages.markup(page):
        pass
    pages.blocks(page)
    assert time.process_time() - t < 10  # two passes over a megabyte of nothing but breaks; a quadratic scan takes hours


def test_long_page_and_clashing_columns(spark):
    body = "".join(f"<p>Paragraph {i} of a very long page.</p>" for i in range(30_000))
    rows = [(1, "http://h.example/a", f"<article>{body}</article>"), (2, "http://h.example/b", "<div>short</div>")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as text", "3 as shared", "'h' as host", "4 as k")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert got[1].text.count("\n\n") == 29_999 and got[2].text == "short"


@pytest.mark.parametrize("seed", range(8))
def test_lcs_is_longest(seed):
    r = random.Random(seed)
    a, b = ([r.randrange(2 + seed) for _ in range(r.randrange(40))] for _ in range(2))

    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + best(i + 1, j + 1) if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    i, j = pages.lcs(np.array(a, np.uint64), np.array(b, np.uint64))
    assert len(i) == len(j) == best(0, 0)
    assert [a[x] for x in i] == [b[x] for x in j] and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
