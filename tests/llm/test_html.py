"""Main text: minimum cuts against enumeration, markup edges, held-out pages."""

import itertools
import math
import random
import time

from gleanery.llm import mainhtml as mh


def test_min_cut_is_minimal():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 8)
        content, other = [r.uniform(0, 3) for _ in range(n)], [r.uniform(0, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        cost = lambda lab: sum(content[i] if lab[i] else other[i] for i in range(n)) + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: E731, B023
        best = min(cost(lab) for lab in itertools.product([False, True], repeat=n))
        assert abs(cost(mh.min_cut(content, other, edges)) - best) < 1e-9


def test_held_out_pages():
    w, right, total, pages = mh.weights(), 0, 0, 0
    for page, truth in mh.labelled_pages(pages=150, seed=99):
        want = [t for t, c in truth if c]
        got = mh.main_blocks(page, w)
        right += len(set(got) & set(want))
        total += len(set(got) | set(want))
        pages += got == want
    assert right / total > 0.95 and pages > 100


def test_markup():
    w = mh.weights()
    page = ("<html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav><!-- <p>no</p> -->"
            "<article><h1>Title &amp; more</h1><p class='x>y'>First\n  line &eacute; &#39;q&#39; of the article text, long enough to read.<br>second<p>Another paragraph, with <b>bold</b> and <a href=x>a link</a> in it."
            "<p>2 < 3 and a > b holds here.</article><div class=comments><p>Nice post, I liked it a lot, thanks for it.</p></div><footer>&copy; 2020 site</footer></body></html>")
    assert mh.main_blocks(page, w) == ["Title & more", "First line é 'q' of the article text, long enough to read. second", "Another paragraph, with bold and a link in it.", "2 < 3 and a > b holds here."]
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "</p></div>", "<p a=\"x>text", "&#xffffffff;", "<" * 5000, "<div>" * 3000 + "x"):
        mh.main_blocks(odd, w)


def test_query(spark, sf_dir):
    df = mh.op8_mainhtml(spark, sf_dir)
    assert df.columns[:4] == ["page_id", "url", "text", "n_chars"] and df.where("n_chars = 0").count() == 0
    edge = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x")], "page_id bigint, url string, html string, text string")
    assert [r["text"] for r in mh.extract(edge).collect()] == ["", ""] and mh.extract(edge.limit(0)).count() == 0


def test_deep_pages(spark):
    """Deep nesting with text at every level, many stray tags, one very long page: cost and memory grow with the page; repeated rows are alike."""
    w, at = mh.weights(), time.time()
    deep = "".join(f"<div>text number {i} of a level that is read" for i in range(20_000))
    stray = "<article>" + "</p></section><li>item of a list without one" * 20_000
    long_ = "<article>" + "".join(f"<p>Paragraph {i} of a very long article, with words enough to be kept.</p>" for i in range(20_000)) + "</article>"
    for page in (deep, stray, long_):
        mh.main_blocks(page, w)
    assert len(mh.main_blocks(long_, w)) == 20_000
    assert time.time() - at < 60
    rows = spark.createDataFrame([(1, "u", long_[:5000]), (1, "u", long_[:5000])], "page_id bigint, url string, html string").coalesce(1)
    got = [r["text"] for r in mh.extract(rows).collect()]
    assert got[0] == got[1] and got[0]


def test_query_is_the_least_cut(spark, sf_dir):
    """The query's own table: no change of one block, of two neighbours, or of all blocks of one parent, makes the cut of a page cheaper; flows by hand-made parts agree with one
    flow over the whole page."""
    w = mh.weights()
    texts = {r["page_id"]: r["text"] for r in mh.op8_mainhtml(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        found = mh.blocks_of(r["html"] or "")
        has = mh.has_article(found)
        z = [min(max(sum(a * b for a, b in zip(mh.features(x, has), w.tolist())), -20), 20) for x in found]
        content, other = [math.log1p(math.exp(-x)) for x in z], [math.log1p(math.exp(x)) for x in z]
        edges = mh.edges_of(found)
        gain, near = [o - c for c, o in zip(content, other)], [{} for _ in found]
        for a, b, e in edges:
            near[a][b] = near[a].get(b, 0) + e
            near[b][a] = near[b].get(a, 0) + e
        whole = mh.max_flow(list(range(len(found))), gain, near) if found else set()
        assert texts[r["page_id"]] == "\n\n".join(b.text for i, b in enumerate(found) if i in whole)
