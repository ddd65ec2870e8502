"""Pages as Markdown against a walk over a tree, notebooks' heads and pictures, one call for all formats."""

import base64
import json
import random
import time
from xml.etree import ElementTree as ET

from gleanery.operators import sections
from gleanery.sources import pages, readers
from test_office import png


def walk(e, out, own=False, lists=(), quote=False):
    """Blocks of a well-formed tree, in order, written down recursively."""
    flat = lambda x: " ".join("".join(x.itertext()).split())
    own = own or e.tag in ("article", "main")

    def put(text, mark=""):
        if text:
            text = mark + text
            out.append((own, "> " + text if quote else text))

    if e.tag in pages.OUT:
        return
    if e.tag in pages.LEVEL:
        put(flat(e), "#" * pages.LEVEL[e.tag] + " ")
    elif e.tag == "p":
        put(flat(e))
    elif e.tag in ("ul", "ol"):
        n = 0
        for li in e:
            n += 1
            text = " ".join((li.text or "").split())
            put(text, "  " * len(lists) + ("- " if e.tag == "ul" else f"{n}. "))
            for c in li:
                walk(c, out, own, (*lists, e.tag), quote)
    elif e.tag == "table":
        rows = [[flat(c) for c in tr] for tr in e]
        rows = [r for r in rows if any(r)]
        if rows:
            w = max(map(len, rows))
            line = lambda r: "| " + " | ".join(r + [""] * (w - len(r))) + " |"
            out.append((own, "\n".join([line(rows[0]), "|" + "---|" * w, *map(line, rows[1:])])))
    else:
        for c in e:
            walk(c, out, own, lists, quote or e.tag == "blockquote")


def made(rng, depth=0):
    words = lambda: " ".join(rng.choices(["one", "two", "<b>bold</b>", "<a href='x'>link</a>", "&amp;", "é"], k=rng.randint(1, 5)))
    kind = rng.choice(["p", "p", "h2", "ul", "ol", "table", "div", "nav", "blockquote", "article"] if depth < 3 else ["p"])
    if kind in ("p", "h2"):
        return f"<{kind}> {words()}\n{words()} </{kind}>"
    if kind in ("ul", "ol"):
        inner = lambda: made_list(rng) if rng.random() < 0.3 else ""
        return f"<{kind}>" + "".join(f"<li>{rng.choice(['item', 'other  item'])}{inner()}</li>" for _ in range(rng.randint(1, 3))) + f"</{kind}>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{rng.choice(['', 'x', 'y z'])}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
    return f"<{kind}>" + "".join(made(rng, depth + 1) for _ in range(rng.randint(0, 3))) + f"</{kind}>"


def made_list(rng):
    return "<ul>" + "".join(f"<li>deep {i}</li>" for i in range(rng.randint(1, 2))) + "</ul>"


def test_markdown_equals_a_walk(spark):
    rng = random.Random(2)
    htmls = ["<html><body>" + "".join(made(rng) for _ in range(rng.randint(0, 6))) + "</body></html>" for _ in range(300)]
    got = {r["doc_id"]: r["text"] for r in pages.to_markdown(spark.createDataFrame(list(enumerate(htmls)), "doc_id int, html string")).collect()}
    for i, h in enumerate(htmls):
        out = []
        walk(ET.fromstring(h), out)
        own = any(o for o, _ in out)
        assert got[i] == "\n\n".join(t for o, t in out if o or not own), h


def test_loose_markup():
    h = """<html><head><title>T &amp; x</title><meta name=author content="A, B"></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav><article><header><h1>Head <a href=x>link</a></h1></header><p>one<p>two &eacute; <b>b</b><br>c<ul><li>a
<ul><li>deep</ul><li>b<p>more</ul><ol><li>x<li>y</ol><table><tr><th>h<th>k<tr><td>1<td>2|3</table><pre>
 code  x
</pre><blockquote><p>q<p>r</blockquote><img src=a.png alt="pic"><img src="data:x"><p># no head<script>bad</script></article><footer>f</footer>"""
    title, text, authors, figures = pages.markdown_of(h)
    assert (title, authors, figures) == ("T & x", ["A", "B"], [{"path": "a.png", "caption": "pic"}])
    assert text == "# Head link\n\none\n\ntwo é b c\n\n- a\n\n  - deep\n\n- b\n\n  more\n\n1. x\n\n2. y\n\n| h | k |\n|---|---|\n| 1 | 2\\|3 |\n\n```\n code  x\n```\n\n> q\n\n> r\n\n![pic](a.png)\n\n\\# no head"
    assert pages.markdown_of("") == ("Untitled", "", [], []) and pages.markdown_of("<p>open <b>x")[1] == "open x"
    at = time.time()
    assert pages.markdown_of("<div>" * 20_000 + "x" + "</p>" * 20_000)[1] == "x" and time.time() - at < 20


def test_notebook_heads_and_pictures(spark):
    cell = lambda s, **k: {"cell_type": "markdown", "source": s} | k
    pic = base64.b64encode(png(100, 90)).decode()
    out = lambda data: {"output_type": "display_data", "data": data}
    code = {"cell_type": "code", "source": "x", "outputs": [out({"image/png": [pic[:20] + "\n", pic[20:]]}), out({"image/png": base64.b64encode(png(79, 200)).decode()}), out({"image/jpeg": base64.b64encode(b"odd").decode()}), {"output_type": "stream", "text": "no"}]}
    books = [("a/one.ipynb", [cell("---\ntitle: 'Named'\nauthors: Ann\n---\n"), cell("# Big\nx"), code]), ("a/two.ipynb", [cell("# Big\ntext")]), ("a/three.ipynb", [cell("words"), cell("## Part\nbody"), cell("# Late\ny")]), ("a/my_note-book.ipynb", [cell("no header")])]
    d = spark.createDataFrame([(i, json.dumps({"cells": c})) for i, c in books], "doc_id string, text string")
    assert {r["doc_id"]: (r["title"], r["authors"]) for r in readers.notebook_heads(d).collect()} == {"a/one.ipynb": ("Named", "Ann"), "a/two.ipynb": ("Big", ""), "a/three.ipynb": ("Part", ""), "a/my_note-book.ipynb": ("My Note Book", "")}
    assert [(r["figure_id"], r["kind"], r["width"], r["height"]) for r in readers.notebook_pictures(d).orderBy("figure_id").collect()] == [("fig_1", "png", 100, 90), ("fig_2", "jpg", None, None)]


def test_every_kind_of_file(spark, tmp_path):
    (tmp_path / "a.html").write_text("<article><h2>Results</h2><p>We found it.</p></article>")
    talk = " ".join(f"word{i}" for i in range(60))
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n" + "\n\n".join(f"00:0{m}:00.000 --> 00:0{m}:30.000\n{talk} {m}." for m in range(5)))
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.md").write_text(" \n")
    got = {}
    for r in readers.parse(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"].rpartition("/")[2], []).append((r["title"], r["section_type"]))
    assert got["a.html"] == [("Results", "results")] and {t for t, _ in got["b.vtt"]} > {"Introduction"} and got["c.xyz"] == [("no reader for xyz", "error")]
    assert got["d.docx"] == [("no sections", "error")] and got["e.md"] == [("no sections", "error")]
    assert readers.parse(spark, str(tmp_path), errors=False).where("section_type = 'error'").count() == 0


def test_pages_of_the_table(spark, sf_dir):
    p = pages.to_markdown(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")
    s = sections.split_headers(p.select("doc_id", "text"))
    assert p.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and s.where("word_count > 0").count() > 0
    assert p.where("text like '%<p>%' or text like '%track(%' or text like '%&middot;%'").count() == 0


