"""Readers, stages, the model seam, JSON repair, streaming."""

import json
import zipfile

import pytest
from gleanery.functions import jsonrepair
from gleanery.operators import models
from gleanery.sources import readers as R
from gleanery.sources.stages import Stages, free_name
from gleanery.streaming import sessions
from pyspark.sql import functions as F

MD = """---
title: "A Title"
authors: [Ann Lee, 'Bo']
---
before
# Introduction
![fig](a.png) text one
## 2. Method

| a | b |
|---|---|
| 1 | 2 |

# Empty

# Results
done
"""


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_markdown(spark, tmp_path):
    (tmp_path / "x.md").write_text(MD)
    (tmp_path / "y.pdf").write_text("no")
    head, secs = R.read_markdown(spark, str(tmp_path))
    h = head.collect()
    assert len(h) == 1 and h[0]["title"] == "A Title" and h[0]["authors"] == ["Ann Lee", "Bo"] and h[0]["figures"][0]["path"] == "a.png" and h[0]["tables"][0].startswith("| a | b |")
    got = [(r["section_id"], r["title"], r["section_type"], r["level"]) for r in secs.orderBy("ord").collect()]
    assert got == [("section_1", "Introduction", "introduction", 1), ("section_2", "2. Method", "methods", 2), ("section_4", "Results", "results", 1)]


def test_notebook(spark):
    nb = {"cells": [{"cell_type": "markdown", "source": ["# Intro\n", "Some words."]}, {"cell_type": "code", "source": "# this comment has quite enough words here\nx = 1", "outputs": [{"output_type": "stream", "text": ["out ", "text"]}]},
                    {"cell_type": "markdown", "source": "## Results\nFine."}]}
    old = {"worksheets": [{"cells": [{"cell_type": "markdown", "source": "# Old\nbody"}]}]}
    got = [(r["doc_id"], r["title"], r["content"]) for r in R.notebook_sections(docs(spark, json.dumps(nb), json.dumps(old))).orderBy("doc_id", "ord").collect()]
    assert got == [("0", "Intro", "Some words.\n\nthis comment has quite enough words here\nout text"), ("0", "Results", "Fine."), ("1", "Old", "body")]


def test_latex(spark):
    tex = r"""\title{On \textbf{X}} \author{Ann Lee \and Bo Ray\thanks{x}}
\begin{document}\begin{abstract}Short.\end{abstract}
\section{Introduction} Hello\cite{a} 50\% % comment \section{No}
\subsection{Deep {nested}} \emph{world}
\end{document}"""
    h = R.latex_head(docs(spark, tex)).first()
    assert h["title"] == "On X" and h["authors"] == ["Ann Lee", "Bo Ray"] and h["abstract"] == "Short."
    got = [(r["title"], r["level"], r["content"]) for r in R.latex_sections(docs(spark, tex)).orderBy("ord").collect()]
    assert got == [("Introduction", 1, "Hello 50%"), ("Deep nested", 2, "world")]
    files = spark.createDataFrame([("a", "A \\input{b}"), ("b.tex", "B")], "name string, text string")
    assert R.inline_includes(files, docs(spark, "x \\input{a} y \\include{none} z")).first()["text"] == "x A B y  z"
    t = docs(spark, r"\hline a & b \\ \hline 1 \\ ").select(R.tabular(F.col("text")).alias("t")).first()["t"]
    assert t == "| a | b |\n|---|---|\n| 1 |  |"


def test_vtt(spark, tmp_path):
    (tmp_path / "v.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:03.500\nHello <b>there</b>\n\n00:04.000 --> 00:05.000\n[noise] again\n\n00:06.000 --> 00:07.000\nagain\n")
    got = [(r["seg_no"], r["start"], r["duration"], r["text"]) for r in R.read_vtt(spark, str(tmp_path)).orderBy("seg_no").collect()]
    assert got == [(1, 1.0, 2.5, "Hello there"), (2, 4.0, 1.0, "again")]


def test_office(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{s and f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>"}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("lost") + p("Results", "Heading1") + p("text") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    blocks = R.read_binary(spark, str(tmp_path), "docx")
    assert blocks.where("kind = 'error'").count() == 1
    s = R.block_sections(blocks).collect()
    assert [(r["title"], r["section_type"], r["content"]) for r in s] == [("Results", "results", "text\n\n| a | b |\n|---|---|\n| 1 | 2 |")]


def test_stages(spark, tmp_path):
    runs = []

    def make():
        runs.append(1)
        return spark.range(3)

    st = Stages(spark, f"file://{tmp_path}", "input-a", ["parse", "plan"])
    assert st.run("parse", make).count() == 3 and st.run("parse", make).count() == 3 and len(runs) == 1
    assert not Stages(spark, f"file://{tmp_path}", "input-b", ["parse"]).done("parse")
    st.clear("parse")
    assert not st.done("parse")


@pytest.mark.parametrize("text,want", [('```json\n{"a": 1}\n```', {"a": 1}), ('x {"a": [1, 2,], } y', {"a": [1, 2]}), ('{"a": "b', {"a": "b"}), ('{"a": 1, "b": {"c": [1, {"d"', {"a": 1, "b": {"c": [1, {}]}}), ("none", None), (None, None)])
def test_repair(text, want):
    got = jsonrepair.repaired(text)
    if want is None:
        assert got is None
    else:
        assert json.loads(got).items() >= {k: v for k, v in want.items() if k == "a"}.items()


def test_model_seam(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, text string")
    reqs = models.requests(df, F.concat(F.lit("ask "), "text"), "demo", ["k"])
    assert reqs.count() == 2
    out = models.call(reqs, lambda: (lambda prompt: '{"v": "' + prompt[-1] + '"'))
    got = {r["k"]: r["value"]["v"] for r in models.parsed(reqs, out, "v string").collect()}
    assert got == {1: "p", 2: "p", 3: "q"}

    def failing():
        def ask(prompt):
            raise TimeoutError("slow")
        return ask

    bad = models.call(reqs, failing, attempts=2, wait=0.0)
    assert {r["error"] for r in bad.collect()} == {"slow"}
    assert models.call(reqs, failing, known=out.select("request_id", "response", "error")).where("error is not null").count() == 0


def test_stream(spark, sf_dir, tmp_path):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    q = sessions.event_sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = sessions.event_sessions(ev)
    assert 0 < spark.table("sess").count() <= batch.count()


def test_parse_all_formats(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\nfirst words\n# Two\nsecond")
    (tmp_path / "b.tex").write_text("\\begin{document}\\section{Method}We do.\\end{document}")
    (tmp_path / "c.pdf").write_bytes(b"any")
    (tmp_path / "d.bin").write_bytes(b"other")
    got = R.parse(spark, str(tmp_path), {"pdf": lambda data: [("heading", 1, "Results"), ("paragraph", 0, data.decode())]})
    assert got.columns == R.SECTION
    rows = {(r["doc_id"].rsplit("/", 1)[1], r["title"], r["content"]) for r in got.collect()}
    assert rows == {("a.md", "One", "first words"), ("a.md", "Two", "second"), ("b.tex", "Method", "We do."), ("c.pdf", "Results", "any"), ("d.bin", "no reader for bin", "")}


def test_plain_head(spark):
    texts = [("\n# A Title \nAda Lovelace1, Alan Turing* and Bo\nx", ""), ("x" * 200, ""), (None, None), ("a\n" * 20 + "Ada Lovelace, Alan Turing", "Named")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, t string, n string")
    got = [(r["title"], r["authors"]) for r in df.select("id", R.plain_title(F.col("t"), F.col("n")).alias("title"), R.plain_authors(F.col("t")).alias("authors")).orderBy("id").collect()]
    assert got == [("A Title", ["Ada Lovelace", "Alan Turing"]), ("Untitled Document", []), ("", []), ("Named", [])]


def test_free_name():
    assert free_name("a.pdf", set()) == "a.pdf"
    assert free_name("poster.pdf", {"poster.pdf", "poster1.pdf"}) == "poster2.pdf"
    assert free_name("My_Poster7.html", {"My_Poster7.html"}) == "My_Poster8.html"
    assert free_name("a.b.pdf", {"a.b.pdf", "a.b_1.pdf"}) == "a.b_2.pdf"
    assert free_name("plain", {"plain"}) == "plain_1"
