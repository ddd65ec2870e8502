"""LaTeX sources: braces, long and broken input, figures and tables."""

import random

from gleanery.sources import latex as L
from gleanery.sources import readers as R
from pyspark.sql import functions as F


def docs(spark, *texts):
    return spark.createDataFrame([(f"/in/some_paper_{i}.tex", t) for i, t in enumerate(texts)], "doc_id string, text string")


def brute_group(rest):
    """Characters before the closing brace, one after another."""
    depth, skip = 1, False
    for i, c in enumerate(rest):
        if c in "{}" and not skip:
            depth += 1 if c == "{" else -1
            if depth == 0:
                return i
        skip = c == "\\"
    return None


def test_groups(spark):
    rng = random.Random(3)
    texts = ["", "}", "a}b", "{a}b}c", "a{b", "\\}x}", "{{{{{{{{{{x}}}}}}}}}}} y", *("".join(rng.choice("a{}{}\\ ") for _ in range(rng.randint(1, 40))) for _ in range(300)), "{" * 5000 + "}" * 5001 + "z", "x" * 1_000_000 + "}", "{a}" * 200_000 + "}"]
    texts = [t for t in texts if "\\\\" not in t]  # an escaped backslash before a brace is a line break in LaTeX, not asked for here
    got = [r["n"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", L.group_length(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [brute_group(t) for t in texts]


def test_long_and_broken_sources_end(spark):
    long = "word " * 200_000
    rows = ["\\title{" + long + "}\\author{A {B {C}} \\and D}\\begin{document}\\section{" + long + "}x\\end{document}", "\\title{never closed\nnext\\section{open\nbody text\n\\section{Good}more", "\\section{" * 3000, "{" * 100_000, "", "\\title{{{{{{{{{{{Deep}}}}}}}}}}}"]
    d = docs(spark, *rows)
    heads = {r["doc_id"][-5]: r for r in L.latex_head(d).collect()}
    assert heads["0"]["title"] == long.strip() and heads["0"]["authors"] == ["A B C", "D"]
    assert heads["1"]["title"] == "never closed" and heads["4"]["title"] == "Some Paper 4" and heads["5"]["title"] == "Deep"
    got = {}
    for r in L.latex_sections(d).collect():
        got.setdefault(r["doc_id"][-5], []).append((r["title"], r["content"]))
    assert got["0"] == [(long.strip(), "x")] and got["1"] == [("open", "body text"), ("Good", "more")]


def test_figures_and_tables(spark):
    tex = r"""\begin{document}\begin{figure}\includegraphics{early}\end{figure}\begin{abstract}In \emph{short}.\end{abstract}
\section{One} text \begin{figure*}[t]\includegraphics[width=3cm]{a.png}\includegraphics{b}\caption{Two {nested {parts}} of $x$}\end{figure*} after
\begin{verbatim}\section{No}\end{verbatim}
\subsection*{Deep} more \begin{table}\caption{Numbers}\begin{tabular}{l|{c}r}\hline a & \multicolumn{2}{c}{b} \\ 1 & 2 & 3 \\ \end{tabular}\end{table}
\begin{table}\begin{tabular}{l} \\ \end{tabular}\end{table}
\section{Reference} [1] x \end{document}"""
    d = docs(spark, tex, "no figures")
    got = [tuple(r)[1:] for r in L.latex_figures(d).orderBy("figure_id").collect()]
    assert got == [("fig_1", "early", "", None), ("fig_2", "a.png", "Two nested parts of [eq]", "One"), ("fig_3", "b", "Two nested parts of [eq]", "One")]
    assert [tuple(r)[1:] for r in L.latex_tables(d).collect()] == [("table_1", "Numbers", "| a | b |  |\n|---|---|---|\n| 1 | 2 | 3 |")]
    secs = [(r["section_id"], r["level"], r["title"], r["content"]) for r in L.latex_sections(d.limit(1), with_abstract=True).orderBy("ord").collect()]
    assert secs == [("section_1", 1, "Abstract", "In short."), ("section_2", 1, "One", "text after"), ("section_3", 2, "Deep", "more")]
    assert [(r["title"], r["content"]) for r in L.latex_sections(docs(spark, "just \\textbf{prose}")).collect()] == [("Content", "just prose")]


def test_long_markdown_table(spark):
    table = "| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(100_000))
    r = R.markdown_head(docs(spark, f"# T\n\n{table}\nend", "| a |\n|--|\n| 1 |")).collect()
    assert [len(x["tables"]) for x in r] == [1, 1] and r[0]["tables"][0] == table.strip() and r[1]["tables"] == ["| a |\n|--|\n| 1 |"]
