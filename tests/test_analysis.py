"""Analysis, slide, chunk and transcript operators against plain Python."""

import random
import re

from gleanery.functions import scores
from gleanery.operators import analysis, chunks, sections, slides, transcripts
from pyspark.sql import functions as F


def brute_paragraphs(text):
    """Paragraphs one after another; what begins inside a block waits for the next that begins outside."""
    blocks = [m.span() for p in chunks.ATOMIC for m in re.finditer(p, text)]
    out, held, at = [], None, 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        part = text[at : m.start() if m else len(text)]
        joined = part if held is None else held + "\n\n" + part
        if any(a <= at <= b for a, b in blocks):
            held = joined
        else:
            out.append(joined)
            held = None
        at = m.end() if m else at
    return [p.strip() for p in [*out, *([held] if held is not None else [])] if p.strip()]


def test_paragraphs(spark):
    r = random.Random(2)
    texts = ["\n\n".join(r.choice(["plain words", "$$ a", "b $$", "```", "code", "\\begin{equation}", "\\end{equation}", "\\begin{algorithm}", "\\end{algorithm}", " spaced "]) for _ in range(r.randint(1, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate([*texts, "", "one"])), "id int, text string")
    got = [x["p"] for x in df.select("id", chunks.paragraphs(F.col("text")).alias("p")).orderBy("id").collect()]
    assert got == [brute_paragraphs(t) for t in [*texts, "", "one"]]


def test_paragraphs_with_marks_and_overlapping_blocks(spark):
    r = random.Random(5)
    bits = ["words", "$$", "$", "```", "`", "\\begin{equation}", "\\end{equation}", "\\begin{algorithm}", "\\end{algorithm}", "\n\n", "\n \n", "\n", " ", "\x01", "\x01h", "\x01e", "p", "i", "ä"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [x["p"] for x in df.select("id", chunks.paragraphs(F.col("text")).alias("p")).orderBy("id").collect()]
    assert got == [brute_paragraphs(t) for t in texts]


def test_paragraphs_sweep_no_positions(spark):
    """Regular expressions and folds over positions of one expression; each costs a pass over the text, or more than one."""
    text = spark.createDataFrame([("x",)], "t string").select(chunks.paragraphs(F.col("t")).alias("p"))
    plan = text._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "regexp_extract_all(" not in plan


def test_headers_keep_every_character(spark):
    text = "before\n# A\none \x01 two\n# B\nthree"
    got = sections.split_headers(spark.createDataFrame([(1, text), (2, "# Only\nx"), (3, "no header")], "doc_id int, text string")).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"], r["ord"], r["title"], r["content"]) for r in got] == [(1, 1, "A", "one \x01 two"), (1, 2, "B", "three"), (2, 1, "Only", "x"), (3, 1, "Content", "no header")]


def test_answers_with_words_and_numbers(spark):
    items = spark.createDataFrame([(1, "v", "q1", "B", 1), (1, "v", "q2", "C. the words", 2), (1, "v", "q3", "A", 3), (1, "v", "q4", "", 4)], "doc_id int, qtype string, qid string, gold string, idx int")
    answers = spark.createDataFrame([(1, "m", "q1", "B. some words", "x"), (1, "m", "Question 2", "c", "x"), (1, "m", "q3", "NA", "x"), (1, "m", "q4", "", "x")], "doc_id int, model string, qid string, answer string, reference string")
    assert [(r["correct"], r["total"]) for r in scores.quiz_scores(items, answers).collect()] == [(2, 4)]


def test_accepted_points_and_venue(spark):
    df = spark.createDataFrame([("bar", "w " * 20, True, [1.0, 2.0]), ("bar", "w", True, [1.0, 2.0]), ("icon", "w " * 20, True, [1.0, 2.0]), ("line", "w " * 30, False, [1.0, 2.0]), ("line", "w " * 30, True, [1.0])], "k string, s string, f boolean, n array<double>")
    old = F.array(F.lit(9.0))
    assert [r[0] for r in df.select(analysis.accepted_points(F.col("k"), F.col("s"), F.col("f"), F.col("n"), old)).collect()] == [[1.0, 2.0], [9.0], [9.0], [9.0], [9.0]]
    v = spark.createDataFrame([("", "shown at icml 2021."), ("Here", "ICML 2020"), (None, "CORLing 2020")], "a string, b string")
    assert [r[0] for r in v.select(analysis.venue(F.col("a"), F.col("b"))).collect()] == ["icml 2021", "Here", ""]


def test_slides(spark):
    rows = [(1, 0, 1, "Talk", 0, 0, 40, True, False), (1, 1, 1, "Part one", 0, 0, 30, False, False), (1, 2, 1, "Title", 0, 0, 20, True, False), (1, 2, 2, "second", 5, 9, 12, False, True), (1, 2, 3, "first", 1, 5, 12, False, False),
            (1, 3, 1, "Part two", 0, 0, 32, False, False), (1, 4, 1, "Part two", 0, 0, 12, True, False), (1, 4, 2, "body", 0, 5, 12, False, False), (2, 2, 1, "Lone", 0, 0, 12, False, True), (2, 2, 2, "off", -5, 0, 12, False, False)]
    df = spark.createDataFrame(rows, "deck int, slide int, shape_no int, text string, left int, top int, font int, is_title boolean, bullets boolean").withColumn("width", F.lit(200_000)).withColumn("height", F.lit(200_000))
    s = slides.slides(slides.shown(df, 10_000_000, 10_000_000))
    assert [(r["deck"], r["slide"], r["title"], r["kind"]) for r in s.orderBy("deck", "slide").collect()] == [
        (1, 0, "Talk", "title"), (1, 1, "Part one", "content"), (1, 2, "Title", "content"), (1, 3, "Part two", "divider"), (1, 4, "Part two", "content"), (2, 2, "Lone", "content")]
    assert [(r["deck"], r["section_no"], r["title"], r["content"]) for r in slides.sections(s).orderBy("deck", "section_no").collect()] == [(1, 1, "Overview", "## Part one\n\n## Title\nfirst\n- second"), (1, 2, "Part two", "body"), (2, 1, "Lone", "")]
    one = spark.createDataFrame([("A B, Charles Dickens",), ("no names here",), ("word " * 21 + "Ab Cd",)], "t string")
    assert [r[0] for r in one.select(slides.looks_like_authors(F.col("t"))).collect()] == [True, False, False]
    assert spark.range(1).select(slides.hidden(F.array(F.array(F.lit(250), F.lit(250), F.lit(250))), F.array(F.lit(255), F.lit(255), F.lit(255)))).first()[0]


def test_abstract(spark):
    s = spark.createDataFrame([(1, 1, "methods", "w " * 50), (1, 2, "methods", "short"), (2, 1, "methods", "w " * 50), (3, 1, "results", "few")], "video int, n int, label string, content string")
    m = transcripts.merge_short(s, "video", "n")
    d = spark.createDataFrame([(1, "d " * 25), (2, "d"), (3, "d " * 30)], "video int, description string")
    got = transcripts.with_abstract(m, d, "video").orderBy("video", "section_no").collect()
    assert [(r["video"], r["section_no"], r["title"], r["word_count"]) for r in got] == [(1, 1, "Abstract", 25), (1, 2, "Method", 51), (2, 1, "Method", 50)]
