"""Scalar functions, selection and layout rules on literals."""

from gleanery.functions import colour, vectors
from gleanery.functions import text as T
from gleanery.operators import chunks, layout, selection, transcripts
from pyspark.sql import functions as F


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text(spark):
    lit = lambda f, v, *a: one(spark, f(F.lit(v), *a))
    assert lit(T.section_type, "3.1) Proposed Method") == "methods" and lit(T.section_type, "Our approach to X") == "methods" and lit(T.section_type, "Misc") == "other"
    assert lit(T.answer_letter, " B. yes") == "B" and lit(T.answer_letter, "dunno") == "D"
    assert lit(T.cap_title, "a b c d e f g h i j k l") == "a b c d e f g h i j"
    assert lit(T.cap_authors, "A,B,C,D,E,F,G") == "A, B, C, D, et al."
    assert lit(T.strip_code_fence, "```json\n{}\n```") == "{}" and lit(T.outer_object, 'x {"a":{}} y') == '{"a":{}}'
    assert lit(T.vtt_seconds, "01:02:03.5") == 3723.5 and lit(T.clock, 125.9) == "2:05"
    assert lit(T.clean_speech, "um so so so we we've , you know, done") == "so we've, done"
    assert lit(T.clean_caption, "&amp; [x] >> hi (y)  there") == "hi there"
    assert lit(T.bold_markup, "a < **b**") == "a &lt; <strong>b</strong>"
    assert lit(T.drop_controls, "a\x00b�") == "ab" and lit(T.video_platform, "https://youtu.be/abcdefghijk") == "youtube"
    assert lit(T.source_format, "a/b.IPYNB") == "notebook" and lit(T.source_format, "https://x.org/a.pdf") == "html" and lit(T.source_format, "a.xyz") is None
    assert lit(T.head_middle_tail, " ".join(map(str, range(20))), 10).split("\n\n[...]\n\n") == ["0 1 2 3 4", "9 10", "17 18 19"]
    assert lit(T.clean_latex, r"a~b \% \textbf{c} ``d'' \cite{x}") == 'a b % c "d"'


def test_colour_and_vectors(spark):
    assert one(spark, colour.text_on(F.lit("#F2F2F2"))) == "#1A1A1A" and one(spark, colour.shift(F.lit("#10F0FF"), 20)) == "#24FFFF" and one(spark, colour.is_hex(F.lit("#12345"))) is False
    arr = lambda *x: F.array(*map(F.lit, x))
    assert abs(one(spark, vectors.cosine(arr(1.0, 0.0), arr(1.0, 1.0))) - 2**-0.5) < 1e-6 and one(spark, vectors.cosine(arr(0.0), arr(1.0))) == 0.0
    lp = spark.createDataFrame([("a", -1.0), ("<|image_1|>", -9.0), ("<image>", -9.0), ("b", -3.0)], "t string, lp double")
    assert abs(lp.select(vectors.perplexity_of_logprobs(F.col("t"), F.col("lp")).alias("x")).first()["x"] - 2.718281828**2) < 1e-6


def test_selection(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, selection.keep_titles(arr("Results", "Main results!", "Method", "A method"))) == ["Results", "Method"]
    assert one(spark, selection.unique_titles(arr("A", "a", "B", "A"))) == ["A", "a 2", "B", "A 3"]
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "g int, o int, c int")
    assert [r["o"] for r in selection.prefix_budget(df, ["g"], ["o"], "c", 10).collect()] == [1]
    assert sorted(one(spark, selection.shuffled_options(arr("a", "b", "c"), F.lit("q")))) == ["a", "b", "c"]


def test_pack(spark):
    text = "\n\n".join([" ".join(["w"] * n) for n in (300, 400, 200, 1700, 50)])
    got = one(spark, chunks.pack(F.lit(text)))
    assert [len(c.split()) for c in got] == [700, 200, 850, 850, 50]
    assert one(spark, chunks.pack(F.lit("short text"))) == ["short text"]
    turned = " ".join(["w"] * 500) + "\nHowever we go on " + " ".join(["w"] * 500)
    assert [len(c.split()) for c in one(spark, chunks.pack(F.lit(turned)))] == [500, 504]


def test_layout(spark):
    p = spark.createDataFrame([(1, i, w, m, c) for i, (w, m, c) in enumerate([(1.0, "standard", "content"), (1.0, "standard", "content"), (2.0, "standard", "content"), (1.0, "standard", "results"), (1.0, "side_by_side", "methodology")])], "doc_id int, ord int, weight double, mode string, category string")
    got = {r["ord"]: r["col"] for r in layout.assign_columns(p).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}
    placed = layout.place(layout.assign_columns(p)).groupBy("col").agg(F.sum("h").alias("h"), F.count("*").alias("n")).collect()
    room = 36 - 0.12 - 0.15 - 4.0
    assert all(abs(r["h"] + 0.4 * (r["n"] - 1) - room) < 1e-9 for r in placed)
    flex = layout.clamp_flex(spark.createDataFrame([(1, 0, i, w) for i, w in enumerate([10.0, 1.0, 1.0])], "doc_id int, col int, ord int, weight double")).collect()
    assert max(r["flex"] for r in flex) <= 0.48 * 12 + 1e-9 and abs(sum(r["flex"] for r in flex) - 12) < 1e-9
    fixes = layout.apply_fixes(spark.createDataFrame([(["overflow", "bogus"],), (["good"],), ([],)], "issues array<string>")).collect()
    assert [r["font_scale"] for r in fixes] == [0.95, 1.0, 1.0]


def test_paragraphs(spark):
    rows = [(1, i, "a b c", float(s), 1.0) for i, s in enumerate([0, 1, 2, 10, 11, 12, 13])]
    got = [(r["para"], r["start"], r["segments"], r["words"]) for r in transcripts.paragraphs(spark.createDataFrame(rows, "u int, ord int, text string, start double, duration double"), "u", budget=9).orderBy("para").collect()]
    assert got == [(1, 0.0, 3, 9), (2, 10.0, 3, 9), (3, 13.0, 1, 3)]
