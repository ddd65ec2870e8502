"""Operators on visuals against small cases worked by hand and plain Python."""

import random
import time

from gleanery.operators import visuals
from pyspark.sql import functions as F


def test_relevant_text(spark):
    s = [("a", "Speed of light"), ("b", None), ("c", "speed again"), ("d", "SPEED"), ("e", "x" * 4000)]
    wanted = [("a", "none"), ("b", "nothing met"), ("b", "speed test"), (None, ""), (None, None), ("e", "")]
    df = spark.createDataFrame([(i, s, t, c) for i, (t, c) in enumerate(wanted)], "id int, s array<struct<section_id:string,text:string>>, target string, concept string")
    got = [r["t"] for r in df.select("id", visuals.relevant_text(F.col("s"), F.col("target"), F.col("concept")).alias("t")).orderBy("id").collect()]
    lead = "Speed of light\n\n\n\nspeed again"
    assert got == ["Speed of light", lead, "Speed of light\n\nspeed again", lead, lead, "x" * 3000]


def test_captions_last_one_wins_and_first_figure_takes(spark):
    text = "Figure 1: first\nFig. 2. second \nFIGURE 1: later\nFigure 9: none"
    df = spark.createDataFrame([(1, text, ["f10", "f1", "f2"]), (2, None, ["f1"]), (3, "Figure 1: a", [])], "id int, t string, ids array<string>")
    got = [[tuple(x) for x in r["c"]] for r in df.select("id", visuals.captioned(F.col("t"), F.col("ids")).alias("c")).orderBy("id").collect()]
    assert got == [[("f10", "later"), ("f1", None), ("f2", "second")], [("f1", None)], []]


def test_captions_of_equal_and_null_ids(spark):
    df = spark.createDataFrame([(1, "Figure 1: a\n" * 3 + "fig 2.  b\nFigure 2 : c \nFigure\n3\nd", ["f1", "f2", "f3", "f1", None, "x"])], "id int, t string, ids array<string>")
    out = df.select(visuals.captioned(F.concat("t", F.lit("\n")), F.col("ids")).alias("c"))
    assert [tuple(x) for x in out.first()["c"]] == [("f1", "a"), ("f2", "c"), ("f3", "d"), ("f1", None), (None, None), ("x", None)]


def test_captions_read_a_text_once(spark):
    """Not once for each pair of figures: twenty figures take no 10 times as long as one."""
    text = "\n".join(f"Figure {i % 20}: some words of a caption" for i in range(8000))

    def seconds(n):
        df = spark.createDataFrame([(text, [f"figure_{i}_" for i in range(n)])], "t string, ids array<string>").select(visuals.captioned(F.col("t"), F.col("ids")).alias("c"))
        df.collect()
        start = time.monotonic()
        assert len(df.collect()[0]["c"]) == n
        return time.monotonic() - start

    assert seconds(20) < 10 * seconds(1)


def test_keyframes(spark):
    def brute(frames, distance, most):
        kept = []
        for at, h in frames:
            if all(bin(h ^ k).count("1") > distance for _, k in kept):
                kept.append((at, h))
        return kept if len(kept) <= most else [kept[int(i * (len(kept) / most))] for i in range(most)]

    r = random.Random(4)
    rows = [(i, [(t, r.choice([r.getrandbits(32), 7, 8])) for t in range(r.choice([0, 1, 5, 60]))]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, f array<struct<at:int,hash:bigint>>")
    got = {x["id"]: [tuple(f) for f in x["k"]] for x in df.select("id", visuals.keyframes(F.col("f")).alias("k")).collect()}
    assert got == {i: brute(f, visuals.HASH_DISTANCE, visuals.MOST_FRAMES) for i, f in rows}


def test_points_tweak_and_suggestions(spark):
    df = spark.createDataFrame([(1, "bar", "Accuracy gain", [], "up by 3"), (2, "bar", "Data", [], "up"), (3, "pipeline", "result", [], "up"), (4, "bar", "result", ["a"], "up"), (5, "bar", "result", None, "")],
                               "id int, kind string, concept string, points array<string>, headline string")
    got = [r["p"] for r in df.select("id", visuals.headline_points(F.col("points"), F.col("kind"), F.col("concept"), F.col("headline")).alias("p")).orderBy("id").collect()]
    assert got == [["Key result: up by 3"], [], [], ["a"], None]
    tweak = spark.range(1).select(visuals.prompt_tweak(F.lit("draw"), F.array(F.lit("small"), F.lit("dark")), F.array().cast("array<string>"))).first()[0]
    assert tweak == "draw\n\nQUALITY FIXES:\n- Fix these issues: small; dark\n" + "\n".join(f"- {w}" for w in visuals.WISHES)
    panels = spark.createDataFrame([(1, "s", "T", "results", None, None, None), (1, "t", "", "other", None, None, None), (1, "gone", "T", "dataset", None, None, None), (1, "s", "T", "dataset", "own", "d", "line")],
                                   "doc_id int, section_id string, title string, category string, concept string, description string, kind string")
    secs = spark.createDataFrame([(1, "s", "S", ["b" * 100]), (1, "t", "U", [])], "doc_id int, section_id string, section_title string, bullets array<string>")
    made = {(r["section_id"], r["category"]): (r["concept"], r["description"], r["kind"]) for r in visuals.resolved(panels, secs).collect()}
    assert made == {("s", "results"): ("T", "b" * 90, "comparison"), ("t", "other"): ("U", "Diagram for ", "concept_diagram"), ("gone", "dataset"): (None, None, None), ("s", "dataset"): ("own", "d", "line")}


def test_empty_tables(spark):
    frames = spark.createDataFrame([], "doc_id int, ord int, kind string, text string")
    assert visuals.caption_after(frames).count() == 0
    own = spark.createDataFrame([], "doc_id int, ord int, concept string, description string, kind string")
    assert visuals.suggestions(own, own, "doc_id", F.lit(6)).count() == 0
    fonts = spark.createDataFrame([(1, None, None, None), (2, "one two three four five", 9.0, None), (2, "ONE TWO THREE FOUR FIVE", 20.0, False)], "doc_id int, text string, size double, heading boolean")
    assert {r["doc_id"]: r["body_size"] for r in visuals.body_size(fonts).collect()} == {1: 11.0, 2: 9.0}
