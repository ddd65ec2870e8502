"""Plans: casual ones, documents without panels, sources of pictures, titles, prose segments."""

from gleanery.operators import plan
from pyspark.sql import functions as F


def test_titles(spark):
    rows = [("Results", "results"), ("results", "results"), ("", "results"), ("RESULTS ", "results"), *[("Key Results", "results")] * 12, (None, "odd"), ("", "odd"), ("overview", "odd")]
    d = spark.createDataFrame([(rows,)], "p array<struct<title:string,category:string>>")
    got = d.select(plan.titles(F.col("p")).alias("t")).first()["t"]

    want, used = [], set()
    for title, category in rows:
        base = plan.TITLE_OF.get(category, "Overview")
        tries = [(title or "").strip() or base, *plan.OTHER_TITLES.get(category, []), base, *(f"{base} {e}" for e in plan.ENDINGS), *(f"{base} {n}" for n in range(2, 99))]
        new = next(t for t in tries if t.lower() not in used)
        used.add(new.lower())
        want.append(new)
    assert got == want


def test_plan_casual_and_empty(spark):
    p = spark.createDataFrame([(1, i, f"s{i}", f"T{i}", 1.0 + i / 100, "standard", "content") for i in range(1, 10)] + [(2, 1, "s1", "Only", 1.0, "standard", "content")], "doc_id int, ord int, section_id string, title string, weight double, mode string, category string")
    heads = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "doc_id int, title string")
    rows = plan.planned(p, heads, casual=True).collect()
    by = {k: sorted((r["panel_no"], r["panel_id"], r["section_id"], r["columns"]) for r in rows if r["doc_id"] == k) for k in (1, 2, 3)}
    assert len(by[1]) == 8 and {s for _, _, s, _ in by[1]} == {None, *(f"s{i}" for i in range(3, 10))} and by[1][0][1:] == ("title", None, 2)
    assert by[2] == [(0, "title", None, 1), (1, "panel_1", "s1", 1)] and by[3] == [(0, "title", None, 0)]
    whole = next(r for r in rows if r["doc_id"] == 2 and r["panel_no"] == 1)
    assert abs(whole["w"] - (48 - 0.4)) < 1e-9 and whole["x"] == 0.2
    n = {r["doc_id"]: r for r in plan.nested(plan.planned(p, heads), ["panel_id", "title"]).collect()}
    assert [len(c) for c in n[1]["columns"]] == [3, 3, 3] and n[3]["columns"] == [] and n[2]["columns"][0][0]["title"] == "Only"
    secs = spark.createDataFrame([(2, "s1", "text")], "doc_id int, section_id string, content string")
    figs = spark.createDataFrame([(1, "s1", "b.png"), (1, "s1", "a.png")], "doc_id int, section_id string, path string")
    made = spark.createDataFrame([(2, "panel_1", "made.png"), (1, "panel_1", "not used")], "doc_id int, panel_id string, path string")
    got = {(r["doc_id"], r["panel_id"]): (r["content"], r["picture"]) for r in plan.with_sources(plan.planned(p, heads), secs, figs, made).collect()}
    assert got[2, "panel_1"] == ("text", "made.png") and got[1, "panel_1"] == (None, "a.png") and got[3, "title"] == (None, None)


def test_segments(spark):
    long = "w " * 60
    secs = spark.createDataFrame([(1, 1, "section_1", "A", "other", long, 60), (1, 2, "section_2", "References", "references", "r", 1), (1, 3, "section_3", "License", "other", "l", 1), (1, 4, "section_4", "B", "other", "few", 1), (2, 1, "section_1", "A", "other", long, 60)],
                                 "doc_id int, ord int, section_id string, title string, section_type string, content string, word_count bigint")
    segs = spark.createDataFrame([(1, i, f" S{i} " if i != 2 else None, "" if i == 3 else f" text {i} ") for i in range(1, 13)] + [(2, i, "S", "t") for i in range(3)], "doc_id int, n int, title string, text string")
    got = [tuple(r) for r in plan.segmented(secs, segs).orderBy("doc_id", "ord").select("doc_id", "section_id", "title", "content").collect()]
    assert [g for g in got if g[0] == 2] == [(2, "section_1", "A", long)]
    first = [g[1:] for g in got if g[0] == 1]
    assert first == [(f"prose_seg_{i}", f"S{i}" if i != 2 else "Section 2", f"text {i}") for i in range(1, 10) if i != 3] + [("section_2", "References", "r"), ("section_4", "B", "few")]
