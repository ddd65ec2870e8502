"""Model answers as VARIANT: faults cost a field, not the answer."""

import json

from gleanery.operators import analysis, answers


def test_global_answers(spark):
    good = {"poster_title": "T", "authors": ["not", "text"], "summary": 5, "venue": "ICML", "sections_to_include": ["s1", 2, None, "s2"], "section_importance": {"s1": 1.5, "s2": "high", "s3": 2}, "section_categories": {"s1": "results", "s2": "odd", "s3": 7},
            "essential_figure_ids": "fig_1", "visual_suggestions": [{"concept": "C", "visual_type": "table", "data_points": ["a", 1]}, "no", {"visual_type": "pie", "description": None}]}
    rows = [(1, json.dumps(good)), (2, "no json"), (3, None), (4, "[1, 2]"), (5, '{"poster_title": "Cut", "summary": "so'), (6, "")]
    d = answers.variant_of(spark.createDataFrame([(i, r, "Own", "Me") for i, r in rows], "id int, response string, title string, authors string"))
    got = {r["id"]: r for r in answers.global_answers(d).drop("answer").collect()}
    a = got[1]
    assert (a["poster_title"], a["poster_authors"], a["summary"], a["venue"], a["color_theme"]) == ("T", "Me", "", "ICML", "paper_clean")
    assert a["sections_to_include"] == ["s1", "s2"] and a["section_importance"] == {"s1": 1.5, "s3": 2.0} and a["section_categories"] == {"s1": "results", "s2": "content", "s3": "content"} and a["essential_figure_ids"] == []
    assert [tuple(v) for v in a["visual_suggestions"]] == [("C", "", "table", ["a"]), ("", "", "concept_diagram", [])]
    for i in (2, 3, 4, 6):
        assert got[i]["poster_title"] == "Own" and got[i]["sections_to_include"] == [] and got[i]["visual_suggestions"] == []
    assert got[5]["poster_title"] == "Cut" and got[5]["summary"] == "so"


def test_section_answers_of_nothing(spark):
    d = spark.createDataFrame([(1, "s1", "Own Title Of Five Words", 1.0, None, None)], "id int, section_id string, title string, importance double, figure_ids array<string>, response string")
    r = answers.section_answers(answers.variant_of(d)).drop("answer").first()
    assert (r["content_type"], r["bullets"], r["sub_headers"], r["provenance"], r["figure_ids"], r["panel_title"]) == ("bullets", [], [], [], [], "Own Title Of Five")


def test_merged_carries_provenance(spark):
    d = spark.createDataFrame([(1, 2, "", "m", ["b"], ["f"], [("c2", "y")]), (1, 1, "t", "", ["B "], None, [("c1", "x")]), (1, 3, None, None, None, None, None)],
                              "s int, n int, title string, key_message string, bullets array<string>, figures array<string>, provenance array<struct<c:string,t:string>>")
    r = analysis.merged(d, ["s"], "n").first()
    assert (r["title"], r["key_message"], r["bullets"], r["figures"], [tuple(p) for p in r["provenance"]]) == ("t", "m", ["B"], ["f"], [("c1", "x"), ("c2", "y")])
