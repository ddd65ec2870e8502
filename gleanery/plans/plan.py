"""Queries of the plan: sections of the Markdown view to panels, columns, titles and a nested row; prose segments in place of sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import plan
from . import fixtures as fx
from .queries import ASSIGN, BOILER_SQL, MD_SECTIONS, PANELS, TYPED, W, md, panels, query


def _list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_BASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plan.TITLE_OF.items()) + " ELSE 'Overview' END"
_OTHERS = "CASE category " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in plan.OTHER_TITLES.items()) + " ELSE [] END"
TITLED = f"""tc AS (SELECT doc_id, ord, {_BASE} AS base, list_concat([title], {_OTHERS}) AS wishes FROM q),
td AS (SELECT doc_id, list({{'ord': ord, 'c': list_concat(wishes, [base], list_transform({_list(plan.ENDINGS)}, lambda e: base || ' ' || e), list_transform(range(2, 100), lambda n: base || ' ' || n))}} ORDER BY ord) AS items FROM tc GROUP BY doc_id),
tf AS (SELECT doc_id, items, 0 AS i, []::VARCHAR[] AS kept FROM td UNION ALL
  SELECT doc_id, items, i + 1, list_append(kept, list_filter(items[i + 1].c, lambda c: NOT list_contains(list_transform(kept, lambda k: lower(k)), lower(c)))[1]) FROM tf WHERE i < len(items)),
tt AS (SELECT doc_id, items[i].ord AS ord, kept[i] AS title FROM tf WHERE i > 0)"""
PLACED = """pn AS (SELECT a.*, tt.title, count(*) OVER (PARTITION BY a.doc_id) AS all_panels, count(*) OVER (PARTITION BY a.doc_id, col) AS n, row_number() OVER (PARTITION BY a.doc_id, col ORDER BY a.ord) - 1 AS row_in_col, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.ord) AS no
  FROM a JOIN tt ON tt.doc_id = a.doc_id AND tt.ord = a.ord),
pr AS (SELECT *, 32.13 - 0.0 AS unused, (36.0 - 0.12 - 0.15 - (36.0 * 0.10 + 0.40)) AS content, (36.0 - 0.12 - 0.15 - (36.0 * 0.10 + 0.40)) - 0.40 * (n - 1) AS room, least(all_panels, 3) AS columns FROM pn),
ph AS (SELECT *, greatest(least(weight / sum(weight) OVER (PARTITION BY doc_id, col) * room, 0.48 * content), 0.10 * content) AS h0 FROM pr),
pl AS (SELECT doc_id, no, title, col, row_in_col, columns, 0.12 + col * ((48.0 - 0.24 - 0.40 * (columns - 1)) / columns + 0.40) AS x, h0 * room / sum(h0) OVER (PARTITION BY doc_id, col) AS h FROM ph),
hd AS (SELECT doc_id, array_to_string((""" + W("text") + """)[1:5], ' ') AS title FROM documents)"""
PLACED = PLACED.replace("32.13 - 0.0 AS unused, ", "")


def poster(spark, d):
    """The plans of the Markdown view's panels; a document's first words are its title."""
    p = panels(spark, d).select("doc_id", "ord", F.concat(F.lit("section_"), F.col("ord").cast("string")).alias("section_id"), "title", "weight", "mode", "category")
    heads = fx.documents(spark, d).select("doc_id", T.first_words(F.col("text"), 5).alias("title"))
    return plan.planned(p, heads)


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS}, {ASSIGN}, {TITLED}, {PLACED},
u AS (SELECT doc_id, 'title' AS panel_id, title, -1 AS col, 0 AS row_in_col, 0.0::DOUBLE AS x, (36.0 * 0.10)::DOUBLE AS h FROM hd UNION ALL SELECT doc_id, 'panel_' || no, title, col, row_in_col, x, h FROM pl)
SELECT u.doc_id, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY col, row_in_col) - 1 AS INTEGER) AS panel_no, panel_id, title, CAST(coalesce(c.columns, 0) AS INTEGER) AS columns, CAST(col AS INTEGER) AS col, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(h AS DOUBLE), 6) AS h
FROM u LEFT JOIN (SELECT doc_id, max(columns) AS columns FROM pl GROUP BY doc_id) c ON c.doc_id = u.doc_id""", ("md",))
def poster_plan(spark, d):
    return poster(spark, d).select("doc_id", F.col("panel_no").cast("int").alias("panel_no"), "panel_id", "title", "columns", "col", F.round("x", 6).alias("x"), F.round("h", 6).alias("h"))


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS}, {ASSIGN}, {TITLED}, {PLACED},
r AS (SELECT doc_id, col, list('panel_' || no || ' ' || title ORDER BY row_in_col) AS ps FROM pl GROUP BY doc_id, col),
n AS (SELECT doc_id, list(ps ORDER BY col) AS cs FROM r GROUP BY doc_id)
SELECT hd.doc_id, hd.title, coalesce(cs, []) AS columns FROM hd LEFT JOIN n ON n.doc_id = hd.doc_id""", ("md",))
def poster_nested(spark, d):
    n = plan.nested(poster(spark, d), ["panel_id", "title"])
    return n.select("doc_id", "title", F.transform("columns", lambda c: F.transform(c, lambda p: F.concat_ws(" ", p["panel_id"], p["title"]))).alias("columns"))


@query(f"""{MD_SECTIONS}, {TYPED},
su AS (SELECT *, len(list_filter({BOILER_SQL}, lambda k: contains(lower(title), k))) = 0 AS plain FROM y),
us AS (SELECT *, section_type NOT IN ('references', 'acknowledgments') AND plain AND word_count > 50 AS usable FROM su),
few AS (SELECT doc_id FROM us GROUP BY doc_id HAVING sum(CAST(usable AS INTEGER)) < 4),
ls AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
sg AS (SELECT doc_id, n AS ord, 'prose_seg_' || n AS section_id, count(*) OVER (PARTITION BY doc_id) AS n_all, len({W('text')}) AS word_count FROM ls QUALIFY n <= 9),
s4 AS (SELECT * FROM (SELECT *, (SELECT count(*) FROM ls l2 WHERE l2.doc_id = sg.doc_id) AS lines FROM sg) WHERE lines >= 4 AND word_count > 0),
gd AS (SELECT doc_id FROM s4 GROUP BY doc_id HAVING count(*) >= 4 AND doc_id IN (SELECT doc_id FROM few)),
un AS (SELECT doc_id, 0 AS part, ord, section_id, word_count FROM s4 WHERE doc_id IN (SELECT doc_id FROM gd) UNION ALL SELECT doc_id, 1, ord, 'section_' || ord, word_count FROM us WHERE NOT usable AND plain AND doc_id IN (SELECT doc_id FROM gd))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, ord) AS BIGINT) AS ord, section_id, CAST(word_count AS BIGINT) AS word_count FROM un
UNION ALL SELECT doc_id, ord, 'section_' || ord, word_count FROM us WHERE doc_id NOT IN (SELECT doc_id FROM gd)""", ("md",))
def prose_replaced(spark, d):
    """Lines stand for the segments that a model would find."""
    s = md(spark, d)
    lines = fx.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("title", F.concat(F.lit("Part "), F.col("n").cast("string")))
    return plan.segmented(s.select("doc_id", "ord", "section_id", "title", "section_type", "content", "word_count"), lines).select("doc_id", "ord", "section_id", "word_count")
