"""Queries of the office operators over fixtures that the tables give: lines as paragraphs whose two runs carry fonts, and quantities as chart points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import headings
from . import fixtures as fx
from .queries import W, query

STYLES = ["Normal", "Heading 2", "heading 1", "Title", "List"]
_STYLES_SQL = "[" + ", ".join(f"'{s}'" for s in STYLES) + "]"


def runs_fixture(spark, d):
    """Lines as paragraphs of two runs (the first four words and the rest). Of every five documents two have styled headings; sizes and bold follow line and id."""
    i, k = F.col("block"), F.col("doc_id")
    lines = fx.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("block"), "line")
    ws = T.words(F.col("line"))
    title = (i + k) % 4 == 0
    text = F.when(title & (k % 3 == 0), F.upper(F.replace(F.array_join(F.slice(ws, 1, 5), " "), F.lit("ß"), F.lit("ss")))).when(title, F.array_join(F.slice(ws, 1, 6), " ")).otherwise(F.array_join(ws, " "))
    style = F.when((k % 5 < 2) & title, F.element_at(F.array(*map(F.lit, STYLES)), (i % 3 + 1).cast("int"))).otherwise("Normal")
    size = F.when(title, 12 + (i % 3) * 2).otherwise(10 + k % 2).cast("double")
    run = lambda words, s: F.struct(F.array_join(words, " ").alias("text"), (title & (i % 7 != 0)).alias("bold"), s.alias("size"))
    parts = lines.withColumn("text", text).withColumn("style", style).withColumn("size", size)
    pw = T.words(F.col("text"))
    runs = F.array(run(F.slice(pw, 1, 4), F.col("size")), run(F.slice(pw, F.lit(5), F.greatest(F.size(pw) - 4, F.lit(0))), F.col("size") + 1))
    return parts.select("doc_id", "block", "style", ((i + k) % 8 == 0).alias("bullet"), "text", runs.alias("runs"))


HEADINGS = rf"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS block, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
a AS (SELECT doc_id, block, {W('line')} AS ws, (block + doc_id) % 4 = 0 AS t FROM l),
b AS (SELECT doc_id, block, t, CASE WHEN t AND doc_id % 3 = 0 THEN upper(replace(array_to_string(ws[1:5], ' '), 'ß', 'ss')) WHEN t THEN array_to_string(ws[1:6], ' ') ELSE array_to_string(ws, ' ') END AS text,
  CASE WHEN doc_id % 5 < 2 AND t THEN ({_STYLES_SQL})[block % 3 + 1] ELSE 'Normal' END AS style, CAST(CASE WHEN t THEN 12 + block % 3 * 2 ELSE 10 + doc_id % 2 END AS DOUBLE) AS low, (block + doc_id) % 8 = 0 AS bullet, t AND block % 7 <> 0 AS bold FROM a),
c AS (SELECT *, lower(style) LIKE 'heading%' AS styled, CASE WHEN text = '' THEN NULL WHEN len({W('text')}) > 4 THEN low + 1 ELSE low END AS size, upper(text) = text AND NOT contains(text, 'ß') AND regexp_matches(text, '\pL') AS caps, len({W('text')}) AS n FROM b),
m AS (SELECT doc_id, list_sort(list(size) FILTER (WHERE n >= 5 AND NOT styled AND NOT caps AND size > 0)) AS s FROM c GROUP BY doc_id),
e AS (SELECT c.*, coalesce(s[len(s) // 2 + 1], 11.0) AS body, sum(CAST(styled AS INTEGER)) OVER (PARTITION BY c.doc_id) AS styles FROM c JOIN m ON m.doc_id = c.doc_id),
f AS (SELECT *, text <> '' AND NOT bullet AND ((caps AND n <= 8) OR (bold AND coalesce(size >= body + 1, false))) AS looks FROM e),
g AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY CASE WHEN looks THEN coalesce(size, body) END DESC NULLS LAST) AS r FROM f),
h AS (SELECT *, CASE WHEN styles >= 2 THEN CASE WHEN styled THEN CAST(right(style, 1) AS INTEGER) END WHEN looks THEN CAST(r AS INTEGER) END AS level FROM g)"""


@query(HEADINGS + " SELECT doc_id, block, level, text FROM h WHERE level IS NOT NULL")
def font_headings(spark, d):
    return headings.headings(runs_fixture(spark, d)).where("level is not null").select("doc_id", "block", "level", "text")


@query(HEADINGS + f""", o AS (SELECT *, sum(CAST(level IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY block) AS no FROM h),
p AS (SELECT doc_id, no, max(CASE WHEN level IS NOT NULL THEN text END) AS title, coalesce(string_agg(text, chr(10) ORDER BY block) FILTER (WHERE level IS NULL AND text <> ''), '') AS content FROM o GROUP BY doc_id, no),
w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block) AS content FROM h WHERE text <> '' GROUP BY doc_id),
s AS (SELECT doc_id, no, CASE WHEN title = '' THEN 'Section ' || no ELSE title END AS title, content FROM p WHERE no > 0 AND content <> ''),
u AS (SELECT * FROM s UNION ALL SELECT doc_id, 1, 'Content', content FROM w WHERE doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id, CAST(no AS INTEGER) AS ord, title, md5(content) AS digest, CAST(len({W('content')}) AS BIGINT) AS word_count FROM u""")
def font_sections(spark, d):
    return headings.sections(headings.outline(runs_fixture(spark, d))).select("doc_id", "ord", "title", F.md5("content").alias("digest"), "word_count")
