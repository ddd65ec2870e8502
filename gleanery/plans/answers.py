"""Queries of model answers: answers with planted faults are made from the documents, one each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from . import fixtures as fx
from .queries import W, query

# Planted forms of the fields, chosen by the document's id; {lead} is the document's text in letters.
TYPES = ['"prose"', '" Mixed "', "42", "null", '["bullets"]']
BULLETS = ['["first point of all.", 7, null, {"a": 1}, "{lead}", "third", "fourth", "fifth"]', '"no list"', "{}", '["one two three four five six seven eight nine ten eleven..", "", "b"]']
TITLES = ['"A Title Of Many Words"', "5", "null"]
HEADERS = ['[{"after_bullet_index": 0, "text": "one two three four five six seven"}, {"after_bullet_index": "1", "text": " x "}, {"after_bullet_index": 9, "text": "far"}, "no object", {"text": "no place"}]', '{"text": 1}', '[{"after_bullet_index": 1.0, "text": ""}, {"after_bullet_index": -1, "text": "y"}]']
SOURCES = ['[{"source_chunk_id": "chunk_1", "source_text_span": "span"}, {"source_chunk_id": 3}, []]', "null"]
FIGURES = ['["fig_2", "fig_1", 3, "fig_2"]', '"fig_9"']
SHAPE = [("content_type", TYPES), ("lead_paragraph", ['"{lead}"']), ("bullets", BULLETS), ("poster_section_title", TITLES), ("sub_headers", HEADERS), ("provenance", SOURCES), ("recommended_figure_ids", FIGURES), ("key_message", ['"key"', "[]"])]


def answer_fixture(spark, d):
    k = F.col("doc_id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    body = F.concat(*[x for name, forms in SHAPE for x in (F.lit(f'"{name}": '), pick(forms), F.lit(", "))], F.lit('"end": 1'))
    lead = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    made = F.replace(body, F.lit("{lead}"), F.col("lead"))
    said = F.when(k % 11 == 5, "no object at all").when(k % 7 == 3, F.concat(F.lit("{"), made)).when(k % 3 == 1, F.concat(F.lit("Here:\n```json\n{"), made, F.lit("}\n```"))).otherwise(F.concat(F.lit("{"), made, F.lit("}")))
    docs = fx.documents(spark, d).withColumn("lead", lead)
    return docs.select("doc_id", F.lit("section_1").alias("section_id"), F.lit("Own Title").alias("title"), (1 + (k % 4) / 10).alias("importance"), F.array(F.lit("fig_7")).alias("figure_ids"), said.alias("response"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


_BODY = " || ".join(f"""'"{name}": ' || replace(({_sql_list(forms)})[doc_id % {len(forms)} + 1], '{{lead}}', lead) || ', '""" for name, forms in SHAPE)
_LIST = "CASE WHEN json_type(a, '$.{0}') = 'ARRAY' THEN json_extract(a, '$.{0}[*]') ELSE [] END".format
_BARE = W(r"regexp_replace(trim(b), '\.+$', '')")
_TEXTS = "list_transform(list_filter({0}, lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$')".format
SECTION_ANSWERS = rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS lead FROM documents),
j AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN NULL ELSE CAST('{{' || {_BODY} || '"end": 1}}' AS JSON) END AS a FROM t),
c AS (SELECT doc_id, a, CASE WHEN json_type(a, '$.content_type') = 'VARCHAR' AND lower(trim(a ->> '$.content_type')) IN ('prose', 'bullets', 'mixed') THEN lower(trim(a ->> '$.content_type')) ELSE 'bullets' END AS content_type,
  CASE WHEN json_type(a, '$.lead_paragraph') = 'VARCHAR' THEN trim(a ->> '$.lead_paragraph') ELSE '' END AS lead_paragraph, {_TEXTS(_LIST('bullets'))} AS raw FROM j),
b AS (SELECT *, (list_filter(list_transform(raw, lambda b: array_to_string(({_BARE})[1:10], ' ')), lambda b: b <> ''))[1:CASE content_type WHEN 'prose' THEN 2 WHEN 'mixed' THEN 3 ELSE CASE WHEN 1 + (doc_id % 4) / 10 >= 1.3 THEN 4 ELSE 3 END END] AS bullets FROM c),
h AS (SELECT *, list_filter(list_transform(list_filter({_LIST('sub_headers')}, lambda x: json_type(x) = 'OBJECT'), lambda x: {{'i': TRY_CAST(TRY_CAST(x ->> '$.after_bullet_index' AS DOUBLE) AS INTEGER),
    't': CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN array_to_string(({W("(x ->> '$.text')")})[1:6], ' ') ELSE '' END}}), lambda s: s.t <> '' AND s.i >= 0 AND s.i < len(bullets)) AS heads FROM b)
SELECT doc_id, content_type, md5(lead_paragraph) AS lead_digest, array_to_string(bullets, '|') AS bullets, array_to_string(list_transform(heads, lambda s: s.i || ':' || s.t), '|') AS sub_headers,
  array_to_string(list_transform(list_filter({_LIST('provenance')}, lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(CASE WHEN json_type(x, '$.source_chunk_id') = 'VARCHAR' THEN x ->> '$.source_chunk_id' END, '-') || ':' || CASE WHEN json_type(x, '$.source_text_span') = 'VARCHAR' THEN x ->> '$.source_text_span' ELSE '' END), '|') AS provenance,
  CASE WHEN json_type(a, '$.poster_section_title') = 'VARCHAR' THEN array_to_string(({W("(a ->> '$.poster_section_title')")})[1:4], ' ') ELSE 'Own Title' END AS panel_title,
  array_to_string(list_sort(list_distinct(list_append({_TEXTS(_LIST('recommended_figure_ids'))}, 'fig_7'))), '|') AS figure_ids, CASE WHEN json_type(a, '$.key_message') = 'VARCHAR' THEN a ->> '$.key_message' ELSE '' END AS key_message FROM h"""


@query(SECTION_ANSWERS)
def section_answer_fields(spark, d):
    """Answers with planted faults, some cut off, fenced or no object at all, as fields."""
    a = answers.section_answers(answers.variant_of(answer_fixture(spark, d)))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return a.select("doc_id", "content_type", F.md5("lead_paragraph").alias("lead_digest"), F.array_join("bullets", "|").alias("bullets"),
                    joined("sub_headers", lambda s: F.concat(s["after_bullet_index"].cast("string"), F.lit(":"), s["text"])).alias("sub_headers"),
                    joined("provenance", lambda p: F.concat(F.coalesce(p["source_chunk_id"], F.lit("-")), F.lit(":"), p["source_text_span"])).alias("provenance"),
                    "panel_title", F.array_join("figure_ids", "|").alias("figure_ids"), "key_message")
