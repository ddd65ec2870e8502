"""Driver queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour, scores, vectors
from ..functions import text as T
from ..operators import chunks, layout, sections, selection, transcripts
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
W = fx.WORDS.format
TYPE_SQL = "[" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in T.SECTION_TYPES) + "]"
BOILER_SQL = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in T.BOILERPLATE) + "]"


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            more = ", " if not sql.startswith("SELECT") else " "
            SQL[f.__name__] = f"WITH RECURSIVE {', '.join(fx.VIEWS[v] for v in views)}{more}{sql}" if views else sql
        return f

    return register


# Text

@query(f"SELECT doc_id, CAST(len({W('text')}) AS BIGINT) AS words FROM documents")
def doc_word_counts(spark, d):
    return fx.documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\pL\pM\pN_]+')) AS BIGINT) AS words FROM documents")
def doc_regex_word_counts(spark, d):
    return fx.documents(spark, d).select("doc_id", T.regex_word_count(F.col("text")).alias("words"))


@query(f"SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len({W('text')})) AS BIGINT) AS words FROM documents GROUP BY lang, source")
def corpus_totals_by_lang_source(spark, d):
    return fx.documents(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query(f"""SELECT lang, source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len({W('text')})) AS BIGINT) AS words FROM documents GROUP BY ROLLUP (lang, source)""")
def corpus_totals_rollup(spark, d):
    return fx.documents(spark, d).rollup("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.word_count(F.col("text"))).alias("words"))


@query(f"""SELECT doc_id, CASE WHEN len(w) <= 200 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:100], ' ') || chr(10) || chr(10) || '[...]' || chr(10) || chr(10)
  || array_to_string(w[((len(w) - 40) // 2) + 1:((len(w) - 40) // 2) + 40], ' ') || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || array_to_string(w[len(w) - 59:len(w)], ' ') END AS sample
FROM (SELECT doc_id, {W('text')} AS w FROM documents)""")
def head_mid_tail_sample(spark, d):
    return fx.documents(spark, d).select("doc_id", T.head_middle_tail(F.col("text"), 200).alias("sample"))


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(lower(trim(text)), '[^\pL\pM\pN_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM documents""")
def slugify(spark, d):
    return fx.documents(spark, d).select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: array_to_string((list_filter(regexp_split_to_array(regexp_replace(trim(l), '\.+$', ''), '\s+'), lambda x: x <> ''))[1:10], ' ')),
  lambda b: b <> '')[1:3] AS bullets FROM documents""")
def bullet_caps(spark, d):
    return fx.documents(spark, d).select("doc_id", T.cap_bullets(F.split("text", "\n"), 3).alias("bullets"))


@query(f"""SELECT doc_id, CASE WHEN length(t) > 72 THEN rtrim(substr(t, 1, 69)) || '...' ELSE t END AS title FROM (SELECT doc_id, array_to_string(({W("string_split(text, chr(10))[1]")})[1:10], ' ') AS t FROM documents)""")
def title_caps(spark, d):
    return fx.documents(spark, d).select("doc_id", T.cap_title(F.split("text", "\n")[0]).alias("title"))


@query("""SELECT doc_id, CASE WHEN len(p) > 6 OR length(array_to_string(p, ', ')) > 90 THEN array_to_string(p[1:4], ', ') || ', et al.' ELSE array_to_string(p, ', ') END AS authors
FROM (SELECT doc_id, list_filter(list_transform(string_split(string_split(text, chr(10))[1], ','), lambda a: trim(a)), lambda a: a <> '') AS p FROM documents)""")
def author_caps(spark, d):
    return fx.documents(spark, d).select("doc_id", T.cap_authors(F.split("text", "\n")[0]).alias("authors"))


@query(r"""SELECT doc_id, CAST(len(n) AS BIGINT) AS numbers, CASE WHEN len(list_filter(n, lambda x: x > 0)) >= 2 THEN round(list_max(list_filter(n, lambda x: x > 0)) / list_min(list_filter(n, lambda x: x > 0)), 6) END AS ratio
FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]{1,9}'), lambda x: CAST(x AS DOUBLE)) AS n FROM documents)""")
def data_points_ratio(spark, d):
    n = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{1,9}"), F.lit(0)), lambda x: x.cast("double"))
    return fx.documents(spark, d).select("doc_id", n.alias("n")).select("doc_id", F.size("n").cast("long").alias("numbers"), F.round(T.ratio(F.col("n")), 6).alias("ratio"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM documents""")
def escape_text(spark, d):
    return fx.documents(spark, d).select("doc_id", T.escape_html(F.col("text")).alias("html"))


# Sections

MD_SECTIONS = r"""x AS (SELECT doc_id, i AS ord, parts[i + 1] AS p FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,6}[ \t]+\S.*)$', chr(1) || '\1', 'g'), chr(1)) AS parts FROM md))),
s AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, trim(regexp_extract(p, '^(#+)[ \t]+([^\n]*)', 2)) AS title, regexp_replace(regexp_replace(regexp_replace(p, '^[^\n]*', ''), '^\s+', ''), '\s+$', '') AS content FROM x)"""
TYPED = f"""t AS (SELECT *, trim(regexp_replace(lower(trim(title)), '^[0-9.\\-) ]+', '')) AS c FROM s WHERE content <> ''),
y AS (SELECT doc_id, ord, title, content, coalesce(list_filter({TYPE_SQL}, lambda k: k.k = c)[1].v, list_filter({TYPE_SQL}, lambda k: contains(c, k.k))[1].v, 'other') AS section_type, CAST(len({W('content')}) AS BIGINT) AS word_count FROM t)"""
USABLE = f"section_type NOT IN ('references', 'acknowledgments') AND len(list_filter({BOILER_SQL}, lambda k: contains(lower(trim(title)), k))) = 0 AND word_count > 50"


def md(spark, d) -> DataFrame:
    return sections.split_headers(fx.markdown(fx.documents(spark, d)))


@query(MD_SECTIONS + " SELECT doc_id, ord, title, content FROM s WHERE content <> ''", ("md",))
def md_sections(spark, d):
    return md(spark, d).select("doc_id", "ord", "title", "content")


@query(f"{MD_SECTIONS}, {TYPED} SELECT doc_id, ord, section_type, word_count FROM y", ("md",))
def section_types(spark, d):
    return md(spark, d).select("doc_id", "ord", "section_type", "word_count")


@query(f"{MD_SECTIONS}, {TYPED} SELECT doc_id, ord, title FROM y WHERE {USABLE}", ("md",))
def usable_sections(spark, d):
    return sections.usable(md(spark, d)).select("doc_id", "ord", "title")


@query(f"""{MD_SECTIONS}, {TYPED} SELECT doc_id, CAST(count(*) AS BIGINT) AS sections, CAST(least(greatest(CASE WHEN count(*) <= 5 THEN 7 WHEN count(*) <= 8 THEN 8 ELSE 9 END, 5), 9) AS INTEGER) AS panels
FROM y WHERE section_type NOT IN ('references', 'acknowledgments') AND word_count > 100 GROUP BY doc_id""", ("md",))
def panel_target(spark, d):
    n = sections.meaningful(md(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))
    return n.withColumn("panels", sections.panel_target(F.col("sections")))


@query(f"""{MD_SECTIONS}, {TYPED} SELECT doc_id, string_agg(chr(10) || '## ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY ord) AS full_text FROM y WHERE section_type <> 'references' GROUP BY doc_id""", ("md",))
def full_text_assembly(spark, d):
    return sections.full_text(md(spark, d))


@query(f"""{MD_SECTIONS}, {TYPED} SELECT doc_id, ord, title AS concept, CASE section_type WHEN 'methods' THEN 'pipeline' WHEN 'experiments' THEN 'bar_chart' WHEN 'results' THEN 'comparison' ELSE 'concept_diagram' END AS visual_type,
CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS place FROM y WHERE section_type NOT IN ('references', 'acknowledgments') QUALIFY place <= 4""", ("md",))
def fallback_visuals(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("methods", "pipeline", "experiments", "bar_chart", "results", "comparison")])
    s = md(spark, d).where("section_type not in ('references', 'acknowledgments')")
    s = selection.top_k(s, ["doc_id"], ["ord"], 4)
    return s.select("doc_id", "ord", F.col("title").alias("concept"), F.coalesce(F.element_at(kind, F.col("section_type")), F.lit("concept_diagram")).alias("visual_type"), "place")


@query(f"""{MD_SECTIONS}, {TYPED}, v AS (SELECT doc_id, ord, lower(title) AS concept FROM y QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY ord) = 1)
SELECT doc_id, ord, concept FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) <= 3""", ("md",))
def visual_dedup_topk(spark, d):
    v = selection.first_wins(md(spark, d).withColumn("concept", F.lower("title")), ["doc_id", "concept"], ["ord"])
    return selection.top_k(v, ["doc_id"], ["ord"], 3).select("doc_id", "ord", "concept")


@query(f"""{MD_SECTIONS}, {TYPED}, a AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM y WHERE section_type = 'methods'), b AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY word_count DESC, ord) AS i FROM y WHERE section_type = 'results')
SELECT doc_id, a.ord AS panel, b.ord AS figure FROM a JOIN b USING (doc_id, i)""", ("md",))
def visual_zip_join(spark, d):
    s = md(spark, d)
    a = s.where("section_type = 'methods'").select("doc_id", F.col("ord").alias("panel"))
    b = s.where("section_type = 'results'").select("doc_id", F.col("ord").alias("figure"), "word_count")
    return selection.zip_join(a, b, ["doc_id"], ["panel"], [F.desc("word_count"), "figure"]).select("doc_id", "panel", "figure")


IMPORTANCE = "1.0 + least(word_count / 1500.0, 0.6)"
CATEGORY = "CASE section_type WHEN 'introduction' THEN 'motivation' WHEN 'methods' THEN 'methodology' WHEN 'experiments' THEN 'dataset' WHEN 'results' THEN 'results' WHEN 'discussion' THEN 'analysis' WHEN 'conclusion' THEN 'conclusion' ELSE 'content' END"
PANELS = f"""p AS (SELECT doc_id, ord, title, word_count, {CATEGORY} AS category, CASE WHEN ord % 3 = 0 THEN 'original' WHEN ord % 3 = 1 AND {CATEGORY} NOT IN ('motivation', 'conclusion') THEN 'generated' ELSE 'none' END AS src,
  CASE ord % 4 WHEN 0 THEN 'prose' WHEN 1 THEN 'mixed' ELSE 'bullets' END AS content_type, {IMPORTANCE} AS importance FROM y WHERE word_count > 20),
q AS (SELECT *, round(importance * CASE src WHEN 'original' THEN 1.3 WHEN 'generated' THEN 1.2 ELSE 0.9 END, 6) AS weight, CASE WHEN content_type = 'prose' AND src = 'none' THEN 'prose_only' WHEN content_type = 'prose' THEN 'prose_with_figure'
  WHEN content_type = 'mixed' AND src = 'original' AND category IN ('results', 'analysis') THEN 'figure_dominant' WHEN content_type = 'mixed' AND src <> 'none' AND category IN ('methodology', 'architecture') THEN 'side_by_side'
  WHEN src = 'none' THEN 'bullets_only' ELSE 'standard' END AS mode FROM p)"""


def panels(spark, d) -> DataFrame:
    s = md(spark, d).where("word_count > 20")
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fx.CATEGORY.items() for x in kv]), F.col("section_type")), F.lit("content"))
    s = s.withColumn("category", category).withColumn("content_type", F.when(F.col("ord") % 4 == 0, "prose").when(F.col("ord") % 4 == 1, "mixed").otherwise("bullets"))
    s = s.withColumn("src", layout.visual_source(F.col("ord") % 3 == 0, F.col("ord") % 3 == 1, F.col("category"))).withColumn("importance", layout.importance(F.lit(1.0), F.col("word_count")))
    return s.withColumn("weight", F.round(layout.weight(F.col("importance"), F.col("src")), 6)).withColumn("mode", layout.layout_mode(F.col("content_type"), F.col("src"), F.col("category")))


@query(f"{MD_SECTIONS}, {TYPED}, {PANELS} SELECT doc_id, ord, weight FROM q", ("md",))
def panel_weights(spark, d):
    return panels(spark, d).select("doc_id", "ord", "weight")


@query(f"{MD_SECTIONS}, {TYPED}, {PANELS} SELECT doc_id, ord, category, src, mode FROM q", ("md",))
def layout_modes(spark, d):
    return panels(spark, d).select("doc_id", "ord", "category", "src", "mode")


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS} SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['motivation', 'methodology', 'architecture', 'dataset', 'results', 'analysis', 'conclusion', 'content'], category), ord) AS INTEGER) AS reading_no FROM q""", ("md",))
def reading_order(spark, d):
    return layout.reading_order(panels(spark, d)).select("doc_id", "ord", "reading_no")


ASSIGN = """g AS (SELECT doc_id, list({'ord': ord, 'weight': weight, 'mode': mode, 'category': category} ORDER BY ord) AS items FROM q GROUP BY doc_id),
st AS (SELECT doc_id, items, 0 AS i, [0.0::DOUBLE, 0.0, 0.0] AS load, NULL::INTEGER AS col FROM g UNION ALL
  SELECT doc_id, items, i + 1, list_transform(load, lambda x, k: CASE WHEN k - 1 = c THEN x + items[i + 1].weight ELSE x END), c FROM (
    SELECT doc_id, items, i, load, CASE WHEN i < 3 THEN i WHEN w IS NOT NULL AND load[w + 1] <= list_min(load) * 1.30 THEN w ELSE CAST(list_position(load, list_min(load)) - 1 AS INTEGER) END AS c FROM (
      SELECT *, CASE WHEN items[i + 1].mode IN ('figure_dominant', 'side_by_side') THEN 1 WHEN items[i + 1].category IN ('results', 'analysis') THEN 2 END AS w FROM st WHERE i < len(items)))),
a AS (SELECT doc_id, items[i].ord AS ord, items[i].weight AS weight, CAST(col AS INTEGER) AS col FROM st WHERE i > 0)"""


@query(f"{MD_SECTIONS}, {TYPED}, {PANELS}, {ASSIGN} SELECT doc_id, ord, col FROM a", ("md",))
def column_assign(spark, d):
    return layout.assign_columns(panels(spark, d)).select("doc_id", "ord", "col")


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS}, {ASSIGN}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, col) AS n, row_number() OVER (PARTITION BY doc_id, col ORDER BY ord) - 1 AS row_in_col FROM a),
r AS (SELECT *, (36.0 - 0.12 - 0.15 - (36.0 * 0.10 + 0.40)) AS content, (36.0 - 0.12 - 0.15 - (36.0 * 0.10 + 0.40)) - 0.40 * (n - 1) AS room FROM k),
h0 AS (SELECT *, greatest(least(weight / sum(weight) OVER (PARTITION BY doc_id, col) * room, 0.48 * content), 0.10 * content) AS h0 FROM r),
h AS (SELECT *, h0 * room / sum(h0) OVER (PARTITION BY doc_id, col) AS h FROM h0)
SELECT doc_id, ord, col, CAST(row_in_col AS INTEGER) AS row_in_col, round(h, 6) AS h, round(36.0 * 0.10 + 0.40 + coalesce(sum(h + 0.40) OVER (PARTITION BY doc_id, col ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS y FROM h""", ("md",))
def column_layout(spark, d):
    p = layout.place(layout.assign_columns(panels(spark, d)))
    return p.select("doc_id", "ord", "col", "row_in_col", F.round("h", 6).alias("h"), F.round("y", 6).alias("y"))


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS}, {ASSIGN},
w AS (SELECT doc_id, col, list(ord ORDER BY ord) AS ords, list(weight::DOUBLE ORDER BY ord) AS cur, sum(weight::DOUBLE) * 0.48 AS top, 0 AS r FROM a GROUP BY doc_id, col UNION ALL
  SELECT doc_id, col, ords, CASE WHEN over <= 1e-9 OR free <= 0 OR len(cur) < 3 THEN cur ELSE list_transform(cur, lambda x: CASE WHEN x >= top THEN top ELSE x * (free + over) / free END) END, top, r + 1
  FROM (SELECT *, list_sum(list_transform(cur, lambda x: greatest(x - top, 0.0))) AS over, list_sum(list_transform(cur, lambda x: CASE WHEN x < top THEN x ELSE 0.0 END)) AS free FROM w WHERE r < 20))
SELECT doc_id, col, unnest(ords) AS ord, round(unnest(cur), 6) AS flex FROM w WHERE r = 20""", ("md",))
def flex_clamp(spark, d):
    return layout.clamp_flex(layout.assign_columns(panels(spark, d))).select("doc_id", "col", "ord", F.round("flex", 6).alias("flex"))


@query(f"""{MD_SECTIONS}, {TYPED}, {PANELS}, i AS (SELECT doc_id, ord, src, list_filter(['overflow', 'too_blank', 'visual_too_small', 'visual_too_large'], lambda n, k: (ord + k - 1 + doc_id) % 3 = 0) AS iss FROM q),
f AS (SELECT doc_id, ord, iss, 1.0::DOUBLE AS fs, 1.0::DOUBLE AS ts, 1.0::DOUBLE AS vs, 1.0::DOUBLE AS vf FROM i),
f1 AS (SELECT doc_id, ord, iss, CASE WHEN list_contains(iss, 'overflow') THEN greatest(least(fs - 0.05, 1.00), 0.90) ELSE fs END AS fs, ts, vs, vf FROM f),
f2 AS (SELECT doc_id, ord, iss, CASE WHEN b THEN greatest(least(fs + 0.03, 1.10), 0.90) ELSE fs END AS fs, CASE WHEN b THEN greatest(least(ts + 0.06, 1.15), 0.85) ELSE ts END AS ts, CASE WHEN b THEN greatest(least(vs + 0.08, 1.35), 0.85) ELSE vs END AS vs, CASE WHEN b THEN greatest(least(vf + 0.08, 1.35), 0.85) ELSE vf END AS vf FROM (SELECT *, list_contains(iss, 'too_blank') AS b FROM f1)),
f3 AS (SELECT doc_id, ord, iss, fs, CASE WHEN b THEN greatest(least(ts - 0.04, 1.05), 0.80) ELSE ts END AS ts, CASE WHEN b THEN greatest(least(vs + 0.15, 1.40), 0.90) ELSE vs END AS vs, CASE WHEN b THEN greatest(least(vf + 0.15, 1.40), 0.85) ELSE vf END AS vf FROM (SELECT *, list_contains(iss, 'visual_too_small') AS b FROM f2))
SELECT doc_id, ord, round(fs, 3) AS font_scale, round(CASE WHEN b THEN greatest(least(ts + 0.05, 1.20), 0.80) ELSE ts END, 3) AS text_scale, round(CASE WHEN b THEN greatest(least(vs - 0.10, 1.20), 0.75) ELSE vs END, 3) AS visual_scale,
  round(CASE WHEN b THEN greatest(least(vf - 0.10, 1.20), 0.75) ELSE vf END, 3) AS visual_flex FROM (SELECT *, list_contains(iss, 'visual_too_large') AS b FROM f3)""", ("md",))
def style_fix_rules(spark, d):
    names = F.array(*[F.lit(n) for n, _ in layout.FIXES])
    p = panels(spark, d).withColumn("issues", F.filter(names, lambda n, k: (F.col("ord") + k + F.col("doc_id")) % 3 == 0))
    return layout.apply_fixes(p).select("doc_id", "ord", *layout.STYLE)


# Chunks

@query(f"""SELECT doc_id, CAST(unnest(range(1, CASE WHEN n <= 800 THEN 2 ELSE 3 END)) AS INTEGER) AS chunk_no, CAST(CASE WHEN n <= 800 THEN n WHEN unnest(range(1, CASE WHEN n <= 800 THEN 2 ELSE 3 END)) = 1 THEN n // 2 ELSE n - n // 2 END AS BIGINT) AS token_count
FROM (SELECT doc_id, len({W('text')}) AS n FROM documents WHERE trim(text) <> '')""")
def chunk_documents(spark, d):
    return chunks.chunk(fx.whole_sections(fx.documents(spark, d))).select("doc_id", "chunk_no", "token_count")


ATOMIC_SQL = [a.replace("'", "''") for a in chunks.ATOMIC]
BLANK_SQL = r"\n\s*\n"


def spans_sql(pattern: str) -> str:
    """(start, stop) of a pattern's matches in t, from the lengths of the matches and of the stretches between."""
    upto = "coalesce(list_sum(g[1:i]), 0) + coalesce(list_sum(m[1:i - 1]), 0)"
    return f"""(SELECT list_transform(range(1, len(m) + 1), lambda i: {{'s': {upto}, 'e': {upto} + m[i]}}) FROM
      (SELECT list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS m))"""


#: y(doc_id, t, ...) -> ps(doc_id, ps): paragraphs between blank lines; what begins inside an atomic block goes out with what follows, up to the first that begins outside.
PARAGRAPHS = f"""y1 AS (SELECT doc_id, t, regexp_split_to_array(t, '{BLANK_SQL}') AS raw, list_transform(regexp_extract_all(t, '{BLANK_SQL}'), lambda m: length(m)) AS seps,
    CASE WHEN contains(t, '$$') OR contains(t, '```') OR contains(t, '\\begin{{') THEN list_concat({", ".join(spans_sql(p) for p in ATOMIC_SQL)}) ELSE [] END AS blocks FROM y),
y2 AS (SELECT *, list_transform(raw, lambda r: length(r)) AS lens FROM y1),
y3 AS (SELECT *, list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN len(blocks) = 0 THEN -1 ELSE coalesce(list_sum(lens[1:i - 1]), 0) + coalesce(list_sum(seps[1:i - 1]), 0) END) AS starts FROM y2),
y4 AS (SELECT *, list_distinct(list_append(list_filter(range(1, len(raw) + 1), lambda i: len(list_filter(blocks, lambda b: b.s <= starts[i] AND starts[i] <= b.e)) = 0), len(raw))) AS lasts FROM y3),
y5 AS (SELECT doc_id, raw, list_sort(lasts) AS lasts FROM y4),
ps AS (SELECT doc_id, list_filter(list_transform(range(1, len(lasts) + 1), lambda k: regexp_replace(array_to_string(raw[coalesce(lasts[k - 1], 0) + 1:lasts[k]], chr(10) || chr(10)), '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM y5)"""
PACK = f"""x AS (SELECT doc_id, text, len({W('text')}) AS n, trim(text) AS body FROM documents WHERE trim(text) <> ''),
y AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM x WHERE n > 800),
{PARAGRAPHS},
e AS (SELECT x.doc_id, n, body, ps, list_transform(ps, lambda p: len({W('p')})) AS ns FROM x LEFT JOIN ps ON ps.doc_id = x.doc_id),
f AS (SELECT doc_id, n, body, ps, ns, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS parts, 0::BIGINT AS have FROM e WHERE n > 800 UNION ALL
  SELECT doc_id, n, body, ps, ns, i + 1,
    CASE WHEN ns[i + 1] > 800 THEN list_concat(CASE WHEN len(parts) > 0 THEN list_append(done, array_to_string(parts, chr(10) || chr(10))) ELSE done END, [array_to_string(({W('ps[i + 1]')})[1:ns[i + 1] // 2], ' '), array_to_string(({W('ps[i + 1]')})[ns[i + 1] // 2 + 1:], ' ')])
         WHEN have + ns[i + 1] > 800 AND len(parts) > 0 THEN list_append(done, array_to_string(parts, chr(10) || chr(10))) ELSE done END,
    CASE WHEN ns[i + 1] > 800 THEN [] WHEN have + ns[i + 1] > 800 AND len(parts) > 0 THEN [ps[i + 1]] ELSE list_append(parts, ps[i + 1]) END,
    CASE WHEN ns[i + 1] > 800 THEN 0 WHEN have + ns[i + 1] > 800 AND len(parts) > 0 THEN ns[i + 1] ELSE have + ns[i + 1] END
  FROM f WHERE i < len(ps)),
z AS (SELECT doc_id, [body] AS cs FROM e WHERE n <= 800 UNION ALL SELECT doc_id, CASE WHEN len(parts) > 0 THEN list_append(done, array_to_string(parts, chr(10) || chr(10))) ELSE done END FROM f WHERE i = len(ps)),
c AS (SELECT doc_id, CAST(unnest(range(1, len(cs) + 1)) AS INTEGER) AS chunk_no, unnest(cs) AS content FROM z)"""
RECURSIVE = "WITH RECURSIVE "


def para_chunks(spark, d) -> DataFrame:
    return chunks.chunk(fx.whole_sections(fx.paragraphs(fx.documents(spark, d))))


@query(f"{RECURSIVE}{PACK.replace('trim(text) AS body', 'trim(replace(text, chr(10), chr(10) || chr(10))) AS body')} SELECT doc_id, chunk_no, CAST(len({W('content')}) AS BIGINT) AS token_count, md5(array_to_string({W('content')}, ' ')) AS digest FROM c")
def chunk_pack(spark, d):
    return para_chunks(spark, d).select("doc_id", "chunk_no", "token_count", F.md5(F.array_join(T.words(F.col("content")), " ")).alias("digest"))


@query(f"""{RECURSIVE}{PACK}, w AS (SELECT doc_id, chunk_no, {W('content')} AS ws FROM c)
SELECT doc_id, chunk_no, coalesce(array_to_string((lag(ws) OVER o)[greatest(len(lag(ws) OVER o) - 49, 1):], ' '), '') AS context_before, coalesce(array_to_string((lead(ws) OVER o)[1:50], ' '), '') AS context_after FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_no)""")
def chunk_context(spark, d):
    return chunks.with_context(para_chunks(spark, d)).select("doc_id", "chunk_no", "context_before", "context_after")


@query(f"""{RECURSIVE}{PACK}, w AS (SELECT doc_id, chunk_no, content, len({W('content')}) AS n, max(chunk_no) OVER (PARTITION BY doc_id) AS m FROM c),
l AS (SELECT doc_id, n FROM w WHERE chunk_no = m AND m > 1 AND n < 100)
SELECT w.doc_id, chunk_no, CAST(w.n + CASE WHEN l.n IS NOT NULL AND chunk_no = m - 1 THEN l.n ELSE 0 END AS BIGINT) AS token_count FROM w LEFT JOIN l USING (doc_id) WHERE l.n IS NULL OR chunk_no < m""")
def chunk_tail_merge(spark, d):
    return chunks.merge_tail(para_chunks(spark, d)).select("doc_id", "chunk_no", "token_count")


@query(f"{RECURSIVE}{PACK} SELECT d.doc_id, CAST(count(c.chunk_no) AS BIGINT) AS chunks, CAST(coalesce(sum(len({W('c.content')})), 0) AS BIGINT) AS tokens FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def section_chunk_join(spark, d):
    s = fx.documents(spark, d).select("doc_id")
    c = para_chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    return s.join(c, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


# Selection

@query(r"""WITH RECURSIVE t AS (SELECT page_id % 25 AS grp, list(array_to_string((list_filter(regexp_split_to_array(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+'), lambda x: x <> '')), ' ') ORDER BY page_id) AS ts FROM pages GROUP BY page_id % 25),
f AS (SELECT grp, ts, 0 AS i, []::VARCHAR[] AS kept FROM t UNION ALL
  SELECT grp, ts, i + 1, CASE WHEN len(list_filter(kept, lambda k: contains(trim(regexp_replace(lower(ts[i + 1]), '[^\pL\pM\pN_]+', ' ', 'g')), trim(regexp_replace(lower(k), '[^\pL\pM\pN_]+', ' ', 'g')))
    OR contains(trim(regexp_replace(lower(k), '[^\pL\pM\pN_]+', ' ', 'g')), trim(regexp_replace(lower(ts[i + 1]), '[^\pL\pM\pN_]+', ' ', 'g'))))) > 0 THEN kept ELSE list_append(kept, ts[i + 1]) END FROM f WHERE i < len(ts))
SELECT grp, kept FROM f WHERE i = len(ts)""")
def title_dedup_containment(spark, d):
    title = F.array_join(T.words(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), " ")
    p = fx.table(spark, d, "pages").select((F.col("page_id") % 25).alias("grp"), "page_id", title.alias("t"))
    kept = selection.kept_titles(p, "grp", "page_id", "t").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("page_id", "t"))).alias("a"))
    return kept.select("grp", F.transform("a", lambda s: s["t"]).alias("kept"))


@query("""SELECT doc_id, i, line FROM (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1""")
def caption_exact_dedup(spark, d):
    lines = fx.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return selection.first_wins(lines, ["line"], ["doc_id", "i"])


@query(f"""SELECT source, d.doc_id, CAST(quality AS INTEGER) AS quality, CAST(len({W('text')}) AS BIGINT) AS words FROM documents d JOIN labels l ON l.doc_id = d.doc_id
QUALIFY row_number() OVER (PARTITION BY source ORDER BY quality DESC, len({W('text')}) DESC, d.doc_id) <= 5""")
def candidate_fill_topk(spark, d):
    j = fx.documents(spark, d).join(fx.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("words", T.word_count(F.col("text")))
    return selection.top_k(j.select("source", "doc_id", "quality", "words"), ["source"], [F.desc("quality"), F.desc("words"), "doc_id"], 5).drop("place")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def selected_anti_join(spark, d):
    return fx.documents(spark, d).select("doc_id").join(fx.table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def figures_semi_anti(spark, d):
    lab = fx.table(spark, d, "labels")
    return fx.documents(spark, d).select("doc_id").join(lab.where("quality = 1"), "doc_id", "left_semi").join(lab.where("toxic = 1"), "doc_id", "left_anti")


@query("""SELECT p_brand, p_partkey, CAST(running AS BIGINT) AS running FROM (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS running FROM part) WHERE running <= 300""")
def image_budget_prefix(spark, d):
    return selection.prefix_budget(fx.table(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_size", 300).select("p_brand", "p_partkey", "running")


# Pages

@query(r"SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages")
def page_titles(spark, d):
    return sections.page_sections(fx.table(spark, d, "pages")).select("page_id", "title", "heading")


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links,
  CAST(len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+'), lambda x: x <> '')) AS BIGINT) AS word_count FROM pages""")
def page_text_stats(spark, d):
    return sections.page_sections(fx.table(spark, d, "pages")).drop("title", "heading")


@query(r"""SELECT page_id, CAST(i AS INTEGER) AS n, trim(regexp_replace(regexp_replace(p[i], '(?s)</p>.*$', ''), '<[^>]+>', '', 'g')) AS lead FROM (SELECT page_id, p, unnest(range(2, len(p) + 1)) AS i FROM (SELECT page_id, string_split(html, '<p>') AS p FROM pages))""")
def page_paragraphs(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("i", "p")).where("i > 0")
    return p.select("page_id", (F.col("i") + 1).alias("n"), F.trim(F.regexp_replace(F.regexp_replace("p", r"(?s)</p>.*$", ""), "<[^>]+>", "")).alias("lead"))


@query("""SELECT doc_id, CAST(1 AS INTEGER) AS panel_no, 'Panel ' || doc_id AS title, trim(regexp_replace(ls[1], '<[^>]+>', '', 'g')) AS lead, list_filter(list_transform(ls[2:], lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda b: b <> '') AS bullets
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def html_panels(spark, d):
    ls = F.split("text", "\n")
    items = F.array_join(F.transform(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    html = F.concat(F.lit('<h1>x</h1><div class="panel wide"><div class="panel-title">Panel '), F.col("doc_id").cast("string"), F.lit('</div><p class="lead-para">'), ls[0], F.lit("</p><ul>"), items, F.lit("</ul></div>"))
    return sections.poster_panels(fx.documents(spark, d).select("doc_id", html.alias("html"))).select("doc_id", "panel_no", "title", "lead", "bullets")


# Transcripts

@query("""SELECT user_id, ord, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (
  SELECT user_id, ord, start, CASE WHEN start - (lag(start) OVER w + lag(duration) OVER w) > 1.8 THEN 1 ELSE 0 END AS cut FROM segments WINDOW w AS (PARTITION BY user_id ORDER BY start, ord))""", ("segments",))
def segment_gap_sessions(spark, d):
    return transcripts.sessions(fx.segments(fx.table(spark, d, "events")), "user_id").select("user_id", "ord", "session")


@query("""e AS (SELECT user_id, row_number() OVER w AS i, start, coalesce(lead(start) OVER w - (start + duration) > 86400.0, true) AS gap, count(*) OVER (PARTITION BY user_id) AS n, sum(CASE WHEN start > 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS timed,
  lead(start) OVER w IS NULL AS final FROM segments WINDOW w AS (PARTITION BY user_id ORDER BY start, ord)),
c AS (SELECT user_id, i, start, final OR (gap AND timed > n // 4) AS cut FROM e),
f AS (SELECT user_id, 1::BIGINT AS i, start AS first, 1 AS have, 1 AS para, start AS at, cut OR 1 >= 5 AS close FROM c WHERE i = 1 UNION ALL
  SELECT f.user_id, c.i, CASE WHEN f.close THEN c.start ELSE f.first END, CASE WHEN f.close THEN 1 ELSE f.have + 1 END, CASE WHEN f.close THEN f.para + 1 ELSE f.para END, c.start, c.cut OR CASE WHEN f.close THEN 1 ELSE f.have + 1 END >= 5
  FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, CAST(para AS INTEGER) AS para, first AS start, CAST(have AS INTEGER) AS segments, CAST(have AS INTEGER) AS words FROM f WHERE close""", ("segments",))
def segment_paragraphs(spark, d):
    return transcripts.paragraphs(fx.segments(fx.table(spark, d, "events")), "user_id", pause=86_400.0, budget=5)


LABELLED = """x0 AS (SELECT user_id, ord, start, coalesce(max(CASE WHEN start > 0 THEN start + duration END) OVER (PARTITION BY user_id), 0) AS total, row_number() OVER (PARTITION BY user_id ORDER BY start, ord) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM segments),
x AS (SELECT user_id, ord, start, CASE WHEN total > 30 THEN least(start / total, 1.0) ELSE i / greatest(n - 1, 1) END AS share FROM x0),
i AS (SELECT user_id, ord, start, CASE WHEN s >= 0.88 THEN 5 WHEN s >= 0.72 THEN 4 WHEN s >= 0.52 THEN 3 WHEN s >= 0.28 THEN 2 WHEN s >= 0.15 THEN 1 ELSE 0 END AS idx FROM (SELECT user_id, ord, start, coalesce(share, 0) AS s FROM x))"""


def labelled(spark, d) -> DataFrame:
    s = fx.segments(fx.table(spark, d, "events"))
    return transcripts.with_share(s, "user_id").withColumn("idx", transcripts.label_index(F.col("share")))


@query(f"{LABELLED} SELECT user_id, ord, CAST(idx AS INTEGER) AS idx FROM i", ("segments",))
def label_by_time(spark, d):
    return labelled(spark, d).select("user_id", "ord", "idx")


@query(f"{LABELLED} SELECT user_id, ord, CAST(max((idx + ord % 2) % 6) OVER (PARTITION BY user_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS idx FROM i", ("segments",))
def label_monotone(spark, d):
    jumpy = labelled(spark, d).withColumn("idx", ((F.col("idx") + F.col("ord") % 2) % 6).cast("int"))
    return transcripts.monotone(jumpy, "user_id", ["start", "ord"]).select("user_id", "ord", "idx")


@query(f"""{LABELLED}, n AS (SELECT *, CASE WHEN lag(idx) OVER w IS NOT DISTINCT FROM idx THEN 0 ELSE 1 END AS fresh FROM i WINDOW w AS (PARTITION BY user_id ORDER BY start, ord)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(any_value(idx) AS INTEGER) AS idx, CAST(count(*) AS BIGINT) AS segments FROM r GROUP BY user_id, run""", ("segments",))
def label_runs(spark, d):
    r = transcripts.runs(labelled(spark, d), "user_id", ["start", "ord"], "idx")
    return r.groupBy("user_id", "run").agg(F.first("idx").alias("idx"), F.count(F.lit(1)).alias("segments"))


@query(f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ord, role || ' ' || turn AS title, CAST(len({W('text')}) AS BIGINT) AS word_count FROM conversations")
def turn_sections(spark, d):
    return sections.turn_sections(fx.table(spark, d, "conversations")).drop("content")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark, d):
    return fx.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint")).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("p.k").alias("k"))


# Quiz and judges

ITEMS = """items AS (SELECT item_id % 5 AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'verbatim' ELSE 'interpretive' END AS qtype, item_id AS q, substr('ABCD', CAST(item_id % 4 + 1 AS BIGINT), 1) AS gold FROM benchmark),
m AS (SELECT * FROM (VALUES ('reader_a', 0), ('reader_b', 2)) v(model, shift)),
ans AS (SELECT i.*, model, CASE WHEN (q + shift) % 7 = 0 THEN 'NA' WHEN (q + shift) % 3 = 0 THEN substr('ABCD', CAST((q + 1) % 4 + 1 AS BIGINT), 1) ELSE gold END AS answer, CASE WHEN q % 11 = 0 THEN 'NA' ELSE 'text' END AS reference FROM items i CROSS JOIN m)"""
SCORED = ITEMS + ", sc AS (SELECT doc_id, model, qtype, CAST(sum(CASE WHEN answer <> 'NA' AND {0} answer = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total FROM ans GROUP BY doc_id, model, qtype)"


def scored(spark, d, strict=False) -> DataFrame:
    return scores.quiz_scores(*fx.quiz(fx.table(spark, d, "benchmark")), strict_reference=strict)


@query("WITH " + SCORED.format("") + " SELECT *, correct / greatest(total, 1) AS accuracy FROM sc")
def qa_score_by_model(spark, d):
    return scored(spark, d)


@query("WITH " + SCORED.format("reference <> 'NA' AND") + " SELECT *, correct / greatest(total, 1) AS accuracy FROM sc")
def qa_score_strict_na(spark, d):
    return scored(spark, d, strict=True)


@query("WITH " + SCORED.format("") + f""", l AS (SELECT item_id % 5 AS doc_id, sum(len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+'))) AS n FROM benchmark GROUP BY item_id % 5)
SELECT doc_id, model, qtype, round(correct * (1 + 1 / greatest(1.0, n / 774.0)), 6) AS density FROM sc JOIN l USING (doc_id)""")
def density_score(spark, d):
    length = fx.table(spark, d, "benchmark").groupBy((F.col("item_id") % 5).alias("doc_id")).agg(F.sum(T.regex_word_count(F.col("text"))).alias("n"))
    return scored(spark, d).join(length, "doc_id").select("doc_id", "model", "qtype", F.round(scores.density_score(F.col("correct"), F.col("n")), 6).alias("density"))


@query("WITH " + SCORED.format("") + ", pm AS (SELECT doc_id, model, sum(correct) / greatest(1, sum(total)) AS overall, sum(correct) AS raw FROM sc GROUP BY doc_id, model) SELECT doc_id, round(avg(overall), 6) AS overall, round(avg(raw), 6) AS raw, CAST(count(*) AS BIGINT) AS models FROM pm GROUP BY doc_id")
def quiz_model_avg(spark, d):
    return scores.model_means(scored(spark, d)).select("doc_id", F.round("overall", 6).alias("overall"), F.round("raw", 6).alias("raw"), "models")


@query("WITH " + SCORED.format("") + f""", l AS (SELECT item_id % 5 AS doc_id, sum(len(regexp_extract_all(text, '[\\pL\\pM\\pN_]+'))) AS n FROM benchmark GROUP BY item_id % 5),
pm AS (SELECT doc_id, model, coalesce(max(CASE WHEN qtype = 'verbatim' THEN correct / greatest(total, 1) END), 0) AS v, coalesce(max(CASE WHEN qtype = 'interpretive' THEN correct / greatest(total, 1) END), 0) AS i, sum(correct) AS score, sum(total) AS total FROM sc GROUP BY doc_id, model)
SELECT doc_id, round(avg(v), 6) AS verbatim_raw, round(avg(i), 6) AS interpretive_raw, round(avg(score), 6) AS overall_score, round(avg(score / greatest(1, total)), 6) AS overall_accuracy, round(avg(score * (1 + 1 / greatest(1.0, n / 774.0))), 6) AS overall_aug
FROM pm JOIN l USING (doc_id) GROUP BY doc_id""")
def quiz_reader_means(spark, d):
    length = fx.table(spark, d, "benchmark").groupBy((F.col("item_id") % 5).alias("doc_id")).agg(F.sum(T.regex_word_count(F.col("text"))).alias("words"))
    m = scores.reader_means(scored(spark, d), length)
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in ("verbatim_raw", "interpretive_raw", "overall_score", "overall_accuracy", "overall_aug")])


@query("""WITH j AS (SELECT doc_id, n.k, CASE WHEN (doc_id + n.k) % 6 = 0 THEN NULL ELSE least(1 + quality * 3 + toxic + (doc_id + n.k) % 3, 5) END AS s FROM labels, (SELECT unnest(range(0, 6)) AS k) n)
SELECT doc_id, round(avg(s) FILTER (k < 3), 6) AS aesthetic, round(avg(s) FILTER (k >= 3), 6) AS information, round(avg(s), 6) AS overall FROM j GROUP BY doc_id""")
def judge_means(spark, d):
    m = scores.judge_means(fx.judge(fx.table(spark, d, "labels")))
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in ("aesthetic", "information", "overall")])


# Vectors, colours, joins by value

@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-8), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    e = fx.table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(vectors.cosine(F.col("u"), F.col("v")), 6).alias("similarity"))


@query("""WITH u AS (SELECT label, vec_id, generate_subscripts(e, 1) AS i, unnest(e) / sqrt(list_dot_product(e, e)) AS x FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
s AS (SELECT label, i, sum(x) AS x, count(*) AS n FROM u GROUP BY label, i)
SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / max(a.n * b.n), 6) AS similarity FROM s a JOIN s b USING (i) WHERE a.label < b.label GROUP BY a.label, b.label""")
def clip_similarity(spark, d):
    """Mean cosine over all pairs of two groups, from the groups' sums of unit vectors: no pair of vectors is formed."""
    e = fx.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")).withColumn("n", F.sqrt(vectors.dot(F.col("v"), F.col("v"))))
    u = e.select("label", F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    a, b = u.select(F.col("label").alias("a"), "i", F.col("x").alias("xa"), F.col("n").alias("na")), u.select(F.col("label").alias("b"), "i", F.col("x").alias("xb"), F.col("n").alias("nb"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")) / F.max(F.col("na") * F.col("nb")), 6).alias("similarity"))


@query("""SELECT p.vec_id, arg_min(c.vec_id, abs(p.embedding[1] - c.embedding[1])::DOUBLE + abs(p.embedding[2] - c.embedding[2])::DOUBLE) AS caption FROM embeddings p JOIN embeddings c ON c.label = p.label AND c.vec_id <> p.vec_id GROUP BY p.vec_id""")
def nearest_caption(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return selection.nearest_in_group(e, "vec_id", "label", "x", "y").select(F.col("key").alias("vec_id"), F.col("nearest").alias("caption"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def verbatim_grounding(spark, d):
    """Passages found whole in documents."""
    b = fx.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return selection.grounded(fx.documents(spark, d).select("doc_id", "text"), b, "doc_id", "item_id")


PALETTE = ["#0B3D91", "#F2F2F2", "#1A1A1A", "#FF8800", "#7FB069", "#E4572E"]


@query("SELECT c, round(CAST(r * 0.299 + g * 0.587 + b * 0.114 AS DOUBLE), 6) AS brightness, CASE WHEN r * 0.299 + g * 0.587 + b * 0.114 > 140 THEN '#1A1A1A' ELSE '#FFFFFF' END AS text FROM (SELECT c, CAST('0x' || substr(c, 2, 2) AS INTEGER) AS r, CAST('0x' || substr(c, 4, 2) AS INTEGER) AS g, CAST('0x' || substr(c, 6, 2) AS INTEGER) AS b FROM (SELECT unnest(["
       + ", ".join(f"'{c}'" for c in PALETTE) + "]) AS c))")
def hex_brightness(spark, d):
    df = spark.range(1).select(F.explode(F.array(*map(F.lit, PALETTE))).alias("c"))
    return df.select("c", F.round(colour.brightness(F.col("c")), 6).alias("brightness"), colour.text_on(F.col("c")).alias("text"))
