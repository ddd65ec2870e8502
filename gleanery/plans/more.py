"""Driver queries of the analysis, slide and transcript operators; test tables stand in for decks, talks and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, chunks, slides, transcripts
from . import fixtures as fx
from . import answers, feedback, office, plan, visual  # noqa: F401  (register their queries)
from .queries import PARAGRAPHS, QUERIES, SQL, W, query  # noqa: F401  (registers into the same tables)


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits(label: str) -> str:
    return f"len(list_filter({quoted(transcripts.SIGNALS[label])}, lambda p: contains(lower(coalesce(text, '')), p)))"


@query("SELECT doc_id, " + ", ".join(f"CAST({hits(x)} AS INTEGER) AS {x}" for x in transcripts.LABELS) + " FROM documents")
def phrase_hits(spark, d):
    return fx.documents(spark, d).select("doc_id", *[transcripts.phrase_hits(F.col("text"), transcripts.SIGNALS[x]).alias(x) for x in transcripts.LABELS])


@query("WITH h AS (SELECT conv_id, turn, CAST(turn % 6 AS INTEGER) AS base, [" + ", ".join(hits(x) for x in transcripts.LABELS) + """] AS n FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN base < 5 AND n[base + 2] >= n[base + 1] + 2 THEN base + 1 ELSE base END AS INTEGER) AS idx FROM h""")
def label_by_phrases(spark, d):
    c = fx.table(spark, d, "conversations")
    return c.select("conv_id", "turn", transcripts.advanced((F.col("turn") % 6).cast("int"), F.col("text")).alias("idx"))


@query(f"""WITH s AS (SELECT conv_id, turn, role, CAST(len({W("coalesce(text, '')")}) AS BIGINT) AS n FROM conversations),
g AS (SELECT *, sum(CASE WHEN n >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section_no FROM s),
m AS (SELECT conv_id, section_no, arg_min(role, turn) AS label, sum(n) AS word_count FROM g WHERE section_no > 0 GROUP BY conv_id, section_no)
SELECT conv_id, CAST(section_no AS BIGINT) AS section_no, upper(label[1]) || label[2:] || CASE WHEN row_number() OVER (PARTITION BY conv_id, label ORDER BY section_no) > 1 THEN ' (cont.)' ELSE '' END AS title,
  CAST(word_count AS BIGINT) AS word_count FROM m""")
def short_sections_merged(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"), F.coalesce("text", F.lit("")).alias("content"))
    return transcripts.merge_short(c, "conv_id", "turn").select("conv_id", "section_no", "title", "word_count")


@query(r"""WITH b AS (SELECT conv_id, turn, i, trim(x) AS x FROM (SELECT conv_id, turn, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS ls FROM conversations))),
f AS (SELECT * FROM b WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(x) ORDER BY turn, i) = 1),
l AS (SELECT conv_id, list(x ORDER BY turn, i) AS bullets FROM f GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(arg_min(role, turn) FILTER (turn % 3 <> 0), '') AS title FROM conversations GROUP BY conv_id)
SELECT t.conv_id, title, coalesce(array_to_string(bullets, '|'), '') AS bullets FROM t LEFT JOIN l USING (conv_id)""")
def chunk_answers_merged(spark, d):
    """Each turn as the answer about one chunk: its role as the title (empty in every third), its sentences as bullets."""
    c = fx.table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("role")).otherwise("").alias("title"), F.lit("").alias("key_message"), F.split(F.coalesce("text", F.lit("")), r"\. ").alias("bullets"),
                 F.array(F.col("role")).alias("figures"))
    return analysis.merged(a, ["conv_id"], "turn").select("conv_id", "title", F.array_join("bullets", "|").alias("bullets"))


@query("""WITH n AS (SELECT c_custkey AS k, count(o_orderkey) AS included, count(DISTINCT o_orderpriority) * 3 AS figures FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT k, CAST(least(12, greatest(6, CASE WHEN included <= 0 THEN 8 ELSE included END, CASE WHEN figures >= 10 THEN 9 WHEN figures >= 6 THEN 7 ELSE 0 END)) AS INTEGER) AS target FROM n""")
def visual_target(spark, d):
    c, o = fx.table(spark, d, "customer"), fx.table(spark, d, "orders")
    n = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("k")).agg(F.count("o_orderkey").alias("included"), (F.countDistinct("o_orderpriority") * 3).alias("figures"))
    return n.select("k", analysis.visual_target(F.col("included"), F.col("figures")).alias("target"))


@query("""WITH s AS (SELECT s_nationkey AS doc_id, s_suppkey AS ord, CAST(s_suppkey AS VARCHAR) AS section_id, ['dataset', 'results', 'conclusion', 'methodology', ''][CAST(s_suppkey % 5 + 1 AS BIGINT)] AS category FROM supplier WHERE s_nationkey <> 3
  UNION ALL SELECT s_nationkey, s_suppkey, CAST(s_suppkey AS VARCHAR), '' FROM supplier WHERE s_nationkey = 3),
a AS (SELECT *, max(CASE WHEN category <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS have FROM s),
r AS (SELECT *, CASE WHEN have = 0 THEN 1 ELSE list_position(['methodology', 'architecture', 'results', 'analysis', 'motivation', 'dataset'], category) END AS rk FROM a),
x AS (SELECT doc_id, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY rk, ord) AS i FROM r WHERE rk > 0),
v AS (SELECT c_nationkey AS doc_id, c_custkey AS visual_no, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)
SELECT doc_id, section_id, visual_no FROM x JOIN v USING (doc_id, i)""")
def visuals_to_sections(spark, d):
    s = fx.table(spark, d, "supplier")
    names = F.array(*map(F.lit, ["dataset", "results", "conclusion", "methodology", ""]))
    category = F.when(F.col("s_nationkey") == 3, "").otherwise(F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")))
    s = s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("section_id"), category.alias("category"))
    v = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("visual_no"))
    return analysis.visuals_to_sections(s, v)


@query("""WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END AS h FROM events),
f AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, min(h) OVER (PARTITION BY user_id) AS first FROM p)
SELECT user_id, event_id, coalesce(l, first) AS head FROM f WHERE h IS NULL""")
def header_asof(spark, d):
    """Events of the first type as headers, the others as figures between them."""
    e = fx.table(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("kind")))).select("user_id", "event_id", F.col("event_id").alias("at"), (F.col("event_type") == F.col("kind")).alias("is_head"))
    heads = e.where("is_head").select("user_id", "at", F.col("event_id").alias("head"))
    return analysis.last_before(e.where("not is_head").select("user_id", "event_id", "at"), heads, "user_id").select("user_id", "event_id", "head")


@query(f"""WITH n AS (SELECT doc_id, len({W('text')}) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, n, 64)) AS start FROM n)
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(least(start + 128, n) AS BIGINT) AS stop, CAST(CASE WHEN start = 0 THEN least(128, n) ELSE least(64, n - start) END AS BIGINT) AS scored FROM s WHERE start = 0 OR start + 64 < n""")
def perplexity_windows(spark, d):
    from ..functions import text as T

    n = fx.documents(spark, d).select("doc_id", T.word_count(F.col("text")).alias("n"))
    return n.select("doc_id", F.explode(analysis.windows(F.col("n"), 128)).alias("w")).select("doc_id", "w.start", "w.stop", "w.scored")


@query("""WITH t AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 7)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place FROM t""")
def strongest_in_order(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return analysis.strongest(o, ["o_custkey"], [F.desc("o_totalprice")], "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query(f"""WITH y AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 1 THEN '$$' || x WHEN i % 5 = 2 THEN x || '$$' ELSE x END), chr(10) || chr(10)) AS t FROM documents),
{PARAGRAPHS} SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS n, unnest(ps) AS paragraph FROM ps""")
def atomic_paragraphs(spark, d):
    """Paragraphs of documents whose every fifth line opens an equation that the next line closes."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("$$"), x)).when(i % 5 == 1, F.concat(x, F.lit("$$"))).otherwise(x))
    docs = fx.documents(spark, d).select("doc_id", F.array_join(lines, "\n\n").alias("text"))
    return docs.select("doc_id", F.posexplode(chunks.paragraphs(F.col("text"))).alias("n", "paragraph"))


SHAPES = """shapes AS (SELECT l_orderkey // 8 AS deck, CAST(l_orderkey % 8 AS INTEGER) AS slide, l_linenumber AS shape_no, 'text ' || l_partkey AS text, CAST(l_suppkey AS INTEGER) AS left_, CAST(l_partkey AS INTEGER) AS top,
  CAST(l_quantity AS INTEGER) AS font, l_returnflag = 'A' AS is_title, l_linestatus = 'F' AS bullets FROM lineitem)"""


def deck(spark, d):
    """Order lines as shapes: eight orders a deck, its slides."""
    return fx.table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 8").alias("deck"), (F.col("l_orderkey") % 8).cast("int").alias("slide"), F.col("l_linenumber").alias("shape_no"), F.concat(F.lit("text "), F.col("l_partkey").cast("string")).alias("text"),
        F.col("l_suppkey").cast("int").alias("left"), F.col("l_partkey").cast("int").alias("top"), F.lit(200_000).alias("width"), F.lit(200_000).alias("height"), F.col("l_quantity").cast("int").alias("font"),
        (F.col("l_returnflag") == "A").alias("is_title"), (F.col("l_linestatus") == "F").alias("bullets"))


SLIDES = f"""WITH {SHAPES},
p AS (SELECT *, row_number() OVER (PARTITION BY deck, slide ORDER BY is_title DESC, CASE WHEN is_title THEN 0 ELSE -font END, top, left_, shape_no) AS pick, count(*) OVER (PARTITION BY deck, slide) AS n FROM shapes),
t AS (SELECT deck, slide, text AS title, font, bullets, n FROM p WHERE pick = 1),
k0 AS (SELECT *, slide <= 1 AND n <= 4 AND font >= 28 AS opening FROM t),
k1 AS (SELECT *, min(CASE WHEN opening THEN slide END) OVER (PARTITION BY deck) AS first FROM k0),
k AS (SELECT *, CASE WHEN opening THEN CASE WHEN slide = first THEN 'title' ELSE 'content' END WHEN n <= 2 AND font >= 28 AND NOT bullets THEN 'divider' ELSE 'content' END AS kind FROM k1)"""


@query(SLIDES + " SELECT deck, slide, title, kind FROM k")
def slide_kinds(spark, d):
    return slides.slides(slides.shown(deck(spark, d), 10_000_000, 10_000_000)).select("deck", "slide", "title", "kind")


@query(SLIDES + """, v AS (SELECT *, max(CASE WHEN kind = 'divider' THEN 1 ELSE 0 END) OVER (PARTITION BY deck) AS divided FROM k WHERE kind <> 'title'),
s AS (SELECT *, sum(CASE WHEN divided = 0 OR kind = 'divider' THEN 1 ELSE 0 END) OVER (PARTITION BY deck ORDER BY slide) AS no FROM v),
g AS (SELECT deck, no, coalesce(arg_min(title, slide) FILTER (kind = 'divider' OR divided = 0), 'Overview') AS title, count(*) FILTER (kind = 'content') AS slides FROM s GROUP BY deck, no)
SELECT deck, CAST(row_number() OVER (PARTITION BY deck ORDER BY no) AS INTEGER) AS section_no, title, CAST(slides AS INTEGER) AS slides FROM g""")
def slide_sections(spark, d):
    made = slides.sections(slides.slides(slides.shown(deck(spark, d), 10_000_000, 10_000_000)))
    return made.select("deck", "section_no", "title", "slides")
