"""Driver queries of the operators on visuals; test tables stand in for sections, suggestions, blocks and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import visuals
from . import fixtures as fx
from .queries import W, query


@query(f"""WITH s AS (SELECT conv_id, list({{'i': turn, 't': coalesce(text, '')}} ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
v AS (SELECT conv_id, s, CASE WHEN conv_id % 3 = 0 THEN 2 END AS target, CASE WHEN conv_id % 4 = 0 THEN [] ELSE {W('lower(role || chr(32) || substring(text, 1, 12))')} END AS words FROM conversations JOIN s USING (conv_id) WHERE turn = 1),
p AS (SELECT conv_id, list_filter(list_filter(s, lambda x: x.i = target)[:1], lambda x: x.t <> '') AS aimed, list_filter(s, lambda x: len(list_filter(words, lambda w: contains(lower(x.t), w))) > 0)[:2] AS met, s[:3] AS lead FROM v)
SELECT conv_id, substring(array_to_string(CASE WHEN len(aimed) > 0 THEN list_transform(aimed, lambda x: substring(x.t, 1, 3000)) WHEN len(met) > 0 THEN list_transform(met, lambda x: substring(x.t, 1, 2000))
  ELSE list_transform(lead, lambda x: substring(x.t, 1, 1500)) END, chr(10) || chr(10)), 1, 5000) AS source_text FROM p""")
def relevant_text(spark, d):
    """Turns as sections; the words of a concept are the second turn's role and what its first twelve characters hold."""
    c = fx.table(spark, d, "conversations")
    concept = F.when(F.col("conv_id") % 4 == 0, "").otherwise(F.concat_ws(" ", F.col("role"), F.substring("text", 1, 12)))
    wanted = c.where("turn = 1").select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.lit("2")).alias("target"), concept.alias("concept"))
    parts = c.select("conv_id", F.col("turn").alias("ord"), F.col("turn").cast("string").alias("section_id"), "text")
    return visuals.gathered(parts, wanted, "conv_id").select("conv_id", "source_text")


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_orderpriority AS concept, o_orderstatus AS kind, CASE WHEN o_orderkey % 3 <> 0 THEN 0 ELSE 1 END AS f, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'd' END AS description FROM orders),
u AS (SELECT * FROM a WHERE f = 1 OR description <> '' QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(concept), kind ORDER BY f, o_orderkey) = 1)
SELECT * FROM (SELECT o_custkey, o_orderkey, concept, kind, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY f, o_orderkey) AS INTEGER) AS place FROM u) WHERE place <= 6""")
def suggestions_to_target(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("concept"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise("d").alias("description"), F.col("o_orderstatus").alias("kind"))
    made = visuals.suggestions(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0"), "o_custkey", F.lit(6), "o_orderkey")
    return made.select("o_custkey", "o_orderkey", "concept", "kind", "place")


@query("""WITH a AS (SELECT c_nationkey, c_custkey, c_custkey % 5 = 0 AS included, c_custkey % 200 AS words, c_custkey % 4 AS importance FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY included DESC, CASE WHEN NOT included THEN importance END DESC, CASE WHEN NOT included THEN words END DESC, c_custkey) AS place FROM a WHERE included OR words > 50)
SELECT c_nationkey, c_custkey, CAST(place AS INTEGER) AS place FROM k WHERE place <= 12""")
def sections_to_target(spark, d):
    words = F.col("c_custkey") % 200
    c = fx.table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.col("c_custkey") % 5 == 0).alias("included"), (words > 50).alias("eligible"), (F.col("c_custkey") % 4).alias("importance"), words.alias("word_count"))
    return visuals.fill_to_target(c, "c_nationkey", 12, "c_custkey").select("c_nationkey", "c_custkey", "place")


@query(r"""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: 'Figure ' || ((i - 1) % 4) || ': ' || x), chr(10)) AS text FROM documents),
n AS (SELECT doc_id, regexp_extract_all(text, '(?:Figure|Fig\.?)\s*(\d+)[.:\s]+([^\n]+)', 1, 'i') AS n, regexp_extract_all(text, '(?:Figure|Fig\.?)\s*(\d+)[.:\s]+([^\n]+)', 2, 'i') AS c FROM t),
l AS (SELECT doc_id, unnest(n) AS n, unnest(c) AS c, generate_subscripts(n, 1) AS i FROM n),
f AS (SELECT doc_id, CASE WHEN contains('figure_10', n) THEN 'figure_10' WHEN contains('figure_1', n) THEN 'figure_1' WHEN contains('figure_2', n) THEN 'figure_2' WHEN contains('figure_3', n) THEN 'figure_3' END AS figure_id, c, i FROM l),
g AS (SELECT doc_id, figure_id, arg_max(c, i) AS c FROM f GROUP BY doc_id, figure_id),
a AS (SELECT doc_id, unnest(['figure_10', 'figure_1', 'figure_2', 'figure_3']) AS figure_id FROM documents)
SELECT a.doc_id, a.figure_id, regexp_replace(c, '^\s+|\s+$', '', 'g') AS caption FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.figure_id = a.figure_id""")
def figure_captions(spark, d):
    """Every line a caption of one of four numbers; figure_10 takes those of 0 and 1."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.lit("Figure "), (i % 4).cast("string"), F.lit(": "), x))
    ids = F.array(*map(F.lit, ["figure_10", "figure_1", "figure_2", "figure_3"]))
    return fx.documents(spark, d).select("doc_id", F.explode(visuals.captioned(F.array_join(lines, "\n"), ids)).alias("f")).select("doc_id", "f.figure_id", "f.caption")


@query(r"""WITH b AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'picture' WHEN event_id % 7 = 0 THEN 'table' ELSE 'paragraph' END AS kind,
  CASE event_id // 3 % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Fig. ' || event_id || ': ' || event_type WHEN 2 THEN 'figure of ' || event_type ELSE 'other words' END AS text FROM events),
n AS (SELECT *, list(CASE WHEN kind = 'paragraph' THEN nullif(trim(text), '') END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS near FROM b),
f AS (SELECT user_id, event_id, list_filter(near, lambda x: x IS NOT NULL)[1] AS t FROM n WHERE kind = 'picture')
SELECT user_id, event_id, CASE WHEN t LIKE 'Fig. %' OR t LIKE 'figure%' THEN t ELSE '' END AS caption FROM f""")
def picture_captions(spark, d):
    """Events of a user as blocks of a document."""
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "picture").when(i % 7 == 0, "table").otherwise("paragraph")
    n = F.expr("event_id div 3 % 4")
    said = F.when(n == 1, F.concat(F.lit("Fig. "), i.cast("string"), F.lit(": "), F.col("event_type"))).when(n == 2, F.concat(F.lit("figure of "), F.col("event_type")))
    b = fx.table(spark, d, "events").select("user_id", i, kind.alias("kind"), F.when(n == 0, " ").otherwise(F.coalesce(said, F.lit("other words"))).alias("text"))
    return visuals.caption_after(b, "user_id", "event_id")


@query(rf"""WITH p AS (SELECT conv_id, trim(coalesce(text, '')) AS t, CAST(8 + len(role) + turn % 5 AS DOUBLE) AS size, turn % 4 = 0 AS heading FROM conversations),
s AS (SELECT conv_id, list_sort(list(size) FILTER (len({W('t')}) >= 5 AND NOT heading AND NOT (upper(t) = t AND regexp_matches(t, '\p{{L}}')))) AS s FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(s[len(s) // 2 + 1], 11.0)::DOUBLE AS body_size FROM s""")
def body_font(spark, d):
    c = fx.table(spark, d, "conversations")
    return visuals.body_size(c.select("conv_id", "text", (8 + F.length("role") + F.col("turn") % 5).cast("double").alias("size"), (F.col("turn") % 4 == 0).alias("heading")), "conv_id")


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, min(vec_id) OVER (PARTITION BY label) AS head FROM embeddings),
c AS (SELECT p.label % 3 AS poster, CASE WHEN p.label % 5 <> 0 THEN list_dot_product(p.e, i.e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(i.e, i.e)) + 1e-8) END AS s
  FROM e p LEFT JOIN e i ON i.label = p.label AND i.vec_id <> i.head WHERE p.vec_id = p.head)
SELECT poster, round(coalesce(avg(s), 0.0), 6) AS relevance FROM c GROUP BY poster""")
def visual_relevance(spark, d):
    """A label's first vector as its panel's text (none in every fifth), the others as its images."""
    e = fx.table(spark, d, "embeddings")
    heads = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("head"))
    panels = heads.select((F.col("label") % 3).alias("poster"), F.col("label").alias("panel"), F.when(F.col("label") % 5 != 0, "text").alias("text"), "vector")
    images = e.join(heads.select("label", "head"), "label").where("vec_id <> head").select(F.col("label").alias("panel"), F.col("embedding").alias("image"))
    return visuals.relevance(panels, images, "poster").select("poster", F.round("relevance", 6).alias("relevance"))


@query("""WITH f AS (SELECT user_id, list({'at': event_id, 'hash': (event_id * 2654435761) % 4294967296} ORDER BY event_id) AS l FROM events GROUP BY user_id),
k AS (SELECT user_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, b: CASE WHEN list_min(list_transform(a, lambda k: bit_count(xor(k.hash, b[1].hash)))) > 12 THEN list_concat(a, b) ELSE a END) AS k FROM f),
s AS (SELECT user_id, CASE WHEN len(k) > 12 THEN list_transform(range(12), lambda i: k[CAST(floor(i * (len(k) / 12.0::DOUBLE)) AS BIGINT) + 1]) ELSE k END AS k FROM k),
u AS (SELECT user_id, unnest(k) AS x FROM s) SELECT user_id, x.at AS at FROM u""")
def keyframes(spark, d):
    """Events as sampled frames of a user, hashes of 32 bits out of their ids."""
    e = fx.table(spark, d, "events").select("user_id", F.struct(F.col("event_id").alias("at"), (F.col("event_id") * 2654435761 % 4294967296).alias("hash")).alias("f"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list("f")).alias("l"))
    return g.select("user_id", F.explode(visuals.keyframes(F.col("l"), 12)).alias("x")).select("user_id", "x.at")


@query(f"""WITH s AS (SELECT conv_id, turn, role AS title, len({W("coalesce(text, '')")}) AS n, text FROM conversations),
a AS (SELECT conv_id, turn, title, n FROM s UNION ALL SELECT conv_id, NULL, 'Abstract', n FROM s WHERE turn = 1 AND n >= 25)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS INTEGER) AS ord, title, CAST(n AS BIGINT) AS word_count FROM a""")
def abstract_first(spark, d):
    """Turns as sections, the second turn as the description."""
    from ..functions import text as T

    c = fx.table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    parts = c.select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("title"), F.lit("other").alias("section_type"), F.col("text").alias("content"), T.word_count(F.col("text")).alias("word_count"))
    made = visuals.with_abstract(parts, c.where("turn = 1").select("conv_id", F.col("text").alias("description")), "conv_id")
    return made.select("conv_id", "ord", "title", F.col("word_count").cast("long").alias("word_count"))
