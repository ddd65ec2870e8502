"""Sections of documents: from headers, from turns, from web pages; filters and assembly.

A document's text is cut inside its row (split and higher-order functions) and exploded once, so sectioning needs no exchange; only what sums over a
document's sections shuffles, on doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADER = r"^(#{1,6})\s+(.+)$"


def split_headers(docs: DataFrame, text_col: str = "text", most_level: int = 6) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ord, section_id, level, title, content, section_type, word_count.
    A section's number counts every header before it, also of sections dropped for having no content. Text before the first header is dropped; a document
    without any section that has content becomes one section titled Content."""
    body = F.regexp_replace(F.col(text_col), r"(?s)^---\n.*?\n---\n", "")
    # The text is cut before each header line; a piece that opens with none is what stands before the first.
    header = "#{1," + str(most_level) + r"}[ \t]+\S"
    parts = F.filter(F.split(body, f"(?m)(?=^{header})"), lambda p: F.rlike(p, F.lit("^" + header)))
    head = lambda p: F.regexp_extract(p, r"^(#+)[ \t]+([^\n]*)", 1)
    title = lambda p: F.trim(F.regexp_extract(p, r"^(#+)[ \t]+([^\n]*)", 2))
    content = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*", ""), r"^\s+", ""), r"\s+$", "")
    made = F.filter(F.transform(parts, lambda p, i: F.struct((i + 1).alias("ord"), F.length(head(p)).alias("level"), title(p).alias("title"), content(p).alias("content"))), lambda s: s["content"] != "")
    whole = F.array(F.struct(F.lit(1).alias("ord"), F.lit(1).alias("level"), F.lit("Content").alias("title"), F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"\s+$", "").alias("content")))
    df = docs.select("doc_id", made.alias("_made"), whole.alias("_whole"))
    df = df.select("doc_id", F.explode(F.when(F.size("_made") > 0, F.col("_made")).otherwise(F.filter("_whole", lambda s: s["content"] != ""))).alias("s"))
    out = df.select("doc_id", "s.ord", F.concat(F.lit("section_"), F.col("s.ord").cast("string")).alias("section_id"), "s.level", "s.title", "s.content")
    return out.withColumn("section_type", T.section_type(F.col("title"))).withColumn("word_count", T.word_count(F.col("content")))


def turn_sections(turns: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a section a turn, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", F.row_number().over(w).alias("ord"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.col("text").alias("content"), T.word_count(F.col("text")).alias("word_count"))


def usable(sections: DataFrame, least_words: int = 50) -> DataFrame:
    """Neither references nor acknowledgments, no boilerplate title, more than the least words."""
    return sections.where(~F.col("section_type").isin("references", "acknowledgments") & ~T.is_boilerplate(F.col("title")) & (F.col("word_count") > least_words))


def meaningful(sections: DataFrame, least_words: int = 100) -> DataFrame:
    return sections.where(~F.col("section_type").isin("references", "acknowledgments") & (F.col("word_count") > least_words))


def panel_target(meaningful_count, least: int = 5, most: int = 9):
    """Seven panels up to five meaningful sections, eight up to eight, else the most."""
    n = F.when(meaningful_count <= 5, 7).when(meaningful_count <= 8, 8).otherwise(most)
    return F.greatest(F.least(n, F.lit(most)), F.lit(least))


def full_text(sections: DataFrame, header: DataFrame | None = None, most_words: int | None = None) -> DataFrame:
    """A document's sections as one text, references left out: a header line and the content of each, blank lines between. header(doc_id, text) goes first."""
    part = F.concat(F.lit("\n## "), F.col("title"), F.lit("\n"), F.col("content"))
    kept = sections.where("section_type <> 'references'")
    t = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("p")))), lambda s: s["p"]), "\n\n").alias("full_text"))
    if header is not None:
        t = t.join(header, "doc_id", "left").select("doc_id", F.concat_ws("\n\n", F.nullif("text", F.lit("")), "full_text").alias("full_text"))
    return t.withColumn("full_text", T.first_words(F.col("full_text"), most_words)) if most_words else t


def page_sections(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, title, heading, n_paragraphs, n_links, word_count of the visible text, by expressions on the markup."""
    visible = F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(visible, "<[^>]+>", " ")
    return pages.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("heading"),
                        F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"), T.word_count(text).alias("word_count"))


def poster_panels(html_docs: DataFrame) -> DataFrame:
    """html_docs(doc_id, html) of panel markup -> doc_id, panel_no, title, lead, bullets, text, images; text before the first panel is dropped."""
    cut = F.split("html", r'<div[^>]*class="panel(?:\s[^"]*)?"[^>]*>')
    parts = F.slice(cut, F.lit(2), F.size(cut))
    df = html_docs.select("doc_id", F.posexplode(parts).alias("i", "p"))
    pick = lambda pattern: T.strip_tags(F.regexp_extract("p", pattern, 1))
    bullets = F.filter(F.transform(F.regexp_extract_all("p", F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1)), T.strip_tags), lambda b: b != "")
    df = df.select("doc_id", (F.col("i") + 1).alias("panel_no"), F.coalesce(F.nullif(pick(r'(?s)class="panel-title"[^>]*>(.*?)</'), F.lit("")), F.lit("Section")).alias("title"),
                   pick(r'(?s)class="lead-para"[^>]*>(.*?)</p>').alias("lead"), bullets.alias("bullets"), F.regexp_extract_all("p", F.lit(r'<img[^>]*src="([^"]+)"'), F.lit(1)).alias("images"))
    return df.withColumn("text", F.concat_ws("\n", F.nullif("lead", F.lit("")), F.nullif(F.array_join("bullets", "\n"), F.lit(""))))


def text_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Markdown as alternating text and image blocks: doc_id, block_no, kind, value."""
    image = r"!\[[^\]]*\]\(([^)]+)\)"
    texts = F.split(F.col(text_col), image)
    images = F.regexp_extract_all(F.col(text_col), F.lit(image), F.lit(1))
    blocks = F.flatten(F.transform(F.arrays_zip(texts.alias("t"), images.alias("i")), lambda z: F.array(F.struct(F.lit("text").alias("kind"), F.trim(z["t"]).alias("value")), F.struct(F.lit("image").alias("kind"), z["i"].alias("value")))))
    return docs.select("doc_id", F.posexplode(F.filter(blocks, lambda b: b["value"].isNotNull() & (b["value"] != ""))).alias("block_no", "b")).select("doc_id", "block_no", "b.kind", "b.value")
