"""Headings of documents whose paragraphs carry styles and fonts, and the sections, title and authors that follow from them.

paragraphs(doc_id, block, style, bullet, text, runs array of (text, bold, size)): one row a paragraph, `block` its place among all blocks of the body. Styled headings count if a
document has two; else headings are found by their looks: short lines in capitals, or bold lines a point above the document's body size, with levels by the rank of their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import visuals

# Words of a capital heading, points above the body, paragraphs that are looked at for title, author styles and the title's place, words of an author line.
SHOUT_WORDS, ABOVE, TITLE_PARAS, AUTHOR_PARAS, PLACE_PARAS, AUTHOR_WORDS = 8, 1, 10, 12, 20, 20
AUTHOR_STYLES = ["author", "authors", "subtitle"]
# Words that open a section and so are no author's.
OPENERS = r"(?i)^(abstract|introduction|background|related work|methods?|methodology|approach|results?|discussion|conclusion|references)\b"


def formats(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with heading_style, styled_level, size (largest of runs that have text), all_bold (every such run, and there is one), capitals."""
    said = F.filter("runs", lambda r: T.strip(r["text"]) != "")
    styled = F.coalesce(F.startswith(F.lower("style"), F.lit("heading")), F.lit(False))
    level = F.coalesce(F.try_to_number(F.regexp_extract("style", r"(?i)heading\s*(\d{1,4})", 1), F.lit("9999")).cast("int"), F.lit(1))
    shout = (F.upper("text") == F.col("text")) & F.rlike("text", F.lit(r"\p{L}"))
    return paragraphs.withColumns({"heading_style": styled, "styled_level": level, "size": F.array_max(F.transform(said, lambda r: r["size"])), "all_bold": (F.size(said) > 0) & F.forall(said, lambda r: F.coalesce(r["bold"], F.lit(False))), "capitals": shout})


def headings(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with level: null where it is no heading."""
    p = formats(paragraphs)
    body = visuals.body_size(p.select("doc_id", "text", "size", F.col("heading_style").alias("heading")))
    by_doc = Window.partitionBy("doc_id")
    p = p.join(body, "doc_id").withColumn("_styled", F.sum(F.col("heading_style").cast("int")).over(by_doc))
    looks = (F.col("text") != "") & ~F.coalesce("bullet", F.lit(False)) & ((F.col("capitals") & (T.word_count(F.col("text")) <= SHOUT_WORDS)) | (F.col("all_bold") & F.coalesce(F.col("size") >= F.col("body_size") + ABOVE, F.lit(False))))
    p = p.withColumn("_looks", looks).withColumn("_rank", F.when(F.col("_looks"), F.coalesce("size", "body_size")))
    rank = F.dense_rank().over(by_doc.orderBy(F.col("_rank").desc_nulls_last()))
    level = F.when(F.col("_styled") >= 2, F.when(F.col("heading_style"), F.col("styled_level"))).otherwise(F.when(F.col("_looks"), rank))
    return p.withColumn("level", level).drop("_styled", "_looks", "_rank", "body_size")


def outline(paragraphs: DataFrame) -> DataFrame:
    """headings with the running count of headings (section_no; 0 before the first)."""
    w = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return headings(paragraphs).withColumn("section_no", F.sum(F.col("level").isNotNull().cast("int")).over(w))


def sections(lines: DataFrame) -> DataFrame:
    """outline -> doc_id, ord, section_id, title, level, content, section_type, word_count. What stands before the first heading goes, and so do sections without content (their
    number stays taken); a document without sections is one section named Content."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level").isNull() & (F.col("text") != ""), F.struct("block", "text")))), lambda s: s["text"]), "\n")
    g = lines.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("level").isNotNull(), F.col("text"))).alias("title"), F.max("level").alias("level"), text.alias("content"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("block", "text")))), lambda s: s["text"]), "\n")
    whole = lines.groupBy("doc_id").agg(every.alias("content")).where("content <> ''")
    parts = g.where("section_no > 0 and content <> ''")
    alone = whole.join(parts.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(1).cast("long").alias("section_no"), F.lit("Content").alias("title"), F.lit(1).alias("level"), "content")
    s = parts.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Section "), F.col("section_no").cast("string")))).unionByName(alone)
    return s.select("doc_id", F.col("section_no").cast("int").alias("ord"), F.concat(F.lit("section_"), F.col("section_no").cast("string")).alias("section_id"), "title", "level", "content",
                    T.section_type(F.col("title")).alias("section_type"), T.word_count(F.col("content")).alias("word_count"))


def first_where(condition: Column, value: Column) -> Column:
    return F.min(F.when(condition, F.struct("pno", value.alias("v"))))["v"]


def heads(paragraphs: DataFrame, secs: DataFrame, properties: DataFrame) -> DataFrame:
    """doc_id, title, authors. Title: the package's, else the first of ten paragraphs in the style Title, else the first section's, else the first text's 200 characters. Authors:
    the package's, else the first of twelve paragraphs in an author style, else the lines among the three after the title's own that could be names."""
    p = paragraphs.withColumn("pno", F.row_number().over(Window.partitionBy("doc_id").orderBy("block")))
    said, style = F.col("text") != "", F.lower("style")
    g = p.groupBy("doc_id").agg(first_where((F.col("pno") <= TITLE_PARAS) & said & (style == "title"), F.col("text")).alias("styled"), first_where(said, F.substring("text", 1, 200)).alias("text"),
                                first_where((F.col("pno") <= AUTHOR_PARAS) & said & style.isin(AUTHOR_STYLES), F.col("text")).alias("author_line"))
    first = secs.groupBy("doc_id").agg(F.min_by("title", "ord").alias("section"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    t = g.join(first, "doc_id", "left").join(properties.select("doc_id", F.col("title").alias("p_title"), F.col("author").alias("p_author")), "doc_id", "left")
    t = t.select("doc_id", F.coalesce(some("p_title"), "styled", "section", "text", F.lit("Untitled Document")).alias("title"), F.coalesce(some("p_author"), "author_line").alias("named"))
    near = p.where(F.col("pno") <= PLACE_PARAS + 3).join(t.select("doc_id", "title"), "doc_id")
    at = near.where((F.col("pno") <= PLACE_PARAS) & said & (F.col("text") == F.col("title"))).groupBy("doc_id").agg(F.min("pno").alias("at"))
    could = said & ~F.coalesce(F.startswith(style, F.lit("heading")), F.lit(False)) & ~F.coalesce("bullet", F.lit(False)) & ~F.rlike("text", F.lit(OPENERS)) & (T.word_count(F.col("text")) <= AUTHOR_WORDS)
    lines = near.join(at, "doc_id").where((F.col("pno") > F.col("at")) & (F.col("pno") <= F.col("at") + 3) & could)
    guessed = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pno", "text"))), lambda s: s["text"]), ", ").alias("guessed"))
    return t.join(guessed, "doc_id", "left").select("doc_id", "title", F.coalesce("named", "guessed", F.lit("")).alias("authors"))


def carried(items: DataFrame, lines: DataFrame, secs: DataFrame) -> DataFrame:
    """items(doc_id, block, ...) with section_id: that of the last heading at or before the block (null if its section went), before the first heading the first section's."""
    marks = lines.where(F.col("level").isNotNull()).select("doc_id", "block", "section_no")
    w = Window.partitionBy("doc_id").orderBy("block", F.col("_item").asc()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.withColumn("_item", F.lit(False)).withColumn("_row", F.lit(None).cast(items.select(F.struct("*")).schema[0].dataType)).unionByName(items.select("doc_id", "block", F.lit(None).cast("long").alias("section_no"), F.lit(True).alias("_item"), F.struct("*").alias("_row")))
    seen = both.withColumn("section_no", F.last("section_no", True).over(w)).where("_item")
    first = secs.groupBy("doc_id").agg(F.min("ord").alias("_first"))
    found = seen.join(first, "doc_id", "left").withColumn("ord", F.coalesce(F.col("section_no").cast("int"), "_first"))
    return found.join(secs.select("doc_id", "ord", "section_id"), ["doc_id", "ord"], "left").select("_row.*", "section_id")
