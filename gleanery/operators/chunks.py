"""Chunks of at most `most` words, with context from their neighbours.

Packing is an ordered fold inside a section's row (no exchange). Context and the tail merge need a document's chunks in order: one shuffle on doc_id serves both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T

def halves(text: Column) -> Column:
    w = T.words(text)
    n = F.floor(F.size(w) / 2).cast("int")
    return F.array(F.array_join(F.slice(w, 1, n), " "), F.array_join(F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))), " "))


# Line openings that mark a change of topic.
TOPIC = (r"(?i)(?:^|\n)(?:however|in contrast|on the other hand|conversely|next we|we then|we also|we further|to evaluate|for evaluation|we evaluate|we compare|specifically|in particular|more precisely|"
         r"as shown in|as illustrated|table \d|figure \d|fig\. \d|our key|the main|the primary|importantly|notably)")


def spans(text: Column, pattern: str) -> Column:
    """(start, stop) of a pattern's matches, from the lengths of the matches and of the stretches between."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    pairs = F.zip_with(lengths(F.split(text, pattern, -1)), lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda g, m: F.array(g, F.coalesce(m, F.lit(0))))
    ends = lambda e: F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1), lambda i: F.struct(F.get(e, 2 * i).alias("start"), F.get(e, 2 * i + 1).alias("stop")))
    every = A.let(A.sums(F.flatten(pairs)), ends)  # the last stretch has no match behind it
    return F.slice(every, F.lit(1), F.size(every) - 1)


def divided(text: Column, margin: int = 50) -> Column:
    """An oversize paragraph in two: at the topic opening nearest the middle, unless that is within the margin of either end; else in halves."""
    mid = F.floor(F.length(text) / 2).cast("int")
    nearest = F.array_min(F.transform(spans(text, TOPIC), lambda s: F.struct(F.abs(s["start"] - mid).alias("far"), s["start"].alias("at"))))["at"]
    cut = lambda at: F.when(at.between(F.lit(margin), F.length(text) - margin), F.array(T.strip(F.substring(text, F.lit(1), at)), T.strip(F.substring(text, at + 1, F.length(text))))).otherwise(halves(text))
    return A.let(nearest, cut)


# Blocks that stay whole, equations and algorithms or code.
ATOMIC = [r"(\$\$[\s\S]*?\$\$|\\begin\{(?:equation|align|gather|multline)\}[\s\S]*?\\end\{(?:equation|align|gather|multline)\})", r"(\\begin\{algorithm\}[\s\S]*?\\end\{algorithm\}|```[\s\S]*?```)"]
BLANK = r"\n\s*\n"


# A character that a text holds only with ITSELF behind it while its paragraphs are sought, and its other uses: both ends of a block, a start inside one, the end
# of a paragraph.
MARK = "\x01"
ITSELF, EDGE, HELD, END = (MARK + c for c in "iehp")


def marked(text: Column, pattern: str) -> Column:
    """A text (its own marks written as ITSELF) with HELD at the start of each block and behind each blank line within one. A block neither begins nor ends with white space,
    so a blank line is within it or outside, and marks fall neither into blank lines nor into the openings of other blocks."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{EDGE}$0{EDGE}"), EDGE, -1)  # every second one is a block
    held = lambda x: F.concat(F.lit(HELD), F.regexp_replace(x, BLANK, "\n\n" + HELD))
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, held(x)).otherwise(x)), "")


def grouped(parts: Column, lasts: Column) -> Column:
    """Runs of parts that end at each of `lasts` (places from 0, ascending), joined by blank lines."""
    run = lambda last, before: F.array_join(F.slice(parts, before + 2, last - before), "\n\n")
    return F.transform(lasts, lambda last, k: A.let(F.coalesce(F.get(lasts, k - 1), F.lit(-1)), lambda before: run(last, before)))


def paragraphs(content: Column) -> Column:
    """A text's paragraphs, between blank lines. One that begins inside an atomic block is held back and goes out with those that follow, up to and with the first that begins
    outside. A few passes over the text, without positions: blocks are marked in the text itself."""
    text = F.replace(content, F.lit(MARK), F.lit(ITSELF))
    for pattern in ATOMIC:
        text = marked(text, pattern)
    ended = F.transform(F.split(text, BLANK, -1), lambda p: F.concat(p, F.when(F.startswith(p, F.lit(HELD)), "\n\n").otherwise(END)))
    whole = F.transform(F.split(F.replace(F.array_join(ended, ""), F.lit(HELD), F.lit("")), END, -1), lambda p: F.replace(p, F.lit(ITSELF), F.lit(MARK)))
    has_blocks = F.contains(content, F.lit("$$")) | F.contains(content, F.lit("```")) | F.contains(content, F.lit("\\begin{"))
    return F.filter(F.transform(F.when(has_blocks, whole).otherwise(F.split(content, BLANK, -1)), lambda p: T.strip(p)), lambda p: p != "")


def pack(content: Column, most: int = 800) -> Column:
    """The chunk texts of a section: whole if short; else paragraphs packed in order, a paragraph over the limit flushing what is packed and going out in two
    parts, which are not cut again. Only word counts are folded: a chunk begins where the count that it would reach passes the limit."""
    def packed(ps: Column, ws: Column) -> Column:
        reach = A.scan(ws, F.lit(0), lambda n, w: F.when((n == 0) | (n + w > most), w).otherwise(n + w))
        first = lambda ns, i: F.get(ns, i) == F.get(ws, i)
        lasts = A.let(reach, lambda ns: F.filter(F.transform(ws, lambda w, i: F.when((i == F.size(ws) - 1) | first(ns, i + 1), i)), lambda i: i.isNotNull()))
        whole = lambda ls: F.zip_with(grouped(ps, ls), ls, lambda text, last: F.when(F.get(ws, last) > most, divided(text)).otherwise(F.array(text)))
        return F.flatten(A.let(lasts, whole))

    folded = A.let(paragraphs(content), lambda ps: A.let(F.transform(ps, lambda p: T.word_count(p).cast("int")), lambda ws: packed(ps, ws)))
    return F.when(T.word_count(content) <= most, F.array(T.strip(content))).otherwise(folded)


def chunk(sections: DataFrame, most: int = 800) -> DataFrame:
    """sections(doc_id, ord, section_id, section_type, content) -> doc_id, section_id, ord, n, chunk_no, content, token_count. References and blank sections go."""
    s = sections.where((F.col("section_type") != "references") & (F.trim("content") != ""))
    s = s.select("doc_id", "ord", "section_id", F.posexplode(pack(F.col("content"), most)).alias("n", "content"))
    w = Window.partitionBy("doc_id").orderBy("ord", "n")
    return s.withColumn("chunk_no", F.row_number().over(w)).withColumn("token_count", T.word_count(F.col("content")))


def with_context(chunks: DataFrame, n: int = 50) -> DataFrame:
    """context_before and context_after: the last and first n words of the neighbouring chunks of the same section."""
    w = Window.partitionBy("doc_id", "section_id").orderBy("chunk_no")
    prev, nxt = T.words(F.lag("content").over(w)), T.words(F.lead("content").over(w))
    tail = F.slice(prev, F.greatest(F.size(prev) - n + 1, F.lit(1)), n)
    return chunks.withColumn("context_before", F.array_join(tail, " ")).withColumn("context_after", F.array_join(F.slice(nxt, 1, n), " "))


def merge_tail(chunks: DataFrame, least: int = 100) -> DataFrame:
    """A document's last chunk of fewer than `least` words joins the one before it, of whatever section; its number is gone."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    c = chunks.withColumn("_next", F.lead("content").over(w)).withColumn("_next_n", F.lead("token_count").over(w)).withColumn("_after", F.lead("content", 2).over(w)).withColumn("_prev", F.lag("content").over(w))
    takes = F.col("_next").isNotNull() & F.col("_after").isNull() & (F.col("_next_n") < least)
    goes = F.col("_next").isNull() & F.col("_prev").isNotNull() & (F.col("token_count") < least)
    c = c.where(~goes).withColumn("content", F.when(takes, F.concat_ws("\n\n", "content", "_next")).otherwise(F.col("content")))
    return c.withColumn("token_count", T.word_count(F.col("content"))).drop("_next", "_next_n", "_after", "_prev")
