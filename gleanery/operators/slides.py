"""Slides of a deck: which text shapes count, which slide opens a part, and the sections between.

Shapes come one a row (deck, slide, shape_no, text, left, top, width, height, font, is_title, bullets). What concerns one slide is an aggregation by (deck, slide);
only the running count of dividers needs a deck in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Least side of a shape (EMU), font of a heading (points), most words of a divider, most shapes of a title slide, least words of notes.
LEAST_SIDE, HEADING, DIVIDER_WORDS, TITLE_SHAPES, NOTE_WORDS, NEAR = 100_000, 28, 12, 4, 30, 30


def hidden(runs: Column, background: Column) -> Column:
    """Every coloured run is within 30 of the background, as the sum of the channels' differences; runs and background are arrays (r, g, b)."""
    far = lambda c: F.aggregate(F.zip_with(c, background, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    return (F.size(runs) > 0) & F.forall(runs, lambda c: far(c) <= NEAR)


def shown(shapes: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Shapes that have text, are large enough, lie within the slide (to a unit) and, if they come with `colours` of their runs and a `background`, do not hide in it."""
    inside = (F.col("left") >= 0) & (F.col("top") >= 0) & (F.col("left") + F.col("width") <= width + 1) & (F.col("top") + F.col("height") <= height + 1)
    s = shapes.where((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE) & inside & (F.trim("text") != ""))
    return s.where(~hidden(F.col("colours"), F.col("background"))) if {"colours", "background"} <= set(s.columns) else s


def kept_notes(notes: Column) -> Column:
    return F.when(T.word_count(notes) >= NOTE_WORDS, F.trim(notes))


def looks_like_authors(text: Column) -> Column:
    """At most 20 words, and a part between commas, semicolons or "and" of two words or more that all begin in upper case."""
    words = lambda p: T.words(p)
    names = F.exists(F.split(text, r"[,;]|and"), lambda p: (F.size(words(p)) >= 2) & F.forall(words(p), lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    return (T.word_count(text) <= 20) & names


def slides(shapes: DataFrame) -> DataFrame:
    """deck, slide, title, kind (title, divider, content), content: the title is the first placeholder in reading order, else the text of the largest font, nearest the top; the
    content are the other texts in reading order, bullets marked (those of shapes with a true `marked` carry their marks line by line)."""
    place = F.struct("top", "left", "shape_no")
    shapes = shapes if "marked" in shapes.columns else shapes.withColumn("marked", F.lit(False))
    g = shapes.groupBy("deck", "slide").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("is_title"), F.struct(place.alias("at"), "text", "font", "bullets"))).alias("marked"),
        F.min(F.struct((-F.col("font")).alias("size"), F.struct("top", "left", "shape_no").alias("at"), "text", "font", "bullets")).alias("large"),
        F.array_sort(F.collect_list(F.struct(place.alias("at"), "text", "bullets", "marked"))).alias("all"), F.max(T.word_count(F.col("text"))).alias("words"))
    pick = lambda f: F.coalesce(F.col(f"marked.{f}"), F.col(f"large.{f}"))
    g = g.select("deck", "slide", "n", "words", "all", F.trim(pick("text")).alias("title"), pick("font").alias("font"), pick("bullets").alias("bullets"))
    big = (F.col("font") >= HEADING)
    divider = ((F.col("n") == 1) & big & (F.col("words") <= DIVIDER_WORDS) & ~F.col("bullets")) | ((F.col("n") == 2) & big & ~F.col("bullets"))
    opening = (F.col("slide") <= 1) & (F.col("n") <= TITLE_SHAPES) & big
    # One slide of a deck is its title; a second one that looks like it is content.
    g = g.withColumn("opening", opening).withColumn("first", F.min(F.when(opening, F.col("slide"))).over(Window.partitionBy("deck")))
    kind = F.when(F.col("opening"), F.when(F.col("slide") == F.col("first"), "title").otherwise("content")).when(divider, "divider").otherwise("content")
    line = lambda s: F.when(s["bullets"] & ~s["marked"], F.concat(F.lit("- "), F.trim(s["text"]))).otherwise(F.trim(s["text"]))
    rest = F.transform(F.filter("all", lambda s: F.trim(s["text"]) != F.col("title")), line)
    return g.select("deck", "slide", "title", kind.alias("kind"), F.array_join(rest, "\n").alias("content"))


def sections(s: DataFrame) -> DataFrame:
    """slides(deck, slide, title, kind, content) -> deck, section_no, title, content, slides. A divider opens a section; content before the first is titled Overview; in a deck
    without dividers each content slide is a section."""
    w = Window.partitionBy("deck").orderBy("slide")
    whole = Window.partitionBy("deck")
    s = s.where("kind <> 'title'").withColumn("divided", F.max((F.col("kind") == "divider").cast("int")).over(whole) == 1)
    opens = F.when(F.col("divided"), F.col("kind") == "divider").otherwise(F.lit(True))
    s = s.withColumn("no", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.min(F.when((F.col("kind") == "divider") | ~F.col("divided"), F.struct("slide", "title")))["title"]
    g = s.groupBy("deck", "no", "divided").agg(head.alias("head"), F.array_sort(F.collect_list(F.when(F.col("kind") == "content", F.struct("slide", "title", "content")))).alias("parts"))
    title = F.coalesce("head", F.lit("Overview"))
    part = lambda p: F.when(~F.col("divided") | (p["title"] == "") | (p["title"] == title), p["content"]).otherwise(T.strip(F.concat(F.lit("## "), p["title"], F.lit("\n"), p["content"])))
    content = F.array_join(F.filter(F.transform("parts", part), lambda x: x != ""), "\n\n")
    number = F.row_number().over(Window.partitionBy("deck").orderBy("no"))
    return g.select("deck", number.alias("section_no"), title.alias("title"), content.alias("content"), F.size("parts").alias("slides"))


def every_slide(s: DataFrame, places: DataFrame) -> DataFrame:
    """slides for all of places(deck, slide): one without shapes is content named by its number."""
    j = places.select("deck", "slide").join(s, ["deck", "slide"], "left")
    name = F.concat(F.lit("Slide "), (F.col("slide") + 1).cast("string"))
    return j.select("deck", "slide", F.coalesce("title", name).alias("title"), F.coalesce("kind", F.lit("content")).alias("kind"), F.coalesce("content", F.lit("")).alias("content"))


def with_notes(s: DataFrame, notes: DataFrame) -> DataFrame:
    """Slides with long enough notes(deck, slide, notes) behind their content; the title slide takes none."""
    said = F.when(F.col("kind") != "title", F.concat(F.lit("[Presenter Notes]\n"), kept_notes(F.col("notes"))))
    j = s.join(notes, ["deck", "slide"], "left")
    return j.withColumn("content", F.concat_ws("\n\n", F.nullif(F.col("content"), F.lit("")), said)).drop("notes")


# Words of an affiliation.
AFFILIATION = (r"(?i)\b(university|institute|laboratory|lab|department|college|school|centre|center|research|academy|hospital|mit|stanford|cmu|ucla|berkeley|eth|oxford|cambridge)\b")
EMAIL = r"\b\S+@\S+\b"


def title_metadata(shapes: DataFrame, s: DataFrame) -> DataFrame:
    """deck, title, authors, affiliation out of the title slide's other texts in reading order: authors are the first with an address, else the first that looks like names. Decks
    without a title slide have none of them."""
    t = s.where("kind = 'title'").select("deck", "slide", "title")
    others = shapes.join(t, ["deck", "slide"]).withColumn("text", F.trim("text")).where(F.col("text") != F.col("title"))
    first = lambda ok: F.min(F.when(ok, F.struct("top", "left", "shape_no", "text")))["text"]
    text = F.col("text")
    found = others.groupBy("deck").agg(first(F.rlike(text, F.lit(EMAIL))).alias("mail"), first(looks_like_authors(text)).alias("names"), first(F.rlike(text, F.lit(AFFILIATION))).alias("place"))
    decks = s.select("deck").distinct()
    j = decks.join(t, "deck", "left").join(found, "deck", "left")
    return j.select("deck", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("mail", "names", F.lit("")).alias("authors"), F.coalesce("place", F.lit("")).alias("affiliation"))


def captioned_pictures(pictures: DataFrame, shapes: DataFrame) -> DataFrame:
    """pictures(deck, slide, n, left, top, width, height, ...) with caption: the text of the slide's shape whose middle is nearest (sum of distances), the first in a tie."""
    middle = lambda a, b: F.floor(F.col(a) + F.col(b) / 2)
    text = F.struct("shape_no", F.trim("text").alias("said"), middle("left", "width").alias("x"), middle("top", "height").alias("y"))
    said = shapes.where((F.trim("text") != "") & F.col("left").isNotNull()).groupBy("deck", "slide").agg(F.collect_list(text).alias("_texts"))  # the texts of one slide
    far = lambda t: F.abs(middle("left", "width") - t["x"]) + F.abs(middle("top", "height") - t["y"])
    best = F.array_min(F.transform("_texts", lambda t: F.struct(far(t).alias("far"), t["shape_no"].alias("no"), t["said"].alias("said"))))["said"]
    return pictures.join(said, ["deck", "slide"], "left").withColumn("caption", F.coalesce(best, F.lit(""))).drop("_texts")
