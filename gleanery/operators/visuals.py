"""Visuals of a document: which to ask for, the text that grounds them, captions of figures, frames of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..functions import vectors
from .analysis import DATA_VISUALS
from .selection import first_wins, top_k

# Characters of a target section, of a section met by a keyword, of a leading section, of all; numbers of the latter two.
TARGET_CHARS, HIT_CHARS, LEAD_CHARS, ALL_CHARS, HITS, LEADS = 3000, 2000, 1500, 5000, 2, 3
# The visual of a category, words of concepts that a headline supports, caption patterns, closing wishes of a prompt, frame limits, body font.
VISUAL_OF = {"methodology": "pipeline", "architecture": "architecture_diagram", "results": "comparison", "dataset": "bar", "analysis": "line"}
OTHER_VISUAL = "concept_diagram"
HEADLINE_WORDS = ["result", "speed", "accuracy", "performance", "comparison"]
FIGURE_LINE = r"(?i)(?:Figure|Fig\.?)\s*(\d+)[.:\s]+([^\n]+)"
CAPTION = r"(?i)^(?:Figure|Fig\.?)\s*\d+[\.:]\s*"
WISHES = ["Ensure all labels are legible and not cropped.", "Avoid large blank regions; fill the canvas with the diagram."]
HASH_DISTANCE, MOST_FRAMES = 8, 12
BODY_FONT, BODY_WORDS, CAPTION_WORDS, DESCRIPTION_CHARS = 11.0, 5, 12, 90


def has_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), w))


def relevant_text(sections: Column, target: Column, concept: Column) -> Column:
    """The text a visual rests on, of sections (array of section_id, text): the target's; else the first two that hold a word of the concept; else the first three. Each part
    and the whole are cut to the prompt's budget, which is the operator's purpose. Null texts count as empty."""
    s = F.transform(sections, lambda x: F.struct(x["section_id"].alias("section_id"), F.coalesce(x["text"], F.lit("")).alias("text")))
    cut = lambda xs, n: F.transform(xs, lambda x: F.substring(x["text"], 1, n))
    aimed = F.filter(F.slice(F.filter(s, lambda x: x["section_id"] == target), 1, 1), lambda x: x["text"] != "")
    words = T.words(F.lower(F.coalesce(concept, F.lit(""))))
    met = F.slice(F.filter(s, lambda x: has_any(x["text"], words)), 1, HITS)
    parts = F.when(F.size(aimed) > 0, cut(aimed, TARGET_CHARS)).when(F.size(met) > 0, cut(met, HIT_CHARS)).otherwise(cut(F.slice(s, 1, LEADS), LEAD_CHARS))
    return F.substring(F.array_join(parts, "\n\n"), 1, ALL_CHARS)


def gathered(sections: DataFrame, wanted: DataFrame, by: str = "doc_id") -> DataFrame:
    """wanted(by, target, concept, ...) with source_text out of sections(by, ord, section_id, text); a document's sections meet in its row, as a document holds few."""
    listed = sections.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ord", "section_id", "text"))).alias("_s"))
    none = F.array().cast(listed.schema["_s"].dataType)
    return wanted.join(listed, by, "left").withColumn("source_text", relevant_text(F.coalesce("_s", none), F.col("target"), F.col("concept"))).drop("_s")


def headline_points(points: Column, kind: Column, concept: Column, headline: Column) -> Column:
    """A data visual without points whose concept names a result gets the headline as its point."""
    wanted = kind.isin(*DATA_VISUALS) & (F.size(F.coalesce(points, F.array().cast("array<string>"))) == 0) & (headline != "")
    return F.when(wanted & has_any(concept, F.array(*map(F.lit, HEADLINE_WORDS))), F.array(F.concat(F.lit("Key result: "), headline))).otherwise(points)


def visual_of(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VISUAL_OF.items() for x in kv]), category), F.lit(OTHER_VISUAL))


def resolved(panels: DataFrame, sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """panels(by, section_id, title, category, concept, description, kind) with a suggestion each: its own where it has a concept, else one made from its section(by,
    section_id, section_title, bullets); null where there is no such section."""
    s = sections.select(by, "section_id", "section_title", "bullets", F.lit(True).alias("_met"))
    made = lambda own, new: F.when(F.col("concept").isNotNull(), F.col(own)).when(F.col("_met"), new)
    first = F.substring(F.get("bullets", F.lit(0)), 1, DESCRIPTION_CHARS)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("section_title"))
    described = F.coalesce(first, F.concat(F.lit("Diagram for "), F.coalesce("title", F.lit(""))))
    p = panels.join(s, [by, "section_id"], "left")
    return p.select(*[c for c in panels.columns if c not in ("concept", "description", "kind")], made("concept", title).alias("concept"), made("description", described).alias("description"),
                    made("kind", visual_of(F.col("category"))).alias("kind"))


def suggestions(own: DataFrame, fallback: DataFrame, by: str, target: Column, order: str = "ord") -> DataFrame:
    """Own suggestions, then fallbacks, both (by, order, concept, description, kind): those with a concept and a description, the first of equal concept (case does not count)
    and kind, up to `target` a document, an expression over their columns."""
    full = F.coalesce((F.col("concept") != "") & (F.col("description") != ""), F.lit(False))
    both = own.where(full).withColumn("_from", F.lit(0)).unionByName(fallback.withColumn("_from", F.lit(1)))
    first = first_wins(both, [by, F.lower(T.strip(F.col("concept"))), "kind"], ["_from", order])
    return top_k(first, [by], ["_from", order], target).drop("_from")


def fill_to_target(sections: DataFrame, by: str, target: int, order: str = "ord") -> DataFrame:
    """Of sections(by, order, included, eligible, importance, word_count) the included in order, then eligible ones of most importance and words, up to `target` in all."""
    lead = F.when(F.col("included"), 0).otherwise(1)
    free = lambda c: F.when(~F.col("included"), F.col(c))
    return top_k(sections.where("included or eligible"), [by], [lead, F.desc(free("importance")), F.desc(free("word_count")), order], target)


def captioned(text: Column, figure_ids: Column) -> Column:
    """Captions of figures (array of ids) out of lines "Figure N: ..." of the text: each goes to the first figure whose id holds its number, a later one replaces an earlier.
    Array of (figure_id, caption), caption null where none."""
    found = lambda t, k: F.regexp_extract_all(t, F.lit(FIGURE_LINE), F.lit(k))
    aim = lambda n: F.get(F.filter(figure_ids, lambda f: F.contains(f, n)), F.lit(0))
    aimed = lambda t: F.zip_with(found(t, 1), found(t, 2), lambda n, c: F.struct(aim(n).alias("id"), c.alias("caption")))
    last = lambda lines, f: T.strip(F.try_element_at(F.filter(lines, lambda x: x["id"] == f), F.lit(-1))["caption"])
    out = lambda lines: F.transform(figure_ids, lambda f, i: F.struct(f.alias("figure_id"), F.when(F.array_position(figure_ids, f) == i + 1, last(lines, f)).alias("caption")))
    return A.let(A.let(F.coalesce(text, F.lit("")), aimed), out)  # the text is read once for all figures


def captions_in(blocks: DataFrame, w) -> DataFrame:
    """blocks(kind, text, ...) with caption: the first paragraph that has text in the window, if it reads like a caption, else ''."""
    near = F.collect_list(F.when(F.col("kind") == "paragraph", F.nullif(T.strip(F.coalesce("text", F.lit(""))), F.lit("")))).over(w)
    first = F.get(near, F.lit(0))
    like = F.rlike(first, F.lit(CAPTION)) | ((T.word_count(first) <= CAPTION_WORDS) & F.startswith(F.lower(first), F.lit("figure")))
    return blocks.withColumn("caption", F.when(like, first).otherwise(""))


def caption_after(blocks: DataFrame, by: str = "doc_id", order: str = "ord") -> DataFrame:
    """blocks(by, order, kind, text): each picture with the caption among the next three blocks."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1, 3)
    return captions_in(blocks, w).where("kind = 'picture'").select(by, order, "caption")


def body_size(paragraphs: DataFrame, by: str = "doc_id") -> DataFrame:
    """paragraphs(by, text, size, heading): the upper median of the font sizes of running text (five words or more, no heading, not all capitals); 11 where there is none."""
    t = T.strip(F.coalesce("text", F.lit("")))
    shouted = (F.upper(t) == t) & F.rlike(t, F.lit(r"\p{L}"))
    counts = (T.word_count(t) >= BODY_WORDS) & ~F.coalesce("heading", F.lit(False)) & ~shouted & (F.col("size") > 0)
    g = paragraphs.groupBy(by).agg(F.array_sort(F.collect_list(F.when(counts, F.col("size").cast("double")))).alias("_s"))
    return g.select(by, F.coalesce(F.get("_s", F.floor(F.size("_s") / 2).cast("int")), F.lit(BODY_FONT)).alias("body_size"))


def relevance(panels: DataFrame, images: DataFrame, by: str, panel: str = "panel") -> DataFrame:
    """panels(by, panel, text, vector), images(panel, image): by, relevance, the mean cosine of a panel's text with its images over all panels that have text, 0 where none."""
    p = panels.withColumn("vector", F.when(F.coalesce("text", F.lit("")) != "", F.col("vector")))
    pairs = p.join(images.select(panel, "image"), panel, "left")
    return pairs.groupBy(by).agg(F.coalesce(F.avg(vectors.cosine(F.col("image"), F.col("vector"))), F.lit(0.0)).alias("relevance"))


def keyframes(frames: Column, distance: int = HASH_DISTANCE, most: int = MOST_FRAMES) -> Column:
    """Of a video's sampled frames in order (array of at, hash) those whose hash differs from all kept before by more than `distance` bits; of more than `most`, as many spread
    evenly. The samples of a video are bounded by its length."""
    far = lambda kept, f: F.forall(kept, lambda k: F.bit_count(k["hash"].bitwiseXOR(f["hash"])) > distance)
    kept = F.aggregate(frames, F.slice(frames, 1, 0), lambda kept, f: F.when(far(kept, f), F.concat(kept, F.array(f))).otherwise(kept))
    spread = lambda xs: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(xs, F.floor(i * (F.size(xs) / F.lit(float(most)))).cast("int")))
    return F.when(F.size(kept) > most, spread(kept)).otherwise(kept)


def prompt_tweak(prompt: Column, issues: Column, fixes: Column) -> Column:
    """The prompt with a report's issues and fixes as wishes."""
    wish = lambda head, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"- {head}: "), F.array_join(xs, "; ")))
    lines = F.array_compact(F.array(wish("Fix these issues", issues), wish("Apply these fixes", fixes), *[F.lit(f"- {w}") for w in WISHES]))
    return F.concat(prompt, F.lit("\n\nQUALITY FIXES:\n"), F.array_join(lines, "\n"))


def with_abstract(sections: DataFrame, documents: DataFrame, by: str = "doc_id", least: int = 25) -> DataFrame:
    """sections(by, ord, title, section_type, content, word_count) behind an abstract of the document's description (by, description) where that has 25 words; ord counts anew."""
    d = documents.where(T.word_count(F.col("description")) >= least)
    text = T.strip(F.col("description"))
    a = d.select(by, F.lit(None).cast(sections.schema["ord"].dataType).alias("ord"), F.lit("Abstract").alias("title"), F.lit("abstract").alias("section_type"), text.alias("content"), T.word_count(text).alias("word_count"))
    both = sections.select(*a.columns).unionByName(a)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_first("ord"))))
