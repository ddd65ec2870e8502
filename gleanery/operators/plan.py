"""The plan of a document as tables: prose segments in place of missing sections, panels in columns with places and titles, the title panel, and the whole nested in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from . import analysis, layout

# Usable sections below which prose is segmented, segments that are taken, words of a usable section.
FEW_SECTIONS, MOST_SEGMENTS, USABLE_WORDS = 4, 9, 50
# A category's title, its other titles, and the endings that are tried after them.
TITLE_OF = {"motivation": "Motivation & Problem", "methodology": "Method Overview", "architecture": "Architecture Overview", "results": "Key Results", "analysis": "Analysis & Insights", "dataset": "Dataset & Setup",
            "conclusion": "Conclusion & Takeaways", "content": "Overview"}
OTHER_TITLES = {
    "motivation": ["Research Gap", "Problem Setting", "Why It Matters", "Challenge Overview"], "methodology": ["Approach", "Method Pipeline", "Algorithm Steps", "Method Details"],
    "architecture": ["Model Design", "System Architecture", "Architecture Details", "Design Highlights"], "results": ["Experimental Results", "Performance Highlights", "Ablation Highlights", "Result Summary"],
    "analysis": ["Ablation Analysis", "Insights & Discussion", "Qualitative Analysis", "Analysis Summary"], "dataset": ["Data & Benchmarks", "Experimental Setup", "Datasets", "Setup Details"],
    "conclusion": ["Takeaways", "Implications", "Limitations & Future Work", "Closing Summary"], "content": ["Background", "Key Concepts", "Technical Details", "Additional Context"]}
ENDINGS = ["Insights", "Details", "Summary", "Highlights"]
#: Sizes of a professional and a casual plan: share of the title, margin, gutter, least and most share of a panel's height.
SIZES = {False: {"title": 0.10, "margin": 0.12, "gutter": 0.40, "least": 0.10, "most": 0.48}, True: {"title": 0.13, "margin": 0.20, "gutter": 0.28, "least": 0.12, "most": 0.52}}
CASUAL_PANELS = 7


def segmented(sections: DataFrame, segments: DataFrame) -> DataFrame:
    """sections(doc_id, ord, section_id, title, section_type, content, word_count) with prose segments(doc_id, n, title, text), as a model answers them, in place of the usable
    sections of documents that have fewer than four. Of a document's first nine segments those with text count, if there are four; what stays behind them are its other
    sections without boilerplate titles. ord counts anew in such documents."""
    plain = ~T.is_boilerplate(F.col("title"))
    usable = ~F.col("section_type").isin("references", "acknowledgments") & plain & (F.col("word_count") > USABLE_WORDS)
    s = sections.withColumn("_usable", usable).withColumn("_plain", plain)
    few = s.groupBy("doc_id").agg(F.sum(F.col("_usable").cast("int")).alias("_n")).where(F.col("_n") < FEW_SECTIONS).select("doc_id")
    w = Window.partitionBy("doc_id").orderBy("n")
    seg = segments.withColumn("_i", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where((F.col("_i") <= MOST_SEGMENTS) & (F.col("_all") >= FEW_SECTIONS))
    text = T.strip(F.coalesce("text", F.lit("")))
    number = F.col("_i").cast("string")
    seg = seg.select("doc_id", F.col("_i").alias("ord"), F.concat(F.lit("prose_seg_"), number).alias("section_id"), T.strip(F.coalesce("title", F.concat(F.lit("Section "), number))).alias("title"),
                     F.lit("other").alias("section_type"), text.alias("content"), T.word_count(text).alias("word_count")).where("content <> ''")
    good = seg.groupBy("doc_id").count().where(F.col("count") >= FEW_SECTIONS).select("doc_id").join(few, "doc_id", "left_semi")
    cols = ["doc_id", "ord", "section_id", "title", "section_type", "content", "word_count"]
    same = s.join(good, "doc_id", "left_anti").select(*cols)
    rest = s.where(~F.col("_usable") & F.col("_plain")).join(good, "doc_id", "left_semi")
    new = seg.join(good, "doc_id", "left_semi").select(*cols, F.lit(0).alias("_part")).unionByName(rest.select(*cols, F.lit(1).alias("_part")))
    new = new.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_part", "ord"))).drop("_part")
    return same.withColumn("ord", F.col("ord").cast("long")).unionByName(new.withColumn("ord", F.col("ord").cast("long")))


def lookup(table: dict, key: Column, default) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), value(v))]), key), value(default))


def titles(panels: Column) -> Column:
    """Titles of panels (array of title, category) in order, no two alike but for case: a title that is empty is its category's; one that is taken gives way to the category's other
    titles, the category's own, that with an ending, at last with the smallest number from 2."""
    def step(kept: Column, p: Column) -> Column:
        base = lookup(TITLE_OF, p["category"], "Overview")
        title = F.coalesce(F.nullif(T.strip(F.coalesce(p["title"], F.lit(""))), F.lit("")), base)
        others = lookup(OTHER_TITLES, p["category"], [])
        endings = F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat_ws(" ", base, e))
        numbers = F.transform(F.sequence(F.lit(2), F.size(kept) + 2), lambda i: F.concat_ws(" ", base, i.cast("string")))
        free = lambda x: ~F.exists(kept, lambda k: F.lower(k) == F.lower(x))
        return F.concat(kept, F.array(F.element_at(F.filter(F.concat(F.array(title), others, F.array(base), endings, numbers), free), 1)))

    return F.aggregate(panels, F.array().cast("array<string>"), step)


def titled(panels: DataFrame) -> DataFrame:
    """panels(doc_id, ord, title, category, ...) with unique titles, in order of ord; a document's panels meet in its row, as a plan has few."""
    others = [c for c in panels.columns if c not in ("doc_id", "title")]
    g = panels.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "title", *[c for c in others if c != "ord"]))).alias("_p"))
    z = g.select("doc_id", F.explode(F.arrays_zip("_p", A.let(F.transform("_p", lambda p: F.struct(p["title"].alias("title"), p["category"].alias("category"))), titles).alias("_t"))).alias("z"))
    return z.select("doc_id", F.col("z._t").alias("title"), *[F.col(f"z._p.{c}").alias(c) for c in others])


def planned(panels: DataFrame, heads: DataFrame, casual: bool = False, width: float = 48.0, height: float = 36.0) -> DataFrame:
    """panels(doc_id, ord, section_id, title, weight, mode, category), heads(doc_id, title) -> a row for each panel of a document's plan, its title panel included: doc_id, panel_no (in
    reading order, the title 0), panel_id, kind, title, section_id, mode, category, weight, columns, col, row_in_col, x, y, w, h. A casual plan keeps its seven strongest panels; a document
    without panels has its title only."""
    size = SIZES[casual]
    p = titled(panels)
    p = analysis.strongest(p, ["doc_id"], [F.desc("weight")], "ord", CASUAL_PANELS).drop("place") if casual else p
    n = layout.column_count(F.count(F.lit(1)).over(Window.partitionBy("doc_id")), casual)
    cols = layout.assign_columns(p, 2 if casual else 3).select("doc_id", "ord", "col")
    p = layout.place(p.withColumn("columns", n).join(cols, ["doc_id", "ord"]), height, width, F.col("columns"), **size)
    title = heads.select("doc_id", F.lit("title").alias("panel_id"), F.lit("title").alias("kind"), "title", F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("mode"), F.lit("title").alias("category"), F.lit(1.0).alias("weight"),
                         F.lit(None).cast("int").alias("columns"), F.lit(-1).alias("col"), F.lit(0).alias("row_in_col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(width).alias("w"), F.lit(height * size["title"]).alias("h"))
    content = p.select("doc_id", F.concat(F.lit("panel_"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("string")).alias("panel_id"), F.lit("content").alias("kind"), "title", "section_id", "mode", "category", "weight", "columns", "col", "row_in_col", "x", "y", "w", "h")
    both = title.unionByName(content).withColumn("columns", F.coalesce(F.max("columns").over(Window.partitionBy("doc_id")), F.lit(0)))
    return both.withColumn("panel_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("col", "row_in_col")) - 1)


def with_sources(plan: DataFrame, sections: DataFrame, figures: DataFrame, generated: DataFrame) -> DataFrame:
    """plan with its section's content and the picture that it shows: figures(doc_id, section_id, path) first, the one of the first path, else generated(doc_id, panel_id, path)."""
    own = figures.groupBy("doc_id", "section_id").agg(F.min("path").alias("_own"))
    made = generated.groupBy("doc_id", "panel_id").agg(F.min("path").alias("_made"))
    j = plan.join(sections.select("doc_id", "section_id", "content"), ["doc_id", "section_id"], "left").join(own, ["doc_id", "section_id"], "left").join(made, ["doc_id", "panel_id"], "left")
    return j.withColumn("picture", F.coalesce("_own", "_made")).drop("_own", "_made")


def nested(plan: DataFrame, fields: list[str]) -> DataFrame:
    """A row for each document: doc_id, title, columns as an array of arrays of panels (structs of `fields`), in order of column and row."""
    rows = plan.where("kind = 'content'").groupBy("doc_id", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_in_col", F.struct(*fields).alias("p")))), lambda x: x["p"]).alias("panels"))
    cols = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "panels"))), lambda x: x["panels"]).alias("columns"))
    return plan.where("kind = 'title'").select("doc_id", "title").join(cols, "doc_id", "left").withColumn("columns", F.coalesce("columns", F.array().cast(cols.schema["columns"].dataType)))
