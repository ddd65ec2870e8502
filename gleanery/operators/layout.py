"""Panels, their weights, columns and places. A document has few panels, so its columns are assigned by a fold inside the document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which categories are read.
READING = ["motivation", "methodology", "architecture", "dataset", "results", "analysis", "conclusion", "content"]


def importance(base: Column, word_count: Column) -> Column:
    """Only unmarked sections (base up to 1) gain by their length."""
    return F.when(base <= 1.0, base + F.least(word_count / 1500.0, F.lit(0.6))).otherwise(base)


def weight(importance_: Column, visual_source: Column, casual: bool = False) -> Column:
    a, b, c = (1.5, 1.4, 0.85) if casual else (1.3, 1.2, 0.90)
    return importance_ * F.when(visual_source == "original", a).when(visual_source == "generated", b).otherwise(c)


def visual_source(has_figure: Column, has_suggestion: Column, category: Column) -> Column:
    return F.when(has_figure, "original").when(has_suggestion & ~category.isin("motivation", "conclusion"), "generated").otherwise("none")


def layout_mode(content_type: Column, source: Column, category: Column) -> Column:
    return (F.when((content_type == "prose") & (source == "none"), "prose_only").when(content_type == "prose", "prose_with_figure")
            .when((content_type == "mixed") & (source == "original") & category.isin("results", "analysis"), "figure_dominant")
            .when((content_type == "mixed") & (source != "none") & category.isin("methodology", "architecture"), "side_by_side")
            .when(source == "none", "bullets_only").otherwise("standard"))


def max_bullets(content_type: Column, importance_: Column) -> Column:
    return F.when(content_type == "prose", 2).when(content_type == "mixed", 3).when(importance_ >= 1.3, 4).otherwise(3)


def reading_order(panels: DataFrame) -> DataFrame:
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, READING)), F.col("category")), F.lit(0)), F.lit(99))
    return panels.withColumn("reading_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "ord")))


def column_count(panels: Column, casual: bool = False) -> Column:
    return F.when(panels <= 1, 1).otherwise(2) if casual else F.when(panels <= 2, F.greatest(panels, F.lit(1))).otherwise(3)


def assign_columns(panels: DataFrame, columns: int = 3) -> DataFrame:
    """panels(doc_id, ord, weight, mode, category) -> with col: the first `columns` panels open a column each; then the preferred column, if its load is at most 1.3
    times the least load, else the first least loaded one."""
    items = F.array_sort(F.collect_list(F.struct("ord", "weight", "mode", "category")))
    n = columns
    start = F.struct(F.array().cast("array<int>").alias("cols"), F.array_repeat(F.lit(0.0), n).alias("load"))

    def step(s: Column, p: Column) -> Column:
        i, least = F.size(s["cols"]), F.array_min(s["load"])
        wish = F.when(p["mode"].isin("figure_dominant", "side_by_side"), 1).when(p["category"].isin("results", "analysis"), n - 1) if n >= 3 else F.lit(None).cast("int")
        first_least = (F.array_position(s["load"], least) - 1).cast("int")
        good = F.element_at(s["load"], F.coalesce(wish, F.lit(0)) + 1) <= least * 1.30
        c = F.when(i < n, i).when(wish.isNotNull() & good, wish).otherwise(first_least)
        return F.struct(F.concat(s["cols"], F.array(c)).alias("cols"), F.transform(s["load"], lambda x, k: F.when(k == c, x + p["weight"]).otherwise(x)).alias("load"))

    g = panels.groupBy("doc_id").agg(items.alias("items")).withColumn("cols", F.aggregate("items", start, step, lambda s: s["cols"]))
    z = g.select("doc_id", F.explode(F.arrays_zip("items", "cols")).alias("z"))
    return z.select("doc_id", "z.items.ord", "z.items.weight", "z.items.mode", "z.items.category", F.col("z.cols").alias("col"))


def place(panels: DataFrame, height: float = 36.0, width: float = 48.0, columns: int = 3, title: float = 0.10, margin: float = 0.12, gutter: float = 0.40, least: float = 0.10, most: float = 0.48) -> DataFrame:
    """panels(doc_id, ord, weight, col) -> with row_in_col, x, y, w, h: heights by share of weight, clipped, then scaled to fill the column."""
    top, bottom = height * title + gutter, height - margin - 0.15
    content, col_w = bottom - top, (width - 2 * margin - gutter * (columns - 1)) / columns
    by, run = Window.partitionBy("doc_id", "col"), Window.partitionBy("doc_id", "col").orderBy("ord")
    p = panels.withColumn("row_in_col", F.row_number().over(run) - 1).withColumn("_k", F.count(F.lit(1)).over(by)).withColumn("_room", content - gutter * (F.col("_k") - 1))
    p = p.withColumn("_h", F.greatest(F.least(F.col("weight") / F.sum("weight").over(by) * F.col("_room"), F.lit(most * content)), F.lit(least * content)))
    p = p.withColumn("h", F.col("_h") * F.col("_room") / F.sum("_h").over(by))
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    return (p.withColumn("y", top + F.coalesce(F.sum(F.col("h") + gutter).over(before), F.lit(0.0))).withColumn("x", margin + F.col("col") * (col_w + gutter)).withColumn("w", F.lit(col_w)).drop("_k", "_room", "_h"))


def clamp_flex(panels: DataFrame, share: float = 0.48, rounds: int = 20) -> DataFrame:
    """panels(doc_id, col, ord, weight) -> with flex: no panel over its share of the column's total; what is cut goes to the others in proportion, at most `rounds` times."""
    g = panels.groupBy("doc_id", "col").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("weight").cast("double").alias("w")))).alias("items"))
    ws, total = F.transform("items", lambda s: s["w"]), F.aggregate(F.transform("items", lambda s: s["w"]), F.lit(0.0), lambda a, x: a + x)

    def one(cur: Column, _: Column) -> Column:
        top = total * share
        over = F.aggregate(cur, F.lit(0.0), lambda a, x: a + F.greatest(x - top, F.lit(0.0)))
        free = F.aggregate(cur, F.lit(0.0), lambda a, x: a + F.when(x < top, x).otherwise(0.0))
        return F.when((over <= 1e-9) | (free <= 0) | (F.size(cur) < 3), cur).otherwise(F.transform(cur, lambda x: F.when(x >= top, top).otherwise(x * (free + over) / free)))

    g = g.withColumn("flex", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), ws, one))
    return g.select("doc_id", "col", F.explode(F.arrays_zip("items", "flex")).alias("z")).select("doc_id", "col", "z.items.ord", F.col("z.items.w").alias("weight"), "z.flex")


def text_scale(words: Column, has_visual: Column, mode: Column) -> Column:
    """The font scale of a panel by its words; figure-dominant and side-by-side panels have a ceiling."""
    with_visual = F.when(words <= 45, 1.08).when(words <= 70, 1.05).when(words <= 95, 1.03).otherwise(1.0)
    alone = F.when(words <= 40, 1.18).when(words <= 60, 1.13).when(words <= 90, 1.08).when(words <= 130, 1.04).otherwise(1.0)
    s = F.when(words == 0, 1.0).when(has_visual, with_visual).otherwise(alone)
    return F.when(mode == "figure_dominant", F.least(s, F.lit(1.03))).when(mode == "side_by_side", F.least(s, F.lit(1.05))).otherwise(s)


# Change and bounds of each style variable by issue, applied in this order.
FIXES = [
    ("overflow", {"font_scale": (-0.05, 0.90, 1.00)}),
    ("too_blank", {"font_scale": (0.03, 0.90, 1.10), "text_scale": (0.06, 0.85, 1.15), "visual_scale": (0.08, 0.85, 1.35), "visual_flex": (0.08, 0.85, 1.35)}),
    ("visual_too_small", {"text_scale": (-0.04, 0.80, 1.05), "visual_scale": (0.15, 0.90, 1.40), "visual_flex": (0.15, 0.85, 1.40)}),
    ("visual_too_large", {"text_scale": (0.05, 0.80, 1.20), "visual_scale": (-0.10, 0.75, 1.20), "visual_flex": (-0.10, 0.75, 1.20)}),
]
STYLE = ["font_scale", "text_scale", "visual_scale", "visual_flex"]


def clean_issues(issues: Column) -> Column:
    kept = F.array_intersect(issues, F.array(*map(F.lit, ["good", *[n for n, _ in FIXES]])))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("good")))


def apply_fixes(panels: DataFrame, issues_col: str = "issues") -> DataFrame:
    """Style variables (1 where absent) after a judgement; a panel judged exactly good stays as it is."""
    df = panels.withColumn("_i", clean_issues(F.col(issues_col)))
    for v in STYLE:
        x = F.coalesce(F.col(v), F.lit(1.0)) if v in panels.columns else F.lit(1.0)
        for name, changes in FIXES:
            if v in changes:
                d, low, high = changes[v]
                x = F.when(F.array_contains("_i", name), F.greatest(F.least(x + d, F.lit(high)), F.lit(low))).otherwise(x)
        df = df.withColumn(v, F.round(x, 3))
    return df.drop("_i")
