"""Model answers about sections made whole: merged over chunks, joined to sections, bounded in number, accepted or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The order in which categories get visuals, bounds on the number of visuals, visuals that show data, words that data needs, venues.
VISUAL_ORDER = ["methodology", "architecture", "results", "analysis", "motivation", "dataset"]
LEAST_VISUALS, MOST_VISUALS = 6, 12
DATA_VISUALS = ["bar", "line", "table", "comparison"]
SOURCE_WORDS = 20
VENUES = ["NeurIPS", "ICML", "ICLR", "CVPR", "ICCV", "ECCV", "ACL", "EMNLP", "NAACL", "AAAI", "IJCAI", "SIGIR", "WWW", "KDD", "ICRA", "RSS", "CORL"]


def merged(answers: DataFrame, by: list[str], order: str) -> DataFrame:
    """answers(by, order, title, key_message, bullets, figures) of a section's chunks as one row: the first title and message that aren't empty, bullets in order without
    repeats (case does not count), figures without repeats, and the provenance (array of structs) of all chunks in order, if there is such a column. A section's chunks are few, so
    their lists meet in its row."""
    first = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(order, F.col(c).alias("v"))))["v"]
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast("array<string>"))))
    more = "provenance" in answers.columns
    kept = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("provenance").isNotNull(), F.struct(order, F.col("provenance").alias("v"))))), lambda x: x["v"])) if more else None
    g = answers.groupBy(*by).agg(*([kept.alias("provenance")] if more else []), F.coalesce(first("title"), F.lit("")).alias("title"), F.coalesce(first("key_message"), F.lit("")).alias("key_message"), listed("bullets").alias("_b"), listed("figures").alias("_f"))
    return g.select(*by, "title", "key_message", distinct_bullets(F.col("_b")).alias("bullets"), F.array_distinct("_f").alias("figures"), *(["provenance"] if more else []))


def distinct_bullets(bullets: Column) -> Column:
    """Trimmed bullets in order, the first of those equal but for case."""
    clean = F.filter(F.transform(bullets, lambda b: F.trim(b)), lambda b: b.isNotNull() & (b != ""))
    keys = F.transform(clean, lambda b: F.lower(b))
    return F.filter(clean, lambda b, i: F.array_position(keys, F.lower(b)) == i + 1)


def visual_target(included: Column, figures: Column) -> Column:
    """How many visuals to ask for: one a section, six at least (eight sections if none are named), seven from six figures on, nine from ten, twelve at most."""
    n = F.greatest(F.lit(LEAST_VISUALS), F.when(included <= 0, 8).otherwise(included))
    return F.least(F.greatest(n, F.when(figures >= 10, 9).when(figures >= 6, 7).otherwise(0)), F.lit(MOST_VISUALS)).cast("int")


def visuals_to_sections(sections: DataFrame, visuals: DataFrame, by: str = "doc_id") -> DataFrame:
    """sections(by, ord, section_id, category), visuals(by, visual_no, ...) -> by, section_id, visual_no: sections in order of category, then of the document, take visuals in
    order, each once, until either runs out. Where no section of a document has a category, sections take them in the document's order."""
    rank = F.array_position(F.array(*map(F.lit, VISUAL_ORDER)), F.col("category"))
    s = sections.withColumn("_any", F.max((F.coalesce("category", F.lit("")) != "").cast("int")).over(Window.partitionBy(by)) == 1).withColumn("_rank", F.when(F.col("_any"), rank).otherwise(1)).where("_rank > 0")
    s = s.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("_rank", "ord")))
    v = visuals.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy("visual_no")))
    return s.select(by, "section_id", "_i").join(v.select(by, "visual_no", "_i"), [by, "_i"]).drop("_i")


def accepted_points(kind: Column, source: Column, found: Column, new: Column, old: Column) -> Column:
    """New data points if the visual shows data, its source has words enough, data were found and there are two points or more; else the old ones."""
    good = kind.isin(*DATA_VISUALS) & (T.word_count(source) >= SOURCE_WORDS) & found & (F.size(new) >= 2)
    return F.when(F.coalesce(good, F.lit(False)), new).otherwise(old)


def strongest(df: DataFrame, by: list[str], weight: list, order: str, k: int = 7) -> DataFrame:
    """The k of most weight of each group, numbered in the original order."""
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*weight, order))).where(F.col("_n") <= k).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def venue(named: Column, narrative: Column) -> Column:
    """The named venue, else the first known one with a year in the narrative."""
    return F.coalesce(F.nullif(F.trim(named), F.lit("")), F.regexp_extract(F.coalesce(narrative, F.lit("")), r"(?i)\b(?:" + "|".join(VENUES) + r")\s*[0-9]{4}\b", 0))


def last_before(points: DataFrame, heads: DataFrame, by: str, at: str = "at", name: str = "head") -> DataFrame:
    """points(by, at, ...) with the name of the last head (by, at, name) at or before each: an as-of join by one ordered pass over both, so neither side is repeated; points before
    every head get the first."""
    p = points.withColumn("_head", F.lit(None).cast(heads.schema[name].dataType)).withColumn("_point", F.lit(1))
    h = heads.select(by, at, F.col(name).alias("_head")).withColumn("_point", F.lit(0))
    w = Window.partitionBy(by).orderBy(at, "_point")
    both = p.unionByName(h, allowMissingColumns=True)
    first = F.first("_head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = F.coalesce(F.last("_head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first)
    return both.withColumn(name, found).where("_point = 1").drop("_point", "_head")


def windows(tokens: Column, most: int) -> Column:
    """Windows over a text of so many tokens, half a window apart: array of (start, stop, scored), the last ending with the text. In windows after the first only the last half
    counts."""
    stride = most // 2
    starts = F.when(tokens > 0, F.sequence(F.lit(0).cast("long"), F.greatest(tokens - 1, F.lit(0)).cast("long"), F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + most, tokens.cast("long")).alias("stop"), F.when(s == 0, F.least(F.lit(most).cast("long"), tokens.cast("long"))).otherwise(F.least(F.lit(stride).cast("long"), tokens - s)).alias("scored")))
    return F.filter(made, lambda x: (x["start"] == 0) | (x["start"] + (most - stride) < tokens))
