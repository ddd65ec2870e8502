"""Model answers as typed tables. An answer is read as VARIANT and each field is tested for its type, so a field of a wrong type costs that field (it gets its default) and not
the answer. Only what does not parse goes through the JSON repair, which is the one step in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jsonrepair import repair_json
from . import layout

# Content types, panel categories, visual types and their defaults; words of a sub-header.
CONTENT_TYPES = ["prose", "bullets", "mixed"]
CATEGORIES = ["motivation", "methodology", "architecture", "results", "analysis", "conclusion", "dataset", "content"]
VISUAL_TYPES = ["flowchart", "architecture_diagram", "bar_chart", "line_chart", "pipeline", "comparison", "concept_diagram", "table", "infographic", "matrix"]
DEFAULT_TYPE, DEFAULT_CATEGORY, DEFAULT_VISUAL, DEFAULT_THEME, HEADER_WORDS = "bullets", "content", "concept_diagram", "paper_clean", 6
# Text fields of an answer about a whole document.
GLOBAL_TEXTS = ["affiliation", "key_contribution", "headline_result", "summary", "narrative_arc", "paper_domain", "methodology_summary", "results_summary", "venue"]


def variant_of(answers: DataFrame, column: str = "response", name: str = "answer") -> DataFrame:
    """answers with the object in a response as VARIANT: fences and talk around it go; null where even the repair finds none."""
    df = answers.withColumn("_plain", F.try_parse_json(T.outer_object(F.col(column))))
    broken = F.when(F.col("_plain").isNull(), F.col(column))
    mended = F.try_parse_json(repair_json(broken))
    v = F.coalesce(F.col("_plain"), mended)
    return df.withColumn(name, F.when(kind(v) == "OBJECT", v)).drop("_plain")


def kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def string(v: Column) -> Column:
    """The value if it is a string."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text(v: Column, path: str, default: Column | str = "") -> Column:
    return F.coalesce(string(at(v, path)), default if isinstance(default, Column) else F.lit(default))


def items(v: Column, path: str) -> Column:
    """The elements of an array as variants; none if it is no array."""
    return F.coalesce(F.when(kind(at(v, path)) == "ARRAY", F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def strings(v: Column, path: str) -> Column:
    return F.filter(F.transform(items(v, path), string), lambda s: s.isNotNull())


def objects(v: Column, path: str) -> Column:
    return F.filter(items(v, path), lambda x: kind(x) == "OBJECT")


def entries(v: Column, path: str) -> Column:
    """An object's fields as a map of variants; empty if it is none."""
    return F.coalesce(F.when(kind(at(v, path)) == "OBJECT", F.try_variant_get(v, path, "map<string,variant>")), F.create_map().cast("map<string,variant>"))


def whole_number(v: Column) -> Column:
    """An integer, a number's whole part, or a string of digits, as int() takes them."""
    digits = F.when(F.rlike(string(v), F.lit(r"^\s*[+-]?\d{1,9}\s*$")), F.trim(string(v)).try_cast("int"))
    number = F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double").try_cast("int"))
    return F.coalesce(digits, number)


def one_of(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def section_answers(answers: DataFrame, v: str = "answer") -> DataFrame:
    """answers(..., answer, section_id, title, importance, figure_ids) with content_type, lead_paragraph, bullets (capped by the type), sub_headers (within the bullets), provenance,
    key_message, panel_title (the section's where the answer has none) and figure_ids of section and answer together. A null answer gives the defaults."""
    a = F.col(v)
    ct = one_of(F.lower(F.trim(text(a, "$.content_type"))), CONTENT_TYPES, DEFAULT_TYPE)
    df = answers.withColumns({"content_type": ct, "lead_paragraph": F.trim(text(a, "$.lead_paragraph")), "key_message": text(a, "$.key_message")})
    df = df.withColumn("bullets", T.cap_bullets(strings(a, "$.bullets"), layout.max_bullets(F.col("content_type"), F.col("importance"))))
    header = lambda x: F.struct(whole_number(at(x, "$.after_bullet_index")).alias("after_bullet_index"), T.first_words(text(x, "$.text"), HEADER_WORDS).alias("text"))
    headers = F.filter(F.transform(objects(a, "$.sub_headers"), header), lambda h: (h["text"] != "") & (h["after_bullet_index"] >= 0) & (h["after_bullet_index"] < F.size("bullets")))
    source = lambda x: F.struct(F.col("section_id").cast("string").alias("source_section_id"), string(at(x, "$.source_chunk_id")).alias("source_chunk_id"), text(x, "$.source_text_span").alias("source_text_span"))
    own = F.coalesce("figure_ids", F.array().cast("array<string>"))
    return df.withColumns({"sub_headers": headers, "provenance": F.transform(objects(a, "$.provenance"), source), "panel_title": T.first_words(text(a, "$.poster_section_title", F.col("title")), 4),
                           "figure_ids": F.sort_array(F.array_distinct(F.concat(own, strings(a, "$.recommended_figure_ids"))))})


def global_answers(answers: DataFrame, v: str = "answer") -> DataFrame:
    """answers(..., answer, title, authors) with the fields of an analysis of the whole document: texts, sections_to_include, section_importance (numbers only),
    section_categories (unknown ones are content), essential_figure_ids, visual_suggestions (unknown types are concept diagrams)."""
    a = F.col(v)
    numbers = F.map_filter(F.transform_values(entries(a, "$.section_importance"), lambda k, x: F.when(kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(x, "$", "double"))), lambda k, x: x.isNotNull())
    categories = F.transform_values(entries(a, "$.section_categories"), lambda k, x: one_of(F.coalesce(string(x), F.lit("")), CATEGORIES, DEFAULT_CATEGORY))
    visual = lambda x: F.struct(text(x, "$.concept").alias("concept"), text(x, "$.description").alias("description"), one_of(text(x, "$.visual_type"), VISUAL_TYPES, DEFAULT_VISUAL).alias("visual_type"), strings(x, "$.data_points").alias("data_points"))
    found = {f: text(a, f"$.{f}") for f in GLOBAL_TEXTS} | {"poster_title": text(a, "$.poster_title", F.col("title")), "poster_authors": text(a, "$.authors", F.col("authors")), "color_theme": text(a, "$.suggested_color_theme", DEFAULT_THEME)}
    found |= {"sections_to_include": strings(a, "$.sections_to_include"), "essential_figure_ids": strings(a, "$.essential_figure_ids"), "section_importance": numbers, "section_categories": categories}
    return answers.withColumns(found | {"visual_suggestions": F.transform(objects(a, "$.visual_suggestions"), visual)})
