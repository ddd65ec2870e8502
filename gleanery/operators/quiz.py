"""Quiz questions from their JSON forms, payloads without answers, prefixes of image context within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection

QUESTION = "struct<question:string,options:array<string>,choices:array<string>,answer:string,aspect:string>"


def _either(block: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A member that is an object (by key) or a list (by place): both readings, one of them null."""
    raw = F.get_json_object(block, f"$.{name}")
    as_map = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.from_json(raw, f"map<string,{kind}>"))
    as_list = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, f"array<{kind}>"))
    return as_map, as_list


def items_of(block: Column, qtype: str) -> Column:
    """array of struct(qid, question, options, answer, aspect, qtype) of a block in any of three forms: questions keyed by name, a list of questions, or the names
    themselves as members; answers and aspects beside them, keyed or listed, override those inside a question. Named questions go by their number."""
    empty = F.array().cast(f"array<struct<key:string,place:int,q:{QUESTION}>>")
    q_map, q_list = _either(block, "questions", QUESTION)
    bare = F.when(F.get_json_object(block, "$.questions").isNull(), F.from_json(block, f"map<string,{QUESTION}>"))
    by_name = F.array_sort(F.transform(F.map_entries(F.coalesce(q_map, bare)), lambda e: F.struct(
        F.coalesce(F.regexp_extract(e["key"], r"(\d+)", 1).try_cast("int"), F.lit(1_000_000_000)).alias("n"), e["key"].alias("key"), e["value"].alias("q"))))
    named = F.transform(by_name, lambda s, i: F.struct(s["key"].alias("key"), i.alias("place"), s["q"].alias("q")))
    listed = F.transform(q_list, lambda q, i: F.struct(F.concat(F.lit("Question "), (i + 1).cast("string")).alias("key"), i.alias("place"), q.alias("q")))
    a_map, a_list = _either(block, "answers", "string")
    s_map, s_list = _either(block, "aspects", "string")
    pick = lambda m, a, x: F.coalesce(F.try_element_at(m, x["key"]), F.try_element_at(a, x["place"] + 1))
    return F.transform(F.coalesce(named, listed, empty), lambda x: F.struct(
        x["key"].alias("qid"), F.coalesce(x["q"]["question"], F.lit("")).alias("question"), F.coalesce(x["q"]["options"], x["q"]["choices"], F.array().cast("array<string>")).alias("options"),
        F.coalesce(pick(a_map, a_list, x), x["q"]["answer"], F.lit("")).alias("answer"), F.coalesce(pick(s_map, s_list, x), x["q"]["aspect"]).alias("aspect"), F.lit(qtype).alias("qtype")))


def load(quizzes: DataFrame, text_col: str = "text") -> DataFrame:
    """quizzes(doc_id, text of JSON) -> doc_id, pos, qid, question, options, answer, aspect, qtype; detail or verbatim, then understanding or interpretive."""
    part = lambda *names: F.coalesce(*[F.get_json_object(F.col(text_col), f"$.{n}") for n in names])
    both = F.concat(F.coalesce(items_of(part("detail", "verbatim"), "verbatim"), F.array()), F.coalesce(items_of(part("understanding", "interpretive"), "interpretive"), F.array()))
    return quizzes.select("doc_id", F.posexplode(both).alias("pos", "i")).select("doc_id", "pos", "i.*")


def payload(items: DataFrame) -> DataFrame:
    """The questions as one JSON object a document, without answers; a name that occurs again becomes Question and its place."""
    n = F.row_number().over(selection.Window.partitionBy("doc_id", "qid").orderBy("pos"))
    key = F.when(n > 1, F.concat(F.lit("Question "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("qid"))
    e = items.withColumn("_k", key).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("_k").alias("k"), "question", "options"))).alias("a"))
    return e.select("doc_id", F.to_json(F.map_from_entries(F.transform("a", lambda s: F.struct(s["k"], F.struct(s["question"].alias("question"), s["options"].alias("options")))))).alias("payload"))


def shuffled(items: DataFrame) -> DataFrame:
    """Options in a fixed shuffle, relabelled A to D, with the answer's new letter."""
    o = selection.shuffled_options(F.col("options"), F.concat_ws(":", "doc_id", "qid"))
    right = F.try_element_at("options", F.ascii(F.upper(F.substring(F.trim("answer"), 1, 1))) - 64)
    d = items.withColumn("_o", o).withColumn("_r", right)
    letter = F.char(F.array_position("_o", F.col("_r")) + 64)
    return d.withColumn("options", F.transform("_o", lambda x, i: F.concat(F.char(i + 65), F.lit(". "), F.regexp_replace(x, r"^[A-D][.)]\s*", "")))).withColumn("answer", F.when(F.col("_r").isNotNull(), letter).otherwise(F.col("answer"))).drop("_o", "_r")


def image_prefix(images: DataFrame, by: str, most_tokens: int = 128_000, most_bytes: int = 45 << 20) -> DataFrame:
    """images(by, ord, width, height, bytes) in order while tokens (28-pixel patches) and bytes stay within both budgets; the first breach ends it."""
    tokens = (F.ceil(F.col("height") / 28) * F.ceil(F.col("width") / 28)).alias("tokens")
    d = images.select("*", tokens)
    both = selection.prefix_budget(d, [by], ["ord"], "tokens", most_tokens).drop("running")
    return selection.prefix_budget(both, [by], ["ord"], "bytes", most_bytes).drop("running")
