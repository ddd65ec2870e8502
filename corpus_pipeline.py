"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, token ids; each stage an operator of gleanery.llm, written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import bpe, mixing, neardup, pii
from gleanery.llm import toxicity as tox
from gleanery.llm.common import MADE, Scratch, free_name, read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.3 or more go. Null and empty texts score as texts without a known term; repeated rows score alike; rows without an
    id are scored too; an empty table stays empty; columns named as the score are kept."""
    model = tox.train(docs, read_table(spark, sf_dir, "labels"))
    names = free_name(docs, "_score"), free_name(docs, "_toxic")
    return tox.score(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one with the smallest id. Rows equal in id and text count as copies (the row
    with the smallest hash stays); rows of one id with different texts stay or go together. Null and empty texts are near nothing; rows without an id can't be told apart by
    one and stay; an empty table stays empty."""
    marks = neardup.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    h = F.xxhash64(*docs.columns)
    row = free_name(docs, "_row")
    same = Window.partitionBy("doc_id", F.xxhash64("text"), F.when(F.col("doc_id").isNull(), h)).orderBy(h)
    left = docs.join(marks, "doc_id", "left_anti").withColumn(row, F.row_number().over(same))
    return left.where(F.col("doc_id").isNull() | (F.col(row) == 1)).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text, if it is there. Every row stays: null and empty texts as they are, repeated rows alike."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling takes it, 0 to 3 times. Documents without words have size 0 and are drawn at their source's rate, sources of size 0 not at
    all; a null source is a source; repeated rows are drawn by themselves; an empty table stays empty."""
    mixed = mixing.mix(docs, carry=docs.columns).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("_carried", F.col("copies").cast("int"))).alias("d")).select("d.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number, a row for each row; null and empty texts have none."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("token_ids", token_ids)]

#: A fitted machine and a hashed sketch decide here; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage and its operators wrote goes as soon as the next table stands."""
    scratch, docs, last = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = len(MADE)
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        for made in MADE[before:]:
            made.drop_all()
        del MADE[before:]
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
