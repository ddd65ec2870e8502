"""Quiz and judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import answer_letter

MEDIAN_WORDS = 774
AESTHETIC, INFORMATION = ["element", "layout", "engagement"], ["clarity", "content", "logic"]


def density_score(raw: Column, length_words: Column, median_words: int = MEDIAN_WORDS) -> Column:
    """raw x (1 + 1 / max(1, length / median)): at most twice the raw score."""
    if median_words <= 0:
        raise ValueError("median_words must be positive")
    return raw * (1 + 1 / F.greatest(F.lit(1.0), length_words / float(median_words)))


def judge_score(value: Column) -> Column:
    """A whole number from 1 to 5, clamped; null if it isn't a number."""
    return F.least(F.greatest(value.try_cast("int"), F.lit(1)), F.lit(5))


def quiz_scores(items: DataFrame, answers: DataFrame, strict_reference: bool = False) -> DataFrame:
    """items(doc_id, qtype, qid, gold, perhaps idx), answers(doc_id, model, qid, answer, reference) -> correct, total, accuracy for each doc_id, model and qtype.
    The letters that gold and answer open with are compared. An item's answer is the one of its qid, else the one named `Question <idx>`. NA is never right and stays in
    the denominator; strict_reference treats an answer without reference as NA; two empty letters are not right."""
    na = F.upper(F.trim("answer")) == "NA"
    a = answers.select("doc_id", "model", "qid", (na | (F.upper(F.trim("reference")) == "NA") if strict_reference else na).alias("na"), answer_letter(F.col("answer")).alias("letter"))
    j = items.join(answers.select("doc_id", "model").distinct(), "doc_id").join(a, ["doc_id", "model", "qid"], "left")
    if "idx" in items.columns:
        named = a.select("doc_id", "model", F.col("qid").alias("_named"), F.col("na").alias("_na"), F.col("letter").alias("_letter"))
        j = j.withColumn("_named", F.concat(F.lit("Question "), F.col("idx").cast("string"))).join(named, ["doc_id", "model", "_named"], "left")
        j = j.withColumn("letter", F.when(F.col("na").isNull(), F.col("_letter")).otherwise(F.col("letter"))).withColumn("na", F.coalesce("na", "_na"))
    right = F.coalesce(~F.col("na") & (F.col("letter") != "") & (F.col("letter") == answer_letter(F.col("gold"))), F.lit(False))
    return (j.groupBy("doc_id", "model", "qtype").agg(F.sum(F.when(right, 1).otherwise(0)).alias("correct"), F.count(F.lit(1)).alias("total"))
            .withColumn("accuracy", F.col("correct") / F.greatest(F.col("total"), F.lit(1))))


def model_means(scores: DataFrame) -> DataFrame:
    """Overall accuracy a model, then the unweighted mean over models."""
    per = scores.groupBy("doc_id", "model").agg((F.sum("correct") / F.greatest(F.lit(1), F.sum("total"))).alias("overall"), F.sum("correct").alias("raw"))
    return per.groupBy("doc_id").agg(F.avg("overall").alias("overall"), F.avg("raw").alias("raw"), F.count(F.lit(1)).alias("models"))


def reader_means(scores: DataFrame, lengths: DataFrame) -> DataFrame:
    """quiz_scores and lengths(doc_id, words) -> doc_id and the unweighted means over models of the accuracies of both kinds of questions, the score, the accuracy over both, and the
    score augmented by density. A model without questions of a kind has accuracy 0 in it; a document without a length counts as empty."""
    kind = lambda name: F.coalesce(F.max(F.when(F.col("qtype") == name, F.col("accuracy"))), F.lit(0.0))
    per = scores.groupBy("doc_id", "model").agg(kind("verbatim").alias("v"), kind("interpretive").alias("i"), F.sum("correct").alias("score"), F.sum("total").alias("total"))
    j = per.join(lengths.select("doc_id", "words"), "doc_id", "left")
    j = j.withColumn("accuracy", F.col("score") / F.greatest(F.lit(1), F.col("total"))).withColumn("aug", density_score(F.col("score"), F.coalesce("words", F.lit(0))))
    return j.groupBy("doc_id").agg(F.avg("v").alias("verbatim_raw"), F.avg("i").alias("interpretive_raw"), F.avg("score").alias("overall_score"), F.avg("accuracy").alias("overall_accuracy"), F.avg("aug").alias("overall_aug"))


def visual_perplexity(panels: DataFrame, images: DataFrame, by: str = "doc_id", panel: str = "panel") -> DataFrame:
    """panels(by, panel, text), images(panel, ppl) -> by, visual_ppl: the mean over the images of panels that have text; 0 where there are none, null where an image has no value."""
    p = panels.select(by, panel, F.coalesce(F.col("text") != "", F.lit(False)).alias("said"))
    j = p.join(images.select(F.col(panel), "ppl", F.lit(1).alias("_i")), panel, "left")
    counted = F.col("said") & F.col("_i").isNotNull()
    g = j.groupBy(by).agg(F.avg(F.when(counted, F.col("ppl"))).alias("m"), F.sum(F.when(counted, 1).otherwise(0)).alias("n"), F.sum(F.when(counted & F.col("ppl").isNull(), 1).otherwise(0)).alias("unknown"))
    return g.select(by, F.when(F.col("n") == 0, 0.0).when(F.col("unknown") == 0, F.col("m")).alias("visual_ppl"))


def judge_means(scores: DataFrame) -> DataFrame:
    """scores(doc_id, criterion, score) -> means of three, three and six criteria; nulls do not count, no score gives null."""
    of = lambda names: F.avg(F.when(F.col("criterion").isin(*names), F.col("score")))
    return scores.groupBy("doc_id").agg(of(AESTHETIC).alias("aesthetic"), of(INFORMATION).alias("information"), of(AESTHETIC + INFORMATION).alias("overall"))
