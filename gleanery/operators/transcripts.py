"""Transcripts: segments to paragraphs, labels by time and keywords, runs of one label to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T

# Labels in order, and the share of the talk from which each holds.
BOUNDS = [(0.00, "introduction"), (0.15, "background"), (0.28, "methods"), (0.52, "experiments"), (0.72, "results"), (0.88, "conclusion")]
LABELS = [name for _, name in BOUNDS]
PAUSE, BUDGET = 1.8, 150
# Phrases that speak for a label, titles of the labels, least words of a section and of an abstract.
SIGNALS = {
    "introduction": ["i'm here to", "i'll share", "i'll talk about", "today i", "in this talk", "let me start", "let me begin", "i want to present", "we address", "the problem", "the challenge",
                     "our goal", "our motivation", "why this matters", "the question", "contributions", "overview", "in this work", "in this paper", "we present", "we introduce"],
    "background": ["related work", "prior work", "previous work", "background", "existing", "traditional", "state of the art", "literature", "conventional", "earlier work", "has been studied",
                   "has been shown", "researchers have", "studies have", "prior research"],
    "methods": ["our approach", "our method", "our system", "our model", "we design", "we propose", "the key idea", "the main idea", "the idea is", "our framework", "the algorithm", "specifically",
                "concretely", "the way we", "what we built", "how it works", "the design", "knowledge engineering", "interface design", "system design", "we developed", "we built", "we created",
                "our solution"],
    "experiments": ["we evaluate", "we conducted", "we ran", "study", "user study", "experiment", "evaluation", "participants", "we recruited", "we collected", "dataset", "we tested", "our study",
                    "we measured", "procedure", "we asked", "conditions"],
    "results": ["result", "finding", "we found", "we observed", "we saw", "significantly", "improvement", "better", "worse", "accuracy", "performance", "score", "compared to", "outperform",
                "the data show", "the analysis", "figure shows", "table shows", "p value", "effect", "students", "participants showed"],
    "conclusion": ["in conclusion", "to summarize", "in summary", "to conclude", "we showed", "we have shown", "future work", "limitation", "takeaway", "key insight", "to wrap up", "thank you",
                   "open question", "next step", "moving forward", "overall", "what we learned", "implication"],
}
TITLES = {"introduction": "Introduction", "background": "Background & Related Work", "methods": "Method", "experiments": "Experimental Setup", "results": "Results & Findings", "conclusion": "Conclusion"}
LEAST_WORDS, ABSTRACT_WORDS = 40, 25


def sessions(segments: DataFrame, by: str, pause: float = PAUSE) -> DataFrame:
    """segments(by, ord, start, duration) -> with session: a new one after each gap over the pause."""
    w = Window.partitionBy(by).orderBy("start", "ord")
    cut = F.when(F.col("start") - (F.lag("start").over(w) + F.lag("duration").over(w)) > pause, 1).otherwise(0)
    return segments.withColumn("_cut", cut).withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def paragraphs(segments: DataFrame, by: str, pause: float = PAUSE, budget: int = BUDGET) -> DataFrame:
    """segments(by, ord, text, start, duration) -> by, para, start, segments, words. A paragraph closes after a pause (if more than a quarter of the segments have a
    time), at the word budget, or at the end. The budget restarts at each close, so word counts are folded in order, within a row of numbers for each transcript."""
    w = Window.partitionBy(by).orderBy("start", "ord")
    s = segments.select(by, "ord", "start", T.word_count(F.col("text")).cast("int").alias("n"), F.coalesce(F.lead("start").over(w) - (F.col("start") + F.col("duration")) > pause, F.lit(False)).alias("gap"))
    g = s.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("start", "ord", "n", "gap"))).alias("a"), (F.sum((F.col("start") > 0.01).cast("int")) > F.floor(F.count(F.lit(1)) / 4)).alias("timed"))
    full = lambda n, x: F.when((x["gap"] & F.col("timed")) | (n >= budget), -1).otherwise(n)
    have = A.scan(F.col("a"), F.lit(0), lambda last, x: full(F.greatest(last, F.lit(0)) + x["n"], x))  # words so far, or -1 where a paragraph closes
    g = g.withColumn("para", A.let(have, lambda h: A.sums(F.transform(h, lambda n, i: F.when((i > 0) & (F.get(h, i - 1) == -1), 1).otherwise(0)))))
    z = g.select(by, F.explode(F.arrays_zip("a", "para")).alias("z"))
    out = z.groupBy(by, (F.col("z.para") + 1).alias("para")).agg(F.min("z.a.start").alias("start"), F.count(F.lit(1)).cast("int").alias("segments"), F.sum("z.a.n").cast("int").alias("words"))
    return out.select(by, F.col("para").cast("int").alias("para"), F.col("start").cast("double").alias("start"), "segments", "words")


def with_share(segments: DataFrame, by: str, least: float = 30.0) -> DataFrame:
    """segments(by, ord, start, duration) with share: the place in the talk, by time where it lasts longer than `least` seconds (to the last end of what begins after 0), else in order."""
    w, whole = Window.partitionBy(by).orderBy("start", "ord"), Window.partitionBy(by)
    total = F.coalesce(F.max(F.when(F.col("start") > 0, F.col("start") + F.col("duration"))).over(whole), F.lit(0.0))
    order = (F.row_number().over(w) - 1) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1))
    return segments.withColumn("_t", total).withColumn("share", F.when(F.col("_t") > least, F.least(F.col("start") / F.col("_t"), F.lit(1.0))).otherwise(order)).drop("_t")


def label_index(share: Column) -> Column:
    """0 to 5: the last bound that the share has passed."""
    out = F.lit(0)
    for i, (at, _) in enumerate(BOUNDS[1:], 1):
        out = F.when(share >= at, i).otherwise(out)
    return out


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases the text contains, each counted once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def advanced(idx: Column, text: Column) -> Column:
    """The label by time, one further where two more phrases of the next label occur than of its own."""
    hits = F.array(*[phrase_hits(text, SIGNALS[name]) for name in LABELS])
    ahead = F.get(hits, idx + 1) >= F.get(hits, idx) + 2
    return F.when((idx < len(LABELS) - 1) & F.coalesce(ahead, F.lit(False)), idx + 1).otherwise(idx).cast("int")


def merge_short(sections: DataFrame, by: str, order: str, least: int = LEAST_WORDS) -> DataFrame:
    """sections(by, order, label, content) -> by, section_no, label, title, content, word_count. A section of fewer than `least` words joins the one before it, or goes if there is
    none; a label's later sections are titled as continued."""
    w = Window.partitionBy(by).orderBy(order)
    long_ = T.word_count(F.col("content")) >= least
    s = sections.withColumn("section_no", F.sum(long_.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("section_no > 0")
    g = s.groupBy(by, "section_no").agg(F.min_by("label", order).alias("label"), F.array_sort(F.collect_list(F.struct(order, "content"))).alias("parts"))
    content = F.trim(F.array_join(F.transform("parts", lambda p: p["content"]), " "))
    g = g.withColumn("content", content).withColumn("_n", F.row_number().over(Window.partitionBy(by, "label").orderBy("section_no")))
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    base = F.coalesce(F.try_element_at(titles, F.col("label")), F.initcap("label"))
    return g.select(by, "section_no", "label", F.when(F.col("_n") == 1, base).otherwise(F.concat(base, F.lit(" (cont.)"))).alias("title"), "content", T.word_count(F.col("content")).alias("word_count"))


def with_abstract(sections: DataFrame, described: DataFrame, by: str, least: int = ABSTRACT_WORDS) -> DataFrame:
    """merge_short's sections with a description (by, description) of at least `least` words as their first, the others numbered on. Only videos that have sections get one."""
    d = described.where(T.word_count(F.col("description")) >= least).select(by, F.trim("description").alias("content"))
    has = d.select(by, F.lit(1).alias("_more"))
    rest = sections.join(has, by, "left").withColumn("section_no", F.col("section_no") + F.coalesce("_more", F.lit(0))).drop("_more")
    first = d.join(sections.select(by).distinct(), by, "left_semi").select(by, F.lit(1).cast("long").alias("section_no"), F.lit("abstract").alias("label"), F.lit("Abstract").alias("title"), "content",
                                                                      T.word_count(F.col("content")).alias("word_count"))
    return rest.unionByName(first)


def monotone(df: DataFrame, by: str, order: list, idx: str = "idx") -> DataFrame:
    """Labels never go back: the running maximum."""
    return df.withColumn(idx, F.max(idx).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(df: DataFrame, by: str, order: list, label: str) -> DataFrame:
    """With run: consecutive rows of one label share a number."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def parse_vtt(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """WebVTT -> doc_id, seg_no, start, duration, text: blocks between blank lines that have a time line; of equal texts the first stays."""
    block = F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n", "\n"), r"\n\s*\n")).alias("i", "b")
    times = r"((?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d+:)?\d{2}:\d{2}[.,]\d{3})[^\n]*\n?"
    d = docs.select("doc_id", block).where(F.rlike("b", F.lit(times)))
    d = d.select("doc_id", "i", T.vtt_seconds(F.regexp_extract("b", times, 1)).alias("start"), T.vtt_seconds(F.regexp_extract("b", times, 2)).alias("end"), T.clean_caption(F.regexp_extract("b", "(?s)" + times + "(.*)", 3)).alias("text"))
    first = Window.partitionBy("doc_id", "text").orderBy("i")
    d = d.where("text <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return d.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).alias("seg_no"), "start", (F.col("end") - F.col("start")).alias("duration"), "text")
