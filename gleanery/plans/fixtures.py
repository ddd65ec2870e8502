"""Views over the test tables that exercise the operators: the same definition in Spark and in SQL (VIEWS)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Titles that the Markdown view inserts, in order.
TITLES = ["Introduction", "2. Related Work", "Method", "3.1 Experimental Setup", "Main Results", "Results and Findings", "Copyright Notice", "Discussion", "Conclusion", "References"]
CATEGORY = {"introduction": "motivation", "methods": "methodology", "experiments": "dataset", "results": "results", "discussion": "analysis", "conclusion": "conclusion"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def whole_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each document as one section of type other."""
    return docs.select("doc_id", F.lit(1).alias("ord"), F.lit("section_1").alias("section_id"), F.lit("other").alias("section_type"), F.col(text_col).alias("content"))


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def markdown(docs: DataFrame) -> DataFrame:
    """A header line before every second line, its title by the line's number and the document's id."""
    titles = F.array(*map(F.lit, TITLES))
    title = lambda i: F.element_at(titles, ((i / 2 + F.col("doc_id")) % len(TITLES) + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 2 == 0, F.concat(F.lit("## "), title(i), F.lit("\n"), line)).otherwise(line))
    return docs.withColumn("text", F.array_join(lines, "\n"))


def segments(events: DataFrame) -> DataFrame:
    """events as transcript segments of a user: seconds from the first event, the value as duration, the type as text."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select("user_id", F.col("event_id").alias("ord"), (secs - F.min(secs).over(w)).cast("double").alias("start"), F.col("value").alias("duration"), F.col("event_type").alias("text"))


def quiz(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and answers of two readers by arithmetic on item ids; synthetic, no model's results. Some golds and answers carry words behind the letter, some answers are named by
    the question's number only."""
    from pyspark.sql import Window

    letter = lambda n: F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), 1)
    i = F.col("item_id")
    items = benchmark.select((i % 5).alias("doc_id"), F.when(i % 2 == 0, "verbatim").otherwise("interpretive").alias("qtype"), i.cast("string").alias("qid"), F.concat(letter(i), F.when(i % 4 == 1, ". the text").otherwise("")).alias("gold"),
                             F.row_number().over(Window.partitionBy(i % 5).orderBy(i)).alias("idx"))
    said = lambda n: F.concat(F.when(i % 5 == 2, " ").otherwise(""), letter(n), F.when(i % 3 == 1, ". some words").otherwise(""))
    answer = lambda shift: F.when((i + shift) % 7 == 0, "NA").when((i + shift) % 3 == 0, said(i + 1)).otherwise(said(i))
    reference = F.when(i % 11 == 0, "NA").otherwise("text")
    qid = F.when(i % 6 == 0, F.concat(F.lit("Question "), F.row_number().over(Window.partitionBy(i % 5).orderBy(i)).cast("string"))).otherwise(i.cast("string"))
    one = lambda name, shift: benchmark.select((i % 5).alias("doc_id"), F.lit(name).alias("model"), qid.alias("qid"), answer(shift).alias("answer"), reference.alias("reference"))
    return items, one("reader_a", 0).unionByName(one("reader_b", 2))


def judge(labels: DataFrame) -> DataFrame:
    """Six criteria from labels, some null."""
    names = ["element", "layout", "engagement", "clarity", "content", "logic"]
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.when((F.col("doc_id") + k) % 6 == 0, F.lit(None)).otherwise(F.least(1 + F.col("quality") * 3 + F.col("toxic") + (F.col("doc_id") + k) % 3, F.lit(5))).cast("int").alias("score")) for k, n in enumerate(names)])
    return labels.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_TITLES_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"
#: SQL of the views, as common table expressions.
VIEWS = {
    "md": f"""md AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: CASE WHEN (i - 1) % 2 = 0
      THEN '## ' || ({_TITLES_SQL})[CAST(((i - 1) // 2 + doc_id) % {len(TITLES)} + 1 AS BIGINT)] || chr(10) || line ELSE line END), chr(10)) AS text FROM documents)""",
    "segments": """segments AS (SELECT user_id, event_id AS ord, CAST(floor(epoch(ts)) - min(floor(epoch(ts))) OVER (PARTITION BY user_id) AS DOUBLE) AS start, value AS duration FROM events)""",
}
