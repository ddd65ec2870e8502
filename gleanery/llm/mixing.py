"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source s has a size S (sum of its documents' word counts) and a target that is at most `max_repeats` times S. A document's expected copies are
r = target / S. Within a source the documents stand in one fixed order (size class, salt, size, hash, id), the expected copies are prefix-summed, one
offset in [0, 1) is added, and a document is emitted once for each integer boundary that its stretch crosses. As every document of a source has the same
r, the prefix sum at rank i is i * r; the whole part of r is given to every document and only the fraction is sampled, so no document exceeds
`max_repeats` copies.

The order puts documents of like size together, so the words taken stay close to the target. Ranks are counted in three levels so that a source with a
third of all rows is no single task: row numbers within (source, size class, salt), sums over the salts of a size class, sums over the size classes of a
source. The last two run over counts only (at most SALTS rows a size class, and 16 size classes for each doubling of the size).

Defined cases: null text has size 0; null source is a source of its own, last in order; sources of size 0 get target 0; an empty table gives no rows;
repeated rows are separate documents (which of two equal rows is emitted does not show); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

SALTS = 4096  # a source and size class with 10^10 documents is dealt over so many windows of a few million narrow rows
SPACE = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Exact below 32; above, 16 classes for each doubling (integers only, so that any engine agrees)."""
    bits = F.length(F.bin(size)).cast("long")
    top = F.floor(size / F.pow(F.lit(2.0), (bits - 5).cast("double"))).cast("long")
    return F.when(size < 32, size).otherwise(32 + (bits - 6) * 16 + top - 16)


def unit(hex_text: Column) -> Column:
    """The first 13 hex digits as a number in [0, 1)."""
    return F.conv(F.substring(hex_text, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """sizes(source, source_size) -> with target: the total is shared by weight, each share stopping at max_repeats times its size, the excess reshared
    by weight until none is above. With sources by ascending size per weight, those that stop are a prefix, so one pass over the sources settles it.
    One row a source: this table is small whatever the corpus (the single partition holds sources, not documents)."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("w").over(onwards))
         .withColumn("open", F.col("level") * F.col("w") <= F.col("most"))
         .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(everything)["level"]))
    t = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.col("final") * F.col("w"), F.col("most").cast("double")), F.col("most").cast("double")))
    return s.select("source", "source_size", t.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies; `carry` names columns to keep beside them (read in the same pass)."""
    plain = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    narrow = Scratch(docs.sparkSession, "mixing").cut(docs.select(*plain), "sizes")  # texts are read once for their sizes; counts and ranks use this table
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a key that joins null sources too
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def celled(t: DataFrame) -> DataFrame:
        t = t.withColumn("_k", key).withColumn("_h", h).withColumn("_b", size_class(F.col("size")))
        return t.withColumn("_s", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % SALTS)

    d = celled(docs.select(*plain, F.struct(*[F.col(c) for c in carry]).alias("_carried")) if carry else narrow)
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_b", "_s").orderBy("size", "_h", F.col("doc_id").asc_nulls_last())))

    cells = celled(narrow).groupBy("_k", "_b", "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.max("source").alias("source"))
    classes = cells.groupBy("_k", "_b").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"), F.max("source").alias("source"))
    sizes = classes.groupBy("_k").agg(F.sum("_words").alias("source_size"), F.max("source").alias("source"))
    goal = targets(sizes.select("source", "source_size"), weights, max_repeats).withColumn("_k", key).drop("source")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    low = classes.select("_k", "_b", F.coalesce(F.sum("_n").over(upto("_k", "_b")), F.lit(0)).alias("_low"))
    inner = cells.select("_k", "_b", "_s", F.coalesce(F.sum("_n").over(upto("_k", "_b", "_s")), F.lit(0)).alias("_in"))
    starts = (inner.join(low, ["_k", "_b"]).join(goal, "_k")
              .select("_k", "_b", "_s", (F.col("_low") + F.col("_in")).alias("_start"), "source_size", "target"))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit(F.md5(F.concat_ws(":", F.lit(seed), F.col("_k"))))
    rank = F.col("_start") + F.col("_i")
    whole, part = F.floor(F.col("_r")), F.col("_r") - F.floor(F.col("_r"))
    crossed = F.floor(F.col("_u") + F.col("_rank") * part) - F.floor(F.col("_u") + (F.col("_rank") - 1) * part)
    out = (d.join(starts, ["_k", "_b", "_s"])
           .withColumn("_r", rate).withColumn("_u", offset).withColumn("_rank", rank.cast("double"))
           .withColumn("copies", F.when(F.col("source_size") > 0, whole + crossed).otherwise(F.lit(0)).cast("long")))
    cols = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return out.select(*cols, *(["_carried"] if carry else []))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE 32 + (length(bin(size)) - 6) * 16 + (size >> CAST(length(bin(size)) - 5 AS INTEGER)) - 16 END AS b,
    CAST('0x' || substr(h, 1, 4) AS BIGINT) % 4096 AS salt
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT level AS final FROM l WHERE level * w <= 3 * source_size ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0
      ELSE least(coalesce((SELECT final FROM f) * w, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) END AS target
  FROM l),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce('s' || k.source, 'n')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u,
    CAST(row_number() OVER (PARTITION BY k.source ORDER BY b, salt, k.size, h, k.doc_id) AS DOUBLE) AS i
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN source_size > 0 THEN size * (floor(r) + floor(u + i * (r - floor(r))) - floor(u + (i - 1) * (r - floor(r)))) ELSE 0 END AS BIGINT) AS taken
FROM r
"""


def op6_mixing(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
