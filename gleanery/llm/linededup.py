"""Dropping lines that several documents share, in DataFrame operations only.

Lines are exploded once into narrow rows (document, position, two 64-bit hashes of the key); the documents of a hash are counted from its distinct (hash, id) pairs; lines
of hashes that reach the threshold are dropped outside the smallest id that holds them; the positions dropped come back to the document's row, which is cut to the lines that
stay. So the texts move once, to meet their positions. A hash with more than 1/1024 of all lines is joined by broadcast (at most 1024 rows), all others by shuffle, so a line
that every document has is no single task.

Defined cases: null and empty texts are one empty line; rows of one id count as one document, and lose or keep a line together; rows without an id count as one document that
comes after all others; repeated rows get equal results; an empty table gives no rows; columns of any name are kept (`names` are moved out of their way).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, Scratch, free_name, read_table

SPACE = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (other letters as they are)."""
    b = bare(line)
    return F.when(F.octet_length(b) == F.length(b), F.lower(b)).otherwise(F.translate(b, UPPER, LOWER))


def shared_lines(docs: DataFrame, least_docs: int, least_chars: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(_row, _id, _drop): for each row of docs that loses lines, its key, its id and the positions (from 1) of those lines."""
    d = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"))
    d = d.where(F.length(bare(F.col("_line"))) >= least_chars).withColumn("_key", key_of(F.col("_line")))
    lines = scratch.cut(d.select("_id", "_row", (F.col("_pos") + 1).alias("_pos"), F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(13), "_key").alias("_h2")), "lines")
    pairs = lines.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_n"))  # an id once a hash, before anything is counted
    keys = pairs.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first"), F.sum("_n").alias("_n")).where(F.col("_docs") >= least_docs)
    keys = scratch.cut(keys.select("_h1", "_h2", "_first", "_n"), "keys")
    hot = F.broadcast(keys.where(F.col("_n") > max(lines.count() * HOT, 16.0)).drop("_n"))
    on = ["_h1", "_h2"]
    cold = lines.join(hot.select(*on), on, "left_anti").join(keys.drop("_n"), on)
    drops = lines.join(hot, on).unionByName(cold).where(~F.col("_id").eqNullSafe(F.col("_first")))
    return drops.groupBy("_row", "_id").agg(F.collect_set("_pos").alias("_drop"))  # positions of one document


def dedup_lines(docs: DataFrame, least_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """docs with the text without shared lines, its number of lines before, and of those dropped. A key of at least `least_chars` code points that at least `least_docs`
    documents hold stays only in the one with the smallest id."""
    scratch = Scratch(docs.sparkSession, "linededup")
    kept, n_lines, n_dropped = (free_name(docs, n) for n in names)
    row, lost_row, lost_id, drop = (free_name(docs, n) for n in ("_row", "_lost_row", "_lost_id", "_drop"))
    drops = shared_lines(docs, least_docs, least_chars, id_col, text_col, scratch).withColumnsRenamed({"_row": lost_row, "_id": lost_id, "_drop": drop})
    d = docs.withColumn(row, F.xxhash64(id_col, text_col))
    j = d.join(drops.hint("shuffle_hash"), (d[row] == drops[lost_row]) & d[id_col].eqNullSafe(drops[lost_id]), "left")

    def left(ls: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(1), F.size(ls)), F.col(drop))  # hashed, so linear in the lines
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i - 1)), "\n")

    whole = F.coalesce(F.col(text_col), F.lit(""))
    rest = F.when(F.col(drop).isNull(), whole).otherwise(F.element_at(F.transform(F.array(lines_of(F.col(text_col))), left), 1))  # the lines are split once
    breaks = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
    return j.select(*docs.columns, rest.alias(kept), (breaks + 1).cast("long").alias(n_lines), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.first < l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE k.first IS NULL OR k.first = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key GROUP BY l.doc_id
"""


def op13_line_dedup(spark, sf_dir):
    d = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
