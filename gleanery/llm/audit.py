"""How filters interact: what each of them removes, in every order, from a corpus and its labelled parts.

A document's failures are a mask of five bits. Masks are counted once a part (language) into histograms of 32 places for all documents, those of good quality and toxic
ones; the histograms are stacked as rows, and one integer product a part with matrices of 32 by 600 (120 orders of 5 steps) gives the kept, removed, redundant and unique
documents of every order and step. So the corpus is read once, whatever the number of orders.

"Identical to a document of smaller id" needs no join of texts: of the rows of a text (two 64-bit hashes) those of its smallest id pass, all others fail, so only counts of
(text, id, part, mask, labels) meet, by text and id together. Copies are counted before they are shuffled, so a text that a third of all documents have is no single task.

Defined cases: null texts are empty; null parts are the empty string; several labels of one id count as good (toxic) if one of them says so; rows of one id and text pass
or fail together; rows without an id have no labels and come after all ids; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, bounded, read_table

FILTERS = "ABCDE"
UPPER, MARKS, GAP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]"), re.compile(rb"[\x20\x09-\x0d]")
PIECE = 1 << 20  # bytes of a text that are split into words at a time
OUT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def words(data: bytes) -> tuple[int, int]:
    """Words and distinct words; the text is split in pieces, so only the distinct words of a long text are held."""
    n, seen, at = 0, set(), 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = gap.start() if gap else len(data)
        found = data[at:end].split()  # of bytes: splits at the six white-space characters and no others
        n, at = n + len(found), end
        seen.update(found)
    return n, len(seen)


def own_mask(text: str) -> int:
    """Failures that the text alone shows: A (bit 0) under 200 words, B half of the words repeat, C capitals over 3%, D holds marks."""
    data = text.encode()
    n, distinct = words(data)
    capitals = len(data) - len(data.translate(None, UPPER))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * len(text)) << 2 | (MARKS.search(data) is not None) << 3


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """_id, _part, _h1, _h2 (the text), _mask of its own failures."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col), F.lit("")).alias("_part"), F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(11), text).alias("_h2"), text.alias("_text"))

    def run(batches):
        for batch, texts in blocks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_part", "_h1", "_h2")), pa.array([int(own_mask(t)) for t in texts], pa.int32())], names=["_id", "_part", "_h1", "_h2", "_mask"])

    return d.mapInArrow(run, f"_id {d.schema['_id'].dataType.simpleString()}, _part string, _h1 bigint, _h2 bigint, _mask int")


def histograms(rows: DataFrame, labels: DataFrame, scratch: Scratch, label_id: str = "doc_id") -> DataFrame:
    """_part, cells: arrays of at most 32 (mask, all, good, toxic)."""
    copy = 1 << (len(FILTERS) - 1)
    said = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    nameless = rows.where("_id is null").withColumn("_good", F.lit(None).cast("int")).withColumn("_toxic", F.lit(None).cast("int"))
    all_rows = rows.where("_id is not null").join(said, "_id", "left").unionByName(nameless)
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("_good", "_toxic")]
    cells = scratch.cut(all_rows.groupBy("_h1", "_h2", "_id", "_part", "_mask", *flags).agg(F.count(F.lit(1)).alias("_n")), "cells")
    first = cells.groupBy(F.col("_h1").alias("_f1"), F.col("_h2").alias("_f2")).agg(F.min("_id").alias("_first"))
    new = cells.join(first, (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi")

    def part(df: DataFrame, mask, sign: int) -> DataFrame:
        n = F.col("_n") * sign
        return df.groupBy("_part", mask.alias("_mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("_good")).alias("good"), F.sum(n * F.col("_toxic")).alias("toxic"))

    # All rows as if they were copies; then the first of each text move over.
    copied = F.col("_mask").bitwiseOR(F.lit(copy))
    moved = scratch.cut(part(new, F.col("_mask"), 1), "first")
    back = moved.select("_part", copied.alias("_mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    counts = part(cells, copied, 1).unionByName(moved).unionByName(back).groupBy("_part", "_mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return counts.groupBy("_part").agg(F.collect_list(F.struct("_mask", "n", "good", "toxic")).alias("cells"))


@lru_cache(maxsize=4)
def matrices(filters: str = FILTERS) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """The orders, the filter of every (order, step), and for each outcome the matrix of masks by (order, step)."""
    k, masks = len(filters), np.arange(1 << len(filters))[:, None]
    orders = list(permutations(range(k)))
    bit = np.array([1 << i for o in orders for i in o])[None, :]
    before = np.array([sum(1 << i for i in o[:s]) for o in orders for s in range(k)])[None, :]
    fails, reached = (masks & bit) > 0, (masks & before) == 0
    out = {"kept": reached & ~fails, "removed": reached & fails, "redundant": fails & ~reached, "unique_fails": np.broadcast_to(masks == bit, fails.shape)}
    return ["".join(filters[i] for i in o) for o in orders], np.array([i for o in orders for i in o]), {name: m.astype(np.int64) for name, m in out.items()}


def products(hist: DataFrame) -> DataFrame:
    """600 rows a part from its histograms."""
    def run(batches):
        orders, which, m = matrices()
        k = len(FILTERS)
        names, steps = pa.array(np.repeat(orders, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
        for batch in batches:
            for part, cells in zip(batch.column("_part"), batch.column("cells"), strict=True):
                stack = np.zeros((3, 1 << k), np.int64)
                for c in cells.as_py():
                    stack[:, c["_mask"]] = c["n"], c["good"], c["toxic"]
                got = {name: stack[0] @ x for name, x in m.items()}
                lost = stack[1:] @ m["removed"]
                total = np.array([got["removed"][which == i].sum() for i in range(k)])[which]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(which), pa.string()), names, steps, *map(pa.array, (*got.values(), *lost, total))],
                                                 names=["part", "filter_order", "step", *got, "good_lost", "toxic_lost", "shapley"])

    return hist.mapInArrow(run, OUT)


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step: documents kept after it, removed by it, failing it but gone before, failing nothing else, good and toxic ones lost
    by it, and the sum of what its filter removes over all orders."""
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.cut(masked(docs, id_col, text_col, part_col), "masks")
    return products(histograms(rows, labels, scratch))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT doc_id, part, CAST(len(ws) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(doc_id > min(doc_id) OVER (PARTITION BY t) AS INTEGER) AS mask
  FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, b)),
o AS (
  SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31),
e AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS past FROM o, unnest(range(1, 6)) AS u(i)),
g AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (past | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & past > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & past = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, e GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM g
"""


def op11_filter_audit(spark, sf_dir):
    return interactions(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
