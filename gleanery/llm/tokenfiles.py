"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids, global order by document id.

Texts are range-partitioned and sorted by doc_id, encoded with the tokenizers library on the way to the writer, and written with each row's place within its
partition. ORC keeps ids as run-length-encoded integers in stripes, with a row index of every `stride` rows and Bloom filters on doc_id, so a reader takes
whole stripes in parallel and skips those that can't hold a wanted document. A document's start in the whole sequence is its place within the partition plus
the ids of earlier partitions: one count a partition, summed over at most `partitions` rows.

Defined cases: null and empty text hold the end id alone; null ids come first; rows with equal ids are ordered by a digest of their text and keep a row each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe, default_path, lists
from .common import Scratch, blocks, read_table

END_ID = 2


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, partitions: int | None = None, stride: int = 10_000, stripe: int = 64 << 20,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write ids as ORC in ascending order of doc_id: doc_id, ids, n_tokens, part, place (ids before it within the part)."""
    path = path or default_path()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that are equal in both are told apart by their place in the input, so that any number of them can be cut into several ranges.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    d = d.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order)
    d = d.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")

    def run(batches):
        b, before, end = bpe(path), 0, np.array([end_id], "<u4").tobytes()
        for batch, texts in blocks(batches):
            ids = [np.frombuffer(x + end, "<i4") for x in b.encode_texts(texts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            place = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids), pa.array(sizes), batch.column("part"), pa.array(place)], names=["doc_id", "ids", "n_tokens", "part", "place"])

    out = d.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, part int, place bigint")
    (out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", stride).option("orc.stripe.size", stripe)
     .option("orc.compress", "ZSTD").option("orc.encoding.strategy", "SPEED").orc(to))


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; ids are read only if asked for, and a filter on doc_id reaches the stripes' indexes and Bloom filters."""
    t = spark.read.orc(at)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each of the writer's partitions, which bounds the broadcast too
    parts = t.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    return t.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """tokens(doc_id, start, n_tokens, ids) -> doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit integers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op1_tokens(spark, sf_dir):
    to = Scratch(spark, "tokens").path("orc")
    write_tokens(read_table(spark, sf_dir, "documents"), to)
    return with_crc(read_tokens(spark, to))
