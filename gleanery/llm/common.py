"""Shared plumbing of the training-data operators: shared folder, lineage cuts, table reading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that Python workers are sent, and characters of the texts that they work on together.
BATCH_BYTES, BLOCK = 8 << 20, 1 << 20


def bounded(spark: SparkSession) -> None:
    """Arrow batches are bounded by rows only unless this setting is there: a batch of long texts would be held whole. A setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batches in slices whose texts have `most` bytes at most (one longer text makes a slice of its own), with those texts."""
    for batch in batches:
        texts = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        at, size = 0, 0
        for i, n in enumerate([*sizes, None]):
            if i > at and (n is None or size + n > most):
                yield batch.slice(at, i - at), texts.slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n or 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); a temporary one only where the setting is absent and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: The folders of this process, for a caller that has written an operator's result and wants its tables gone.
MADE: list[Scratch] = []


class Scratch:
    """Tables written under the shared folder to cut lineage; `drop` removes those no longer read, `drop_all` the folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        MADE.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and read it back: a lost executor costs no recomputation beyond this table."""
        df.write.option("compression", "zstd").parquet(p := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(p)
        out._gleanery_path = p
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._gleanery_path)

    def drop_all(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Keys that hold more than this share of all rows each are joined by broadcast: there can be no more of them than its inverse.
HOT = 1 / 1024


def met(rows: DataFrame, table: DataFrame, key: str, total: int, share: float = HOT) -> DataFrame:
    """rows joined with table(key, n, ...) on key, where the table has one row a key and n is how many of the `total` rows (an upper bound will do) have it. Keys with more
    than `share` of them number 1 / share at most, which bounds what is broadcast; all others are too small to load one task."""
    hot = table.where(F.col("n") > max(total * share, 16.0))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def dealt(pairs: DataFrame, key: str, total: int, share: float = HOT) -> tuple[DataFrame, DataFrame]:
    """pairs with a column `part`, by which the rows of a key with more than `share` of all are dealt over several, and (key, part) of every part that occurs."""
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    most = max(total * share, 16.0)
    hot = counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))  # 1 / share rows at most
    out = pairs.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.hash(*pairs.columns), F.coalesce("parts", F.lit(1)))).drop("parts")
    return out, out.select(key, "part").distinct()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it if the table has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n), F.lit(0))
