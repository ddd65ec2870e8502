"""Metric tables that fill their gaps: a metric of a document is computed once, and again only if the table's form has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Metrics:
    """A Parquet table (key, value) in partitions of metric and batch. `fill` computes the (key, metric) pairs that it lacks and writes them as one batch, by overwriting that batch's
    partitions only: a batch that is written again replaces itself, and other batches stay untouched."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{key} {kind}, value double, metric string, batch string"

    def read(self) -> DataFrame | None:
        """The table; null if it isn't there. One of other columns or types is refused, so that it isn't mixed with this one."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        # Each batch's own files show their columns; partitions are read as text, whatever their names look like.
        have = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(self.path).schema
        want = self.spark.createDataFrame([], self.schema).schema
        if {(f.name, f.dataType) for f in have} != {(f.name, f.dataType) for f in want if f.name not in ("metric", "batch")}:
            return None
        return self.spark.read.schema(self.schema).parquet(self.path)

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Of wanted(key, metric) the pairs without a row; a pair whose value is null has one."""
        have, need = self.read(), wanted.select(self.key, "metric").distinct()
        return need if have is None else need.join(have.select(self.key, "metric"), [self.key, "metric"], "left_anti")

    def fill(self, wanted: DataFrame, compute: dict[str, Callable[[DataFrame], DataFrame]], batch: str | None = None) -> DataFrame:
        """The rows of all `wanted` pairs, after computing those that miss: compute[metric] takes the keys and gives (key, value); a key that it leaves out gets null. A table of another
        form is written anew."""
        anew = self.read() is None
        batch = batch or uuid.uuid4().hex
        need = self.missing(wanted).persist()
        try:
            parts = []
            for metric, of in compute.items():
                keys = need.where(F.col("metric") == metric).select(self.key)
                made = of(keys).select(self.key, F.col("value").cast("double").alias("value"))
                parts.append(keys.join(made, self.key, "left").select(self.key, "value", F.lit(metric).alias("metric"), F.lit(batch).alias("batch")))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            if not need.isEmpty():
                mode = "static" if anew else "dynamic"
                out.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("metric", "batch").parquet(self.path)
        finally:
            need.unpersist()
        have = self.read()
        return wanted.select(self.key, "metric").distinct().join(have.drop("batch"), [self.key, "metric"], "left") if have is not None else wanted.select(self.key, "metric", F.lit(None).cast("double").alias("value"))


def summary(metrics: DataFrame, key: str = "doc_id", places: int = 4) -> DataFrame:
    """metrics(key, metric, value) -> key, summary: a JSON object of all metrics by name, rounded half to even by its shortest decimal form, nulls included."""
    g = metrics.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("metric", F.bround("value", places).alias("value")))).alias("m"))
    return g.select(key, F.to_json(F.map_from_entries("m"), {"ignoreNullFields": "false"}).alias("summary"))
