"""Stage tables: each stage's result as Parquet under a folder keyed by the input, so a run on other input never reads this one's."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir); where that is unset, a temporary one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gleanery-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Stages:
    def __init__(self, spark: SparkSession, root: str, source: str, names: list[str]):
        self.spark, self.names = spark, names
        self.base = f"{root.rstrip('/')}/{hashlib.sha256(source.encode()).hexdigest()[:16]}"

    def path(self, name: str) -> str:
        if name not in self.names:
            raise ValueError(f"unknown stage {name}")
        return f"{self.base}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        """A stage is done when its writer has left the success mark."""
        p, fs = self._fs(self.path(name) + "/_SUCCESS")
        return fs.exists(p)

    def run(self, name: str, make, resume: bool = True, schema: str | None = None) -> DataFrame:
        """make() unless resuming and done; always the table as written. With `schema` a table of other columns or types, or one that cannot be read, is made anew."""
        if not (resume and self.done(name) and self.sound(name, schema)):
            make().write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def sound(self, name: str, schema: str | None) -> bool:
        if schema is None:
            return True
        try:
            have = self.spark.read.parquet(self.path(name)).schema
        except Exception:  # noqa: BLE001  whatever is wrong with the files, the stage runs again
            return False
        want = self.spark.createDataFrame([], schema).schema
        kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s]
        return kinds(have) == kinds(want)

    def clear(self, name: str) -> None:
        """This stage and all after it."""
        for n in self.names[self.names.index(name):]:
            p, fs = self._fs(self.path(n))
            fs.delete(p, True)


def free_name(name: str, taken: set[str]) -> str:
    """`name` where it is free; else, for names on "poster", with the next number behind that word, and for others with _1, _2, ... before the extension."""
    if name not in taken:
        return name
    stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
    numbered = re.fullmatch(r"(.*?poster)(\d*)", stem, re.IGNORECASE)
    head, n = (numbered[1], int(numbered[2] or 0) + 1) if numbered else (stem + "_", 1)
    while f"{head}{n}{dot}{ext}" in taken:
        n += 1
    return f"{head}{n}{dot}{ext}"
