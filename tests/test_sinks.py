"""Metric tables that fill gaps, whole files as a data source, means of readers."""

import json

import pytest
from gleanery.functions import scores
from gleanery.sources.files import NamedFiles
from gleanery.sources.metrics import Metrics, summary
from pyspark.sql import functions as F


def test_metrics_fill_gaps(spark, tmp_path):
    asked = []

    def of(name, factor):
        def compute(keys):
            asked.append((name, sorted(r["doc_id"] for r in keys.collect())))
            return keys.where("doc_id <> 3").select("doc_id", (F.col("doc_id") * factor).alias("value"))

        return compute

    compute = {"a": of("a", 0.5), "b": of("b", 2)}
    wanted = lambda *ids: spark.createDataFrame([(i, m) for i in ids for m in "ab"], "doc_id bigint, metric string")
    m = Metrics(spark, f"file://{tmp_path}/m")
    assert m.read() is None
    got = {(r["doc_id"], r["metric"]): r["value"] for r in m.fill(wanted(1, 2, 3), compute, "first").collect()}
    assert got == {(1, "a"): 0.5, (2, "a"): 1.0, (3, "a"): None, (1, "b"): 2.0, (2, "b"): 4.0, (3, "b"): None}
    assert asked == [("a", [1, 2, 3]), ("b", [1, 2, 3])]
    asked.clear()
    m.fill(wanted(1, 2, 3), compute, "second")
    assert asked == [("a", []), ("b", [])] and m.read().select("batch").distinct().count() == 1  # nothing is computed or written again
    asked.clear()
    got = {(r["doc_id"], r["metric"]): r["value"] for r in m.fill(wanted(3, 4), compute, "third").collect()}
    assert asked == [("a", [4]), ("b", [4])] and got[4, "a"] == 2.0 and got[3, "b"] is None and m.read().count() == 8
    other = Metrics(spark, f"file://{tmp_path}/m", kind="string")  # another form of key: computed anew
    assert other.read() is None
    out = other.fill(spark.createDataFrame([("x", "a")], "doc_id string, metric string"), {"a": lambda k: k.select("doc_id", F.lit(1.00005).alias("value"))}).collect()
    assert [tuple(r) for r in out] == [("x", "a", 1.00005)] and other.read().count() == 1


def test_summary(spark):
    d = spark.createDataFrame([(1, "b", 0.12345), (1, "a", None), (1, "c", 2.00015), (2, "a", 1.0)], "doc_id int, metric string, value double")
    got = {r["doc_id"]: json.loads(r["summary"]) for r in summary(d).collect()}
    assert got == {1: {"a": None, "b": 0.1234, "c": 2.0002}, 2: {"a": 1.0}}


def test_named_files(spark, tmp_path):
    spark.dataSource.register(NamedFiles)
    folder = f"{tmp_path}/out"
    rows = [(f"doc{i}/quiz.json", json.dumps({"n": i})) for i in range(20)] + [("a.md", "é"), ("empty", None)]
    spark.createDataFrame(rows, "name string, content string").repartition(4).write.format("gleanery").mode("append").save(folder)
    back = spark.read.format("gleanery").option("maxPartitionBytes", 30).load(folder)
    got = {r["name"]: (r["kind"], r["size"], bytes(r["content"]).decode()) for r in back.collect()}
    assert got == {n: (n.rpartition(".")[2] if "." in n else "", len((c or "").encode()), c or "") for n, c in rows}
    assert back.rdd.getNumPartitions() > 3 and spark.read.format("gleanery").option("kinds", "MD, txt").load(folder).count() == 1 and back.where("name in ('a.md', 'empty') and size > 0").count() == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("doc")) == ["a.md", "empty"]

    def breaks(x):
        if x == 5:
            raise ValueError("no")
        return "t"

    bad = spark.range(8).repartition(4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.udf(breaks)("id").alias("content"))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("gleanery").mode("append").save(folder)
    with pytest.raises(Exception, match="two rows"):
        spark.createDataFrame([("same", "1"), ("same", "2")], "name string, content string").write.format("gleanery").mode("append").save(folder)
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("../x", "1")], "name string, content string").write.format("gleanery").mode("append").save(folder)
    assert {r["name"] for r in back.collect()} == set(got) and not (tmp_path / "out" / "_gleanery").exists() and not (tmp_path / "x").exists()
    spark.createDataFrame([("only.txt", bytearray(b"\x00\x01"))], "name string, content binary").write.format("gleanery").mode("overwrite").save(folder)
    assert [(r["name"], bytes(r["content"])) for r in spark.read.format("gleanery").load(folder).collect()] == [("only.txt", b"\x00\x01")]


def test_visual_perplexity(spark):
    p = spark.createDataFrame([(1, 11, "t"), (1, 12, ""), (2, 21, "t"), (3, 31, "t")], "doc_id int, panel int, text string")
    i = spark.createDataFrame([(11, 2.0), (11, 4.0), (12, 99.0), (31, None)], "panel int, ppl double")
    assert {r["doc_id"]: r["visual_ppl"] for r in scores.visual_perplexity(p, i).collect()} == {1: 3.0, 2: 0.0, 3: None}
