"""Each stage of the pipeline works on all that the stage before kept, against brute force, with clashing and further columns."""

import os

import corpus_pipeline as cp
from gleanery.llm import pii
from test_native import brute as brute_pii
from test_neardup import brute as brute_dups
from tokenizers import Tokenizer

from gleanery.llm.bpe import default_path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", cp.F.lit(7)).withColumn("_copy", cp.F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id = 0")).cache()
    kept = cp.toxicity(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    model = cp.tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.count() == cp.tox.score(docs, model).where("predicted = 0").count()
    kept = kept.cache()

    single = cp.near_duplicates(spark, kept, sf_dir).cache()
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {i for i, (_, _, keep) in brute_dups(list(rows.items()), 5).items() if keep}
    got = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns and len(got) == len(set(got)) and set(got) == want

    clean = cp.personal_data(spark, single, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not [s for s in brute_pii(r["text"]) if s.startswith(("email", "phone"))]
    spans = pii.find(single).where("size(pii.spans) = 0").select("doc_id").collect()
    texts, before = {r["doc_id"]: r["text"] for r in clean.collect()}, {r["doc_id"]: r["text"] for r in single.collect()}
    assert all(texts[r["doc_id"]] == before[r["doc_id"]] for r in spans)

    mixed = cp.source_mix(spark, clean, sf_dir).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    copies = {r["doc_id"]: r["copies"] for r in cp.mixing.mix(clean).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}

    library = Tokenizer.from_file(default_path())
    out = cp.token_ids(spark, mixed, sf_dir)
    assert out.count() == mixed.count()
    for r in out.limit(40).collect():
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run(spark, sf_dir):
    """run() is its stages one after another, and leaves its own last table only."""
    base = cp.Scratch(spark, "probe").base.removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = cp.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    left = [d for d in set(os.listdir(base)) - before if d.startswith("pipeline")]
    assert len(left) == 1 and len(os.listdir(f"{base}/{left[0]}")) == 1
    assert key(got) == key(docs) and 4 <= len(cp.STAGES) <= 5


def test_rows(spark, sf_dir):
    """Null, empty and repeated rows, rows without an id, one id with two texts, ties, clashing names, one very long text."""
    long_ = "several words of a long text " * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (None, "some words here", None), (None, "some words here", None), (3, "one two three four five six", "b"), (3, "one two three four five six", "b"),
            (3, "other words than those before them", "b"), (4, long_, "b"), (5, "write to a@b.co now", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, size string, n_chars int")
    assert cp.toxicity(spark, docs, sf_dir).columns == docs.columns
    single = cp.near_duplicates(spark, docs, sf_dir)
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in single.collect()) == sorted([("1", ""), ("2", ""), ("None", "some "), ("None", "some "), ("3", "one t"), ("3", "other"), ("4", "sever"), ("5", "write")])
    clean = cp.personal_data(spark, docs, sf_dir)
    assert clean.count() == len(rows) and [(r["text"], r["n_chars"]) for r in clean.where("doc_id = 5").collect()] == [("write to <EMAIL> now", 20)]
    mixed = cp.source_mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in cp.token_ids(spark, docs, sf_dir).collect())[:2] == [("1", 0), ("2", 0)] and cp.token_ids(spark, docs, sf_dir).count() == len(rows)


def test_empty_documents(spark, sf_dir):
    empty = spark.createDataFrame([], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
