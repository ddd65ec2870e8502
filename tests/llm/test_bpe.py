"""Token ids against the tokenizers library; tree concatenation; files."""

import hashlib
import os
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pyarrow.parquet as pq
import pytest
from gleanery.llm import bpe, tokenfiles
from gleanery.llm.common import blocks
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.bpe(bpe.default_path())


def same(own, library, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello, World's 42nd  café!", "<|endoftext|>a<|startoftext|> b<|endoftext", "İstanbul Σας ǅ", "it's we'll'd ''s", "a\x00b\x1cc\x85d\xa0e", "日本語 и русский", "²³½ ªº", "é Å", "a" * 5000,
                                  "thequickbrownfox" * 700, "!?" * 3000, "é" * 1000, "’s …", "\xad soft\xadhyphen"])
def test_texts(own, library, text):
    same(own, library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    same(own, library, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "1", "é", "e\u0301", "日本", "!", "?.", "\x1c", "\x85", "😀", "İ", "<|endoftext|>", "don't", "²"]), max_size=60), st.integers(1, 12))
def test_tree(library, parts, leaf):
    """Cuts at any character: the joins give what the library gives for the whole."""
    text = "".join(parts)
    cut = bpe.Bpe.__new__(bpe.Bpe)
    cut.__dict__ = {**bpe.bpe(bpe.default_path()).__dict__, "leaf": leaf}
    assert np.frombuffer(cut.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_joins_run_on_the_table(own, sf_dir):
    """The method is at work on the query's own table, and windows agree after few words."""
    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    before = own.joins
    own.encode_texts(texts)
    assert own.joins - before >= sum(-(-len(own.normal(t)) // own.leaf) - 1 for t in texts if t and "<|" not in t) > 50


def test_bounded_memory(own):
    """2,000 long texts in one batch: slices of bounded size, so the worker holds the ids and little else."""
    text = "some words of a long text, again and again. " * 500
    batch = pa.RecordBatch.from_pydict({"text": [text] * 2000})
    tracemalloc.start()
    n = sum(len(ids) for _, texts in blocks([batch]) for ids in own.encode_texts(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * len(own.encode(text)) and peak < 32 << 20


def test_rows(spark, library):
    """Null, empty, repeated, very long; clashing names."""
    long_ = "one two three " * 100_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a b", "x"), (4, long_, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids"] == bpe.packed(library.encode(t or "", add_special_tokens=False).ids)) for r, t in ((r, {1: None, 2: "", 4: long_}.get(r["doc_id"], "a b")) for r in bpe.encode_decode(df).collect()))
    assert got == [("1", 0, True), ("2", 0, True), ("3", 2, True), ("3", 2, True), ("4", 300_000, True), ("None", 2, True)]


def test_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op2_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_files(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    at = 0
    for r in tokenfiles.op1_tokens(spark, sf_dir).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_file_edges(spark, tmp_path):
    rows = [(2, "b", 1), (2, "b", 1), (None, None, 1), (1, "", 1), (3, "word " * 20000, 1)]
    to = f"file://{tmp_path}/orc"
    tokenfiles.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string, ids int"), to)
    got = tokenfiles.read_tokens(spark, to).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3]
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert tokenfiles.with_crc(tokenfiles.read_tokens(spark, to)).where("doc_id = 3").count() == 1
    empty = f"file://{tmp_path}/empty"
    tokenfiles.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), empty)
    assert tokenfiles.with_crc(tokenfiles.read_tokens(spark, empty)).count() == 0
    assert bpe.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_rows_are_cut(spark, tmp_path):
    """A third of all rows equal in id and text: no part holds them all."""
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same text', concat('t ', id)) as text")
    to = f"file://{tmp_path}/equal"
    tokenfiles.write_tokens(rows, to, partitions=6)
    parts = [r["count"] for r in spark.read.orc(to).groupBy("part").count().collect()]
    assert sum(parts) == 6000 and max(parts) < 2000
    got = tokenfiles.read_tokens(spark, to).orderBy("start").collect()
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1]) and [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def test_stripes(spark, tmp_path):
    """Small stripes: a file has several, with row indexes and Bloom filters, and ids outside all of them cost no stripe."""
    rows = spark.range(0, 60_000, 2).selectExpr("id + 1099511627776 as doc_id", "concat('words of ', id, repeat(' and more', 20)) as text")
    to = f"{tmp_path}/stripes"
    tokenfiles.write_tokens(rows, f"file://{to}", partitions=2, stride=1000, stripe=64 << 10)
    files = [os.path.join(to, f) for f in os.listdir(to) if f.endswith(".orc")]
    read = [orc.ORCFile(f) for f in files]
    assert min(f.nstripes for f in read) > 1 and sum(f.nrows for f in read) == 30_000
    jvm = spark._jvm
    for f in files:
        r = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
        assert r.getRowIndexStride() == 1000
        kinds = {str(s.getKind()) for s in r.rows().readStripeFooter(r.getStripes().get(0)).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
        want = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", sarg.PredicateLeaf.Type.valueOf("LONG"), 2**40 + 31).end().build()
        rows_of = r.rows(r.options().searchArgument(want, spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)))
        assert not rows_of.nextBatch(r.getSchema().createRowBatch())  # an odd id within the stripes' bounds: the Bloom filters rule every row group out
    plan = tokenfiles.read_tokens(spark, f"file://{to}").where("doc_id = 1099511627807")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,1099511627807)" in plan
    assert tokenfiles.read_tokens(spark, f"file://{to}").where("doc_id = 1099511627806").count() == 1
