"""Matroska and WARC: round trips, damage, splits."""

import gzip
import hashlib
import random
import struct

import pytest
from compare import rows_of, sql_rows
from gleanery.llm import matroska as mk
from gleanery.llm import warc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.functions import spark_partition_id


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400))
def test_mux_round_trip(data, times):
    payload = (data or b"x") * max(1, times)
    payload += bytes(-len(payload) % 64)
    m = mk.parse(mk.mux(payload))
    assert not m.damaged and mk.payload_of(mk.mux(payload), m) == payload
    assert [c[2] for c in m.cues] == m.clusters and m.tracks[1]["codec"] == "A_PCM/INT/LIT"
    stamps = [p[1] for p in m.packets]
    assert stamps == sorted(stamps)


def test_foreign_forms():
    """Unknown sizes, block groups, Xiph lacing, a second track, void elements."""
    xiph = mk.size_bytes(2) + struct.pack(">h", 5) + bytes([0x02, 2]) + bytes([255, 10, 3]) + b"a" * 265 + b"b" * 3 + b"c" * 7
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, xiph) + mk.element(mk.REFERENCE, 1))
    cluster = mk.CLUSTER.to_bytes(4, "big") + b"\xff" + mk.element(mk.TIMESTAMP, 100) + mk.element(0xEC, b"void") + group
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK, mk.element(mk.NUMBER, 2) + mk.element(mk.CODEC, b"V_TEST")))
    data = mk.element(mk.EBML, mk.element(0x4282, b"matroska")) + mk.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + tracks + cluster + cluster
    m = mk.parse(data)
    assert not m.damaged and [p[3] for p in m.packets] == [265, 3, 7] * 2 and len(m.clusters) == 2
    assert {p[1] for p in m.packets} == {105_000_000} and not any(p[5] for p in m.packets)
    assert data[m.packets[1][2] : m.packets[1][2] + 3] == b"bbb"


def test_damage():
    data = mk.mux(bytes(range(256)) * 40)
    for cut in random.Random(0).sample(range(len(data)), 60):
        m = mk.parse(data[:cut])
        assert len(m.packets) <= 10
    flipped = bytearray(data)
    for i in random.Random(1).sample(range(len(data)), 200):
        flipped[i] ^= 0xFF
    mk.parse(bytes(flipped))


def test_media_columns(spark):
    rows = [(1, "é" * 100, "x"), (2, None, "x"), (3, "", "x"), (None, "z" * 200_000, "x"), (1, "é" * 100, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media string")
    media = mk.to_media(df)
    got = {(r["doc_id"], r["n_bytes"]): r for r in mk.read_back(media).collect()}
    assert got[(2, 0)]["payload_bytes"] == got[(3, 0)]["payload_bytes"] == 64
    assert got[(1, 200)]["payload_sha256"] == hashlib.sha256("é".encode() * 100 + bytes(56)).hexdigest()
    p = mk.packets(media).where("doc_id is null").agg({"n_bytes": "sum", "cluster": "max"}).first()
    assert p["sum(n_bytes)"] == 200_000 and p["max(cluster)"] == 1
    assert mk.read_back(mk.to_media(df.limit(0))).count() == 0 and mk.packets(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).count() == 0


PAGES = "page_id bigint, url string, html string, digest string"


def test_warc_matches_sql(spark, sf_dir):
    assert rows_of(warc.op7_warc(spark, sf_dir)) == sql_rows(warc.ORACLE, sf_dir)


@pytest.mark.parametrize("split", [97, 1000, 64 << 20])
def test_warc_splits_and_edges(spark, tmp_path, split):
    r = random.Random(2)
    big = "".join(r.choice("abcé<>") for _ in range(30_000))
    rows = [(1, "u", "x" * 1000), (9, "u\r\nWARC/1.1", "x" * 1000), (5, None, "x" * 1000), (2, "u", "x" * 999), (3, "u", "x" * 999), (4, "u", None), (6, "u", ""), (7, "u", big), (None, "u", big), (8, "u", "WARC/1.1\r\n\r\n" * 200), (9, "u", "x" * 1000)]
    df = spark.createDataFrame([(*x, "d") for x in rows], PAGES)
    archives = spark.createDataFrame([tuple(a) for a in warc.write(df, f"file://{tmp_path}/w").collect()], "path string, bytes bigint, records bigint")
    got = warc.read(spark, archives, split).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(g["page_id"]), g["record_type"], g["refers_to"]) for g in got)
    assert kinds == sorted([("1", "revisit", 9), ("9", "response", None), ("9", "response", None), ("5", "revisit", 9), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("6", "response", None),
                            ("7", "response", None), ("None", "revisit", 7), ("8", "response", None)])
    for g in got:
        if g["record_type"] == "response":
            assert g["declared_digest"] == hashlib.sha1(g["payload"]).hexdigest() and g["payload_bytes"] == len(g["payload"])
    for a in archives.collect():  # plain gzip reads the whole archive
        gzip.open(a["path"].removeprefix("file://")).read()


def test_warc_false_magic():
    inner = warc.member(warc.record(1, "u", b"x", "d", 1, "response", None))
    data = b"junk\x1f\x8b\x08" + inner + b"\x1f\x8b\x08junk" + warc.member(b"not a record") + inner[:-3] + inner
    read = lambda at, n: data[at : at + n]
    assert len(list(warc.scan(read, 0, len(data)))) == 2


def test_warc_empty(spark, tmp_path):
    assert warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w").count() == 0
    assert warc.read(spark, spark.createDataFrame([], "path string, bytes bigint, records bigint")).count() == 0


def test_small_and_equal_pages_spread(spark):
    """Pages that can't be revisits, and revisits of one digest, are dealt over all tasks."""
    rows = spark.range(12_000).selectExpr("id as page_id", "'u' as url", "case when id % 3 = 0 then repeat('hot page ', 200) when id % 3 = 1 then 'small' else null end as html")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = warc.decided(rows)
        sizes = [r["count"] for r in d.groupBy(spark_partition_id()).count().collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 2 * 12_000 / len(sizes) and len(sizes) > 1
        assert {(r["record_type"], r["refers_to"]): r["count"] for r in d.groupBy("record_type", "refers_to").count().collect()} == {("response", None): 8001, ("revisit", 11_997): 3999}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
