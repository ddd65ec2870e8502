"""Shared lines: SQL, brute force, edge cases."""

import hashlib
from collections import defaultdict

from compare import rows_of, sql_rows
from gleanery.llm import linededup

DOCS = "doc_id bigint, text string, kept int, _drop string, _row int"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least_docs=2, least_chars=10):
    """(id, n_lines, n_dropped, kept) a row; rows of one id are one document, rows without an id too, after all others."""
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    gone = lambda line, i: len(h := holders.get(key(line), ())) >= least_docs and i != min(h, key=order)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not gone(x, i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def run(spark, rows, **k):
    df = linededup.dedup_lines(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS), **k)
    assert df.columns == ["doc_id", "text", "kept", "_drop", "_row", "_kept", "n_lines", "n_dropped"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["_kept"]) for r in df.collect()), key=str)


def test_sql(spark, sf_dir):
    assert rows_of(linededup.op13_line_dedup(spark, sf_dir)) == sql_rows(linededup.ORACLE, sf_dir)


def test_edges(spark):
    common = "A Shared Line of text"
    rows = [(1, None), (2, ""), (3, f"{common}\nown line number three\n{common.lower()}"), (4, f"\t {common.upper()} \r\nshort\nÄÖÜ ÄÖÜ äöü x\n"), (5, "short\nÄÖÜ ÄÖÜ äöü X\näöü äöü äöü x"), (5, f"again {common}\n{common}"),
            (6, "\n\n\n"), (6, "\n\n\n"), (None, f"{common}\nonly without id 1\nonly without id 1"), (None, "only without id 1\nown line number three"), (7, f"{common}\x1c\nx"), (8, f"x\n\n{common}\n")]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, rows, least_docs=3, least_chars=4) == sorted(brute(rows, 3, 4), key=str)
    assert run(spark, []) == []


def test_hot_line_and_long_texts(spark):
    rows = [(i, f"the line of everyone\nline of {i // 2} two\nline of document {i}") for i in range(300)]
    rows += [(1000, "\n".join(f"row {i % 7000} of many" for i in range(20000)) + " " * 300000 + "end"), (1001, "\n".join(f"ROW {i} of many" for i in range(9000)))]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_digests_of_the_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.op13_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)}
    assert sum(d for _, d, _ in got.values()) > 0
