"""Filter interactions: SQL, orders applied one by one, edge cases."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from compare import rows_of, sql_rows
from gleanery.llm import audit

DOCS, LABELS = "doc_id bigint, text string, lang string, part string, mask int", "doc_id bigint, quality int, toxic int"


def fails(rows):
    """The filters that each (id, text, lang) fails, from the definitions."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t, i)
        out.append(set("A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i != first)))
    return out


def brute(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    bad, out = fails(rows), Counter()
    parts = {lang or "" for *_, lang in rows}
    for part in parts:
        mine = [(i, b) for (i, _, lang), b in zip(rows, bad, strict=True) if (lang or "") == part]
        total, got = Counter(), {}
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in mine[k][1]]
                there = set(left)
                redundant = sum(f in b for k, (_, b) in enumerate(mine) if k not in there)
                left = [k for k in left if f not in mine[k][1]]
                total[f] += len(gone)
                got["".join(order), step] = (len(left), len(gone), redundant, sum(b == {f} for _, b in mine), sum(mine[k][0] in good for k in gone), sum(mine[k][0] in toxic for k in gone))
        for (order, step), v in got.items():
            out[part, order, step, *v, total[order[step - 1]]] += 1
    return out


def run(spark, rows, labels):
    d = spark.createDataFrame([(i, t, lang, "x", 9) for i, t, lang in rows], DOCS)
    return Counter(tuple(r) for r in audit.interactions(d, spark.createDataFrame(labels, LABELS)).collect())


def test_sql(spark, sf_dir):
    assert rows_of(audit.op11_filter_audit(spark, sf_dir)) == sql_rows(audit.ORACLE, sf_dir)


def test_orders_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, "en"), (2, "", "en"), (3, long, "en"), (4, long, "de"), (4, long, "de"), (4, long, "en"), (2, long, "fr"), (5, "a " * 300, None), (6, "a " * 300 + "#", ""), (7, "ABC" * 10, "en"), (8, f"{long} $ XYZ", "en"), (9, "a\x1cb  c", "en"),
            (None, long, "en"), (None, "only here", "en"), (None, "only here", "en"), (10, "é" * 96 + "ABC", "fr"), (11, "é" * 97 + "ABC", "fr"), (12, long + " é" * 50, "fr")]
    labels = [(3, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (7, 0, None), (8, 1, 0), (99, 1, 1), (None, 1, 1)]
    want = brute(rows, labels)
    assert run(spark, rows, labels) == want and len(want) == 600 * 4
    assert run(spark, [], labels) == Counter() and run(spark, rows[:1], []) == brute(rows[:1], [])


def test_words_in_pieces(monkeypatch):
    monkeypatch.setattr(audit, "PIECE", 7)
    for text in ("", "  \n", "one two  three two\x0bone\x0cfour", "x" * 50 + " y", "é " * 30):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert audit.words(text.encode()) == (len(w), len(set(w)))


def test_matrices():
    orders, which, m = audit.matrices()
    assert len(orders) == 120 and all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    assert (m["removed"] + m["redundant"] == [[mask >> f & 1 for f in which] for mask in range(32)]).all()
