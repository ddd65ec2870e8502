"""The factorization machine: pair interactions, held-out accuracy, edges."""

import math
import random
import re
import zlib

import numpy as np
from gleanery.llm import toxicity as tox


def test_learns_a_pair():
    """Toxic only if both terms occur: no additive weights can tell."""
    r = random.Random(5)
    rows, y = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({tox.bucket(w) for w in (["insult"] * a + ["group"] * b + [f"w{r.randrange(30)}" for _ in range(6)])})))
        y.append(int(a and b))
    m = tox.fit(rows, np.array(y), np.arange(3000) % 4 == 0)
    place = {int(b): i for i, b in enumerate(m.buckets)}
    score = lambda *ws: m.score_places(sorted(place[tox.bucket(w)] for w in ws if tox.bucket(w) in place))
    assert score("insult", "group") > 0.8 and max(score("insult"), score("group"), score()) < 0.2


def test_learns_a_pair_of_terms_that_tell_nothing_alone():
    """Toxic if both terms occur or neither: each alone is as frequent in both classes, so only pairs can find them."""
    r = random.Random(6)
    rows, y = [], []
    for _ in range(4000):
        a = r.random() < 0.5
        b = r.random() < 0.5
        rows.append(np.array(sorted({tox.bucket(w) for w in (["insult"] * a + ["group"] * b + [f"w{r.randrange(300)}" for _ in range(8)])})))
        y.append(int(a == b))
    y = np.array(y)
    held = np.arange(4000) % 4 == 0
    m = tox.fit(rows, y, held)
    assert {tox.bucket("insult"), tox.bucket("group")} <= set(m.buckets.tolist())
    place = {int(b): i for i, b in enumerate(m.buckets)}
    score = lambda *ws: m.score_places(sorted(place[tox.bucket(w)] for w in ws))
    assert min(score("insult", "group"), score()) > 0.8 and max(score("insult"), score("group")) < 0.2


def test_scores_against_the_formula(spark):
    """Every score of the query, computed anew from the fitted numbers, term by term and pair by pair."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = tox.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    place = {int(b): i for i, b in enumerate(m.buckets)}
    for x in tox.op3_toxicity(spark, d).collect():
        at = sorted({place[b] for b in (tox.bucket(w) for w in set(re.findall(r"\w+", (texts[x["doc_id"]] or "").lower()))) if b in place})
        z = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        want = 1 / (1 + math.exp(-max(-40, min(40, m.slope * z + m.shift))))
        assert abs(x["score"] - want) < 1e-9 and x["predicted"] == int(want >= 0.3) and x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)


def test_rows(spark):
    """Repeated rows score alike; ids given as text; ties of the label (a document labelled both ways counts as toxic)."""
    docs = spark.createDataFrame([(str(i), "bad word" if i % 2 else "good word", "x") for i in range(40)] * 2, "doc_id string, text string, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 0), (0, 1)], "doc_id bigint, toxic int")
    got = {}
    for r in tox.score(docs, tox.train(docs, labels)).collect():
        got.setdefault(r["text"], set()).add(r["score"])
    assert all(len(v) == 1 for v in got.values()) and got["bad word"].pop() > got["good word"].pop()


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    lab = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in tox.op3_toxicity(spark, d).collect()]
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], lab[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in lab]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, z in held if not z]
    assert sum(pairs) / len(pairs) > 0.8


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "text", "x"), (3, "w " * 100_000, "x")], "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    m = tox.train(docs, none)
    got = tox.score(docs, m).collect()
    assert len(got) == 4 and all(r["score"] < 1e-6 and r["predicted"] == 0 for r in got)
    one = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    assert all(0 <= r["score"] <= 1 for r in tox.score(docs, tox.train(docs, one)).collect())
    assert tox.score(docs.limit(0), m).count() == 0
