"""Nearest neighbours against exact search: recall, exact scores, ties, edges."""

import numpy as np
from gleanery.llm import ann


def exact(rows, every, k):
    """rows: {id: vector} -> {query: [(score, id)]} of all candidates, best first."""
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q, i in enumerate(ids):
        if i % every == 0:
            s = u @ u[q]
            out[i] = sorted(((-round(float(v), 12), j) for v, j in zip(s, ids, strict=True) if j != i))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_on_table(spark, sf_dir):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    want, got = exact(rows, 50, 5), found(ann.op4_ann(spark, sf_dir))
    assert set(got) == set(want)
    hits = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, v in got.items():
        assert [r for r, _, _ in v] == list(range(1, len(v) + 1)) and len(v) == 5
        for _, j, s in v:
            a, b = np.array(rows[q], float), np.array(rows[j], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_ties_copies_and_edges(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 8))
    rows = {i: base[i % 40].tolist() for i in range(400)}
    bad = [(None, [1.0] * 8, "x"), (1000, None, "x"), (1050, [0.0] * 8, "x"), (1100, [float("nan")] + [1.0] * 7, "x"), (1150, [None] + [1.0] * 7, "x"), (1200, [float("inf")] + [1.0] * 7, "x"), (1250, [1.0] * 3, "x"), (1300, [], "x")]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows.items()] + [(0, rows[0], "x")] + bad, "vec_id bigint, embedding array<double>, rank string")
    got = found(ann.neighbours(df))
    assert set(got) == {i for i in rows if i % 50 == 0}
    for q, v in got.items():
        assert [j for _, j, _ in v] == [j for j in range(q % 40, 400, 40) if j != q][:5]
        assert all(s > 1 - 1e-12 for _, _, s in v)


def test_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = found(ann.neighbours(df))
    assert [j for _, j, _ in got[0]] == [2, 1]
    one = spark.createDataFrame([(50, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert ann.neighbours(one).count() == 0
    assert ann.neighbours(one.limit(0)).count() == 0


def test_visits_in_order():
    place = np.array([0.1, 0.6, 0.45])
    v = ann.visits(place, 20)
    cost = [sum((p**2 if d < 0 else (1 - p) ** 2) for p, d in zip(place, row, strict=True) if d) for row in v]
    assert cost == sorted(cost) and len({tuple(r) for r in v}) == len(v) == 20


def test_recall_where_visits_fall_behind(spark):
    """Few visits a query stand in for the many hash functions of a large table."""
    x = np.random.default_rng(5).normal(size=(3000, 64))
    rows = dict(enumerate(x.tolist()))
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    want, got = exact(rows, 50, 5), found(ann.neighbours(df, tables=4, probes=8))
    hits = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
