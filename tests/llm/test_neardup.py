"""Near-duplicates against brute force over shingle sets."""

import random
import re
from itertools import combinations

from compare import rows_of, sql_rows
from gleanery.llm import neardup
from gleanery.llm.common import Scratch
from gleanery.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and 100 * both >= percent * (len(x) + len(y) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], iter(range(1, 10_000))
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 40, 120, 300]))]
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((next(n), " ".join(copy)))
    passage = [r.choice(words) for _ in range(60)]
    rows += [(next(n), " ".join(passage + [r.choice(words) for _ in range(40)])) for _ in range(30)]
    chain = [r.choice(words) for _ in range(200)]
    for i in range(12):  # each near the next, the ends far apart
        chain[i * 15 : i * 15 + 6] = [r.choice(words) for _ in range(6)]
        rows.append((next(n), " ".join(chain)))
    rows += [(next(n), t) for t in ("", None, " \t\n", "One", "one", "a b c", "A B\tC", "a\xa0b c d e", "a b c d", "a b c d")]
    r.shuffle(rows)
    return rows


def test_brute_force(spark):
    for k in (4, 5):
        rows = corpus(seed=k)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bands string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, k=k).collect()}
        assert got == brute(rows, k)


def test_matches_sql(spark, sf_dir):
    assert rows_of(neardup.op5_neardup(spark, sf_dir)) == sql_rows(neardup.ORACLE, sf_dir)


def test_edges(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long_ = "word " * 200_000
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "unlike any other text here"), (None, None), (7, long_), (8, long_ + "end")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect())
    assert got == sorted([("1", 3, "1", True), ("1", 3, "1", True), ("None", 3, "1", False), ("None", 2, "None", True), ("None", 0, "None", True), ("7", 1, "7", True), ("8", 2, "8", True)])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").where("a != b")
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert {r["id"]: r["comp"] for r in components(df, Scratch(spark, "test")).collect()} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


def test_groups_of_similar_texts_make_few_pairs(spark, monkeypatch):
    """A passage that is most of 400 texts, and 300 edited copies of one text: pairs to confirm stay near the number of texts, and no link is lost."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    passage, base = [r.choice(words) for _ in range(80)], [r.choice(words) for _ in range(90)]
    rows = [(i, " ".join(passage + [r.choice(words) for _ in range(r.choice([10, 25, 40]))])) for i in range(400)]
    for i in range(400, 700):
        copy = list(base)
        for _ in range(r.randint(0, 4)):
            copy[r.randrange(90)] = r.choice(words)
        rows.append((i, " ".join(copy)))
    seen = []
    was = neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, total, *more: (seen.append(total), was(pairs, total, *more))[1])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4).collect()}
    assert got == brute(rows, 4)
    assert sum(seen) < 4 * len(rows)
