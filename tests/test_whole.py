"""Queries over the whole of their input, against brute force."""

import numpy as np
from gleanery.operators import selection
from gleanery.plans import queries as plans


def nearest(rows):
    """rows: [(key, group, x, y)] -> {key: key of the nearest other row of the group}."""
    k, g, x, y = (np.array(c) for c in zip(*rows, strict=True))
    x, y, out = x.astype(np.float32), y.astype(np.float32), {}
    for i in range(len(k)):
        d = np.abs(x - x[i]).astype(float) + np.abs(y - y[i]).astype(float)
        at = np.flatnonzero((g == g[i]) & (k != k[i]))
        if len(at):
            out[int(k[i])] = int(min(zip(d[at], k[at], strict=True))[1])
    return out


def test_nearest_caption_of_all_rows(spark, sf_dir):
    rows = [(r["vec_id"], r["label"], r["embedding"][0], r["embedding"][1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert {r["vec_id"]: r["caption"] for r in plans.QUERIES["nearest_caption"](spark, sf_dir).collect()} == nearest(rows)


def test_nearest_in_group_copies_clusters_outliers(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(size=(150, 2)), 5 + 1e-4 * rng.normal(size=(200, 2)), rng.integers(0, 4, (100, 2)), [[1000, -1000], [-900, 5]]]).astype(np.float32)
    rows = [(i, i % 3, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(1000, 7, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (1001, None, 0.0, 0.0), (1002, 1, None, 0.0), (1003, 1, float("nan"), 0.0)], "key long, g long, x float, y float")
    assert {r["key"]: r["nearest"] for r in selection.nearest_in_group(df, "key", "g", "x", "y").collect()} == nearest(rows)


def test_numbers_of_the_whole_text(spark, tmp_path):
    text = "3 " + "word " * 1000 + "12"
    spark.createDataFrame([(1, text, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in plans.QUERIES["data_points_ratio"](spark, str(tmp_path)).collect()] == [(1, 2, 4.0)]


def test_whole_titles(spark, tmp_path):
    titles = ["One two three four", "One two three five", "one two THREE four!", "three five", "Six  seven eight nine"]
    spark.createDataFrame([(25 * i, f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["kept"] for r in plans.QUERIES["title_dedup_containment"](spark, str(tmp_path)).collect()] == [["One two three four", "One two three five", "Six seven eight nine"]]


def first_titles(rows):
    """rows: [(group, order, title)] -> the same, kept by a fold over each group."""
    kept = {}
    for g, o, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        n, have = "".join(c if c.isalnum() else " " for c in t.lower()).strip(), kept.setdefault(g, [])
        n = " ".join(n.split())
        if not any(n in k or k in n for _, _, k in have):
            have.append((o, t, n))
    return {(g, o, t) for g, have in kept.items() for o, t, _ in have}


def test_kept_titles_of_large_groups(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abé"), rng.integers(1, 5)))
    rows = [(int(rng.integers(0, 3)), i, " ".join(word() for _ in range(rng.integers(1, 7)))) for i in range(600)]
    common = "the official site of a shop: product "
    rows += [(7, i, common + str(i)) for i in (12, 120, 3, 31, 1, 205)] + [(8, 1, "..."), (8, 2, "Any title"), (9, 1, "Any title"), (9, 2, "!"), (9, 3, "many titles")]
    rows += [(10, 1, "x" * 300 + " needle in long " + "y" * 300), (10, 2, "needle in long"), (10, 3, "le in lo"), (10, 4, "needles"), (None, 1, "some words here"), (None, 2, "Words here"), (None, 2, "no others")]
    rows += [(11, i, t) for i, t in enumerate(["long title one two", "title one", "title one four", "le one four five", "one four fiv", "zzz"])]
    df = spark.createDataFrame(rows, "g long, o long, t string")
    got = [tuple(r) for r in selection.kept_titles(df, "g", "o", "t").select("g", "o", "t").collect()]
    assert len(got) == len(set(got)) and set(got) == first_titles(rows)


def test_titles_are_not_folded_in_one_row(spark, sf_dir):
    plan = plans.QUERIES["title_dedup_containment"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(CASE WHEN exists(" not in plan and "aggregate(transform(" not in plan
