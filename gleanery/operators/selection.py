"""Selection: fill to a target, first-wins dedup, greedy containment, positional joins, prefix budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..sources.stages import shared_dir


def top_k(df: DataFrame, by: list[str], order: list, k) -> DataFrame:
    """The first k of each group in an order; Spark cuts each partition to k before the exchange."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", n).where(F.col("place") <= k)


def first_wins(df: DataFrame, by: list, order: list) -> DataFrame:
    """One row of each key, the first in order (ascending; nulls last). An aggregate rather than a window, so rows of a frequent key are combined before the exchange."""
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    place = F.struct(*[x for o in order for c in [F.col(o) if isinstance(o, str) else o] for x in (c.isNull(), c)])
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(F.struct(*df.columns), place).alias("_r")).select("_r.*")


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"[^\pL\pM\pN_]+", " "))


def keep_titles(titles: Column) -> Column:
    """Of titles in order, those that neither contain nor are contained in one kept before."""
    return F.aggregate(titles, F.array().cast("array<string>"), lambda kept, t: F.when(
        F.exists(kept, lambda k: F.contains(normal_title(t), normal_title(k)) | F.contains(normal_title(k), normal_title(t))), kept).otherwise(F.concat(kept, F.array(t))))


# Code points of the pieces by which contained titles are sought; starts of pieces cut from a title at once.
PIECE, STARTS = 8, 64


def pieces(group: Column, text: Column, n: int) -> Column:
    """Hashes of a group and each run of n code points of a text, distinct. A place in a string is found by a walk from its start, so a long text is cut into blocks first."""
    block = lambda b: F.substring(text, b * STARTS + 1, F.lit(STARTS + n - 1))
    of = lambda part: F.transform(F.sequence(F.lit(1), F.length(part) - n + 1), lambda i: F.xxhash64(group, F.substring(part, i, F.lit(n))))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - n) / STARTS).cast("int")), lambda b: A.let(block(b), of)))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def containing(rows: DataFrame) -> DataFrame:
    """(early, late) ids of rows(id, g, place, n), distinct texts n in groups g, one of which holds the other, by place. A text of PIECE code points or more is sought by that of its
    pieces which the fewest texts of its group hold (one that no other holds is in no other), a shorter one as a whole; the texts decide."""
    long_ = rows.where(F.length("n") >= PIECE).select("id", F.explode(pieces(F.col("g"), F.col("n"), PIECE)).alias("k"))
    many = long_.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    rarest = long_.join(many, "k").groupBy("id").agg(F.min(F.struct("c", "k")).alias("m")).where("m.c > 1").select(F.col("id").alias("short"), "m.k")
    brief = rows.where(F.length("n").between(1, PIECE - 1))
    sizes = sorted(r[0] for r in brief.select(F.length("n")).distinct().collect())  # seven numbers at most
    sought = rarest.unionByName(brief.select(F.col("id").alias("short"), F.xxhash64("g", "n").alias("k")))
    held = long_
    if sizes:
        held = held.unionByName(rows.select("id", F.explode(F.concat(*[pieces(F.col("g"), F.col("n"), n) for n in sizes])).alias("k")))
    met = sought.join(held, "k").where("short <> id").select("short", F.col("id").alias("long"))
    named = lambda x: rows.select(F.col("id").alias(x), F.struct("g", "place", "n").alias(f"{x}_"))
    pairs = met.join(named("short"), "short").join(named("long"), "long").where(F.col("short_.g").eqNullSafe(F.col("long_.g")) & F.contains("long_.n", "short_.n"))
    first = F.col("short_.place") < F.col("long_.place")
    return pairs.select(F.when(first, F.col("short")).otherwise(F.col("long")).alias("early"), F.when(first, F.col("long")).otherwise(F.col("short")).alias("late"))


def gone_by_order(pairs: DataFrame) -> DataFrame | None:
    """Ids that go when of pairs(early, late) each late one goes whose early one stays: in rounds, those that no open pair has as late stay, and what they meet goes. None if no
    pairs. Rounds are as many as the longest run of pairs that hang on each other."""
    gone, left = None, stored(pairs.distinct())
    while not left.isEmpty():
        stays = left.select("early").join(left.select(F.col("late").alias("early")), "early", "left_anti").distinct()
        goes = stored(left.join(stays, "early", "left_semi").select(F.col("late").alias("id")).distinct())
        gone = goes if gone is None else gone.unionByName(goes)
        left = stored(left.join(goes.withColumnRenamed("id", "early"), "early", "left_anti").join(goes.withColumnRenamed("id", "late"), "late", "left_anti"))
    return gone


def kept_titles(df: DataFrame, group: str, order: str, title: str) -> DataFrame:
    """keep_titles over tables: (group, order, title) of each group's titles in order that neither contain nor are contained in one kept before. No group meets in one task:
    only titles that hold each other meet. A blank title is in every other, so it stays alone where it is first and goes elsewhere."""
    place = F.struct(F.col(order).alias("o"), F.col(title).alias("t"))
    first = df.groupBy(F.col(group).alias("g"), normal_title(F.col(title)).alias("n")).agg(F.min(place).alias("place"))  # a title met before is never kept
    lead = first.groupBy("g").agg(F.min_by(F.struct("n"), "place").alias("lead")).withColumnRenamed("g", "lead_g")
    open_ = first.join(lead, F.col("g").eqNullSafe(F.col("lead_g"))).where((F.col("n") == "") == (F.col("lead.n") == ""))
    rows = stored(open_.select(F.monotonically_increasing_id().alias("id"), "g", "place", "n"))
    gone = gone_by_order(containing(rows))
    kept = rows if gone is None else rows.join(gone, "id", "left_anti")
    return kept.select(F.col("g").alias(group), F.col("place.o").alias(order), F.col("place.t").alias(title))


def zip_join(a: DataFrame, b: DataFrame, by: list[str], order_a: list, order_b: list) -> DataFrame:
    """The i-th row of a group with the i-th of the other's; the shorter wins."""
    number = lambda df, order: df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return number(a, order_a).join(number(b, order_b), [*by, "_i"]).withColumnRenamed("_i", "place")


def prefix_budget(df: DataFrame, by: list[str], order: list, cost: str, most: float) -> DataFrame:
    """Rows in order while the running cost stays within the budget; the first that breaks it ends the prefix."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w)).withColumn("_ok", F.min(F.when(F.col("running") <= most, 1).otherwise(0)).over(w)).where("_ok = 1").drop("_ok")


def unique_titles(titles: Column) -> Column:
    """Titles in order made unique without regard to case, by the smallest number from 2 that is free."""

    def step(kept: Column, t: Column) -> Column:
        taken = lambda x: F.exists(kept, lambda k: F.lower(k) == F.lower(x))
        tries = F.transform(F.sequence(F.lit(2), F.size(kept) + 2), lambda i: F.concat_ws(" ", t, i.cast("string")))
        return F.concat(kept, F.array(F.when(taken(t), F.element_at(F.filter(tries, lambda x: ~taken(x)), 1)).otherwise(t)))

    return F.aggregate(titles, F.array().cast("array<string>"), step)


def shuffled_options(options: Column, key: Column) -> Column:
    """A fixed shuffle: by a hash of key and option."""
    return F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.xxhash64(key, o).alias("h"), o.alias("o")))), lambda s: s["o"])


def stored(df: DataFrame) -> DataFrame:
    """Cut from its lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def nearest_in_group(df: DataFrame, key: str, group: str, x: str, y: str, most: int = 64) -> DataFrame:
    """key, nearest: for each row the other row of its group at the smallest L1 distance, the smaller key in a tie; rows alone in their group give none.

    Rows at one point count once, by their two smallest keys. Points lie in square cells, started so small that none holds over `most`. A row looks into the nine cells
    around it, and what is found within a cell's side is final; the others look again in cells of twice the side, at last in all of the group. Rows without group or finite
    coordinates take no part."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (x, y)]
    rows = stored(df.select(F.col(key).alias("key"), F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).where(F.col(group).isNotNull() & fine[0] & fine[1]).distinct())
    place = F.row_number().over(Window.partitionBy("g", "x", "y").orderBy("key"))
    points = stored(rows.withColumn("p", place).where("p <= 2").groupBy("g", "x", "y").agg(F.min("key").alias("k1"), F.max(F.when(F.col("p") == 2, F.col("key"))).alias("k2")))
    n, groups, reach = points.agg(F.count(F.lit(1)), F.count_distinct("g"), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    span = 2 * float(reach or 0) or 1.0
    side = span / max(n / max(groups, 1), 1) ** 0.5
    at = lambda c, side: F.floor(F.col(c).cast("double") / side)
    while side > span * 1e-7 and (points.groupBy("g", at("x", side), at("y", side)).count().agg(F.max("count")).first()[0] or 0) > most:
        side /= 2
    other = F.when(F.col("k1") != F.col("key"), F.col("k1")).otherwise(F.col("k2"))
    same = rows.join(points.where("k2 is not null"), ["g", "x", "y"]).select("key", F.lit(0.0).alias("dist"), other.alias("nearest"))
    done, left = [same], rows.join(points.where("k2 is null").select("g", "x", "y"), ["g", "x", "y"])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        last = side > span
        calls = left.withColumn("c", F.explode(around)).select("*", (at("x", side) + F.col("c.i")).alias("cx"), (at("y", side) + F.col("c.j")).alias("cy")).drop("c")
        cells = points.select("g", F.col("x").alias("px"), F.col("y").alias("py"), "k1", "k2", at("x", side).alias("cx"), at("y", side).alias("cy"))
        dist = F.abs(F.col("x") - F.col("px")).cast("double") + F.abs(F.col("y") - F.col("py")).cast("double")
        met = calls.join(cells, ["g", "cx", "cy"], "left").withColumn("best", F.when(other.isNotNull(), F.struct(dist.alias("dist"), other.alias("nearest"))))
        seen = stored(met.groupBy("key", "g", "x", "y").agg(F.min("best").alias("best")))
        final = F.coalesce(F.col("best.dist") < side * (1 - 1e-6), F.lit(False)) | F.lit(last)
        done.append(seen.where(final & F.col("best").isNotNull()).select("key", "best.dist", "best.nearest"))
        left = seen.where(~final).drop("best")
        if last or left.isEmpty():
            break
        side *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("key").agg(F.min_by("nearest", F.struct("dist", "nearest")).alias("nearest"))


FEW_PASSAGES = 4096


def grounded(docs: DataFrame, passages: DataFrame, doc: str, item: str, most: int = FEW_PASSAGES) -> DataFrame:
    """(item, doc) of passages(item, passage) that docs(doc, text) hold whole. Passages of seven words or more are sought by a hash of five of their inner words (their first and last may
    be parts of longer words in a text); the text decides. Up to `most` passages (counted, so what is sent to the tasks is bounded) are matched within a document's row; of more,
    hashes meet in a join, and shorter passages are compared with every text."""
    p = passages.where(F.col("passage").isNotNull()).withColumn("_w", T.words(F.col("passage")))
    hashed = lambda ws: F.xxhash64(F.array_join(ws, " "))
    p = p.select(item, "passage", F.when(F.size("_w") >= 7, hashed(F.slice("_w", 2, 5))).alias("_key"))
    windows = A.let(T.words(F.col("text")), lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1))), lambda i: hashed(F.slice(ws, i, 5))))
    d = docs.where(F.col("text").isNotNull())
    if p.limit(most + 1).count() > most:
        keys = d.select(doc, F.explode(F.array_distinct(windows)).alias("_key"))
        met = keys.join(p.where("_key is not null"), "_key").select(item, "passage", doc).join(d.select(doc, "text"), doc)
        whole = met.where(F.contains("text", "passage")).select(item, doc)
        return whole.unionByName(d.join(F.broadcast(p.where("_key is null").drop("_key")), F.contains("text", "passage")).select(item, doc)) if not p.where("_key is null").isEmpty() else whole
    short = [r["passage"] for r in p.where("_key is null").select("passage").distinct().collect()]
    known = [r["_key"] for r in p.where("_key is not null").select("_key").distinct().collect()]
    keys = F.array_intersect(windows, F.array(*map(F.lit, known)).cast("array<bigint>")) if known else F.array().cast("array<bigint>")
    texts = F.filter(F.array(*map(F.lit, short)), lambda s: F.contains("text", s)) if short else F.array().cast("array<string>")
    hits = d.select(doc, "text", keys.alias("_k"), texts.alias("_s"))
    long_ = hits.where(F.size("_k") > 0).select(doc, "text", F.explode("_k").alias("_key")).join(F.broadcast(p.where("_key is not null")), "_key").where(F.contains("text", "passage"))
    brief = hits.select(doc, F.explode("_s").alias("passage")).join(F.broadcast(p.where("_key is null")), "passage")
    return long_.select(item, doc).unionByName(brief.select(item, doc))
