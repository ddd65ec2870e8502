"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact distances for the candidates.

Each of `tables` hash tables has K functions h(u) = floor(a.u / width + b) of the normalised vector, a Gaussian (orthogonalised within a table), so near vectors
tend to fall into one slot of each. A query visits its own bucket and those one or more slots away, in the order of estimated success: the sum of the squared
distances of its projections to the slot borders that a visit steps over. K grows with the logarithm of the number of vectors, but only as far as the visits keep
up with it: a sample of queries is settled by an exact pass, and K is the largest at which their visits meet the share `aim` of the true neighbours. Where that
holds K back, buckets grow with the table, and with them the candidates of a visit.

Rows with equal vectors are one class (two 64-bit hashes of the components), held by its smallest id and listing its k + 1 smallest ids, so a vector that
a third of all rows share costs one entry. Index entries and visits are brought together by bucket, buckets beyond `block` entries are dealt over several
tasks with the visits repeated there, and a task multiplies a block of visits with a block of entries. Each visit returns the classes that can be among its
k + 1 best (all ties), with the cosine in double precision of the original vectors; the merge over tables keeps a query's best k rows.

A query that finds fewer than k rows is settled by an exact pass over all vectors, in blocks of queries. Queries are the rows whose id is divisible by
`every`; candidates are all rows.

Defined cases: ids null, vectors null, of zero length, zero, or with null or non-finite components take no part, nor do vectors of another length than the most
frequent one; rows repeated with one id and vector count once; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table


class Hashes:
    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.width, self.a, self.b = width, [], rng.uniform(0, 1, (tables, functions))
        for _ in range(tables):
            a = rng.normal(size=(dim, functions))
            self.a.append(np.linalg.qr(a)[0] * np.sqrt(dim) if functions <= dim else a)

    def slots(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and the places within them in [0, 1)."""
        p = unit @ self.a[table] / self.width + self.b[table]
        h = np.floor(p)
        return h.astype(np.int64), p - h

    @staticmethod
    def keys(slots: np.ndarray, table: int) -> np.ndarray:
        acc = np.full(len(slots), table + 1, np.uint64)
        for j in range(slots.shape[1]):
            acc = (acc ^ slots[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        return acc.view(np.int64)


def visits(place: np.ndarray, probes: int) -> np.ndarray:
    """The first `probes` perturbations (own bucket first) by estimated success: sets over the 2 K border distances in ascending order, grown by the usual shift and
    expand steps on a heap; a set that moves one function both ways is passed over."""
    k = len(place)
    borders = sorted([(place[i] ** 2, i, -1) for i in range(k)] + [((1 - place[i]) ** 2, i, 1) for i in range(k)])
    out, heap = [np.zeros(k, np.int64)], [(borders[0][0], (0,))]
    while heap and len(out) < probes:
        cost, steps = heapq.heappop(heap)
        moved = [borders[s][1] for s in steps]
        if len(set(moved)) == len(moved):
            d = np.zeros(k, np.int64)
            for s in steps:
                d[borders[s][1]] = borders[s][2]
            out.append(d)
        last = steps[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (cost + borders[last + 1][0], (*steps, last + 1)))
            heapq.heappush(heap, (cost - borders[last][0] + borders[last + 1][0], (*steps[:-1], last + 1)))
    return np.array(out)


def reached(hashes: Hashes, queries: np.ndarray, of: np.ndarray, near: np.ndarray, probes: int) -> np.ndarray:
    """For pairs of a query (its place in `of`) and a vector, whether a visit in any table meets the vector."""
    u, w, met = unit(queries), unit(near), np.zeros(len(of), bool)
    for t in range(len(hashes.a)):
        slots, places = hashes.slots(u, t)
        steps = [set(map(tuple, visits(p, probes).tolist())) for p in places]
        away = hashes.slots(w, t)[0] - slots[of]
        met |= np.array([tuple(d) in steps[q] for q, d in zip(of, away.tolist(), strict=True)], bool)
    return met


def fitted(most: int, aim: float, queries: np.ndarray, of: np.ndarray, near: np.ndarray, tables: int, probes: int, width: float, seed: int) -> Hashes:
    """The hashes of at most `most` functions a table whose visits meet the share `aim` of the pairs; of one function if none does."""
    for functions in range(most, 0, -1):
        hashes = Hashes(queries.shape[1], tables, functions, width, seed)
        if not len(of) or reached(hashes, queries, of, near, probes).mean() >= aim:
            break
    return hashes


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Normalised in two steps, so that very large or very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one order of summation, so that equal vectors get equal scores."""
    a, b = a / np.abs(a).max(axis=-1, keepdims=True), b / np.abs(b).max(axis=-1, keepdims=True)
    return np.clip((a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1))), -1.0, 1.0)


def best(queries: np.ndarray, entries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of the entries that can be among its k best: all that reach the k-th score, ties and rounding included."""
    s = unit(queries) @ unit(entries).T
    out = []
    for i in range(len(queries)):
        at = np.arange(s.shape[1]) if s.shape[1] <= k else np.flatnonzero(s[i] >= np.partition(s[i], -k)[-k] - 1e-9)
        out.append((at, cosine(entries[at], queries[i][None, :])))
    return out


def found(of: pa.Array, ids: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    q = np.repeat(of, [len(p[0]) for p in parts])
    at, score = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids[at.astype(np.int64)], pa.int64()), pa.array(score, pa.float64())], names=["query_id", "rep", "score"])


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, tables: int = 12, probes: int = 64, width: float = 2.4, block: int = 2048, seed: int = 3, id_col: str = "vec_id",
               vector_col: str = "embedding", aim: float = 0.95, sample: int = 200) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where("vec_id is not null and size(v) > 0").where(fine)
    sizes = v.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = int(sizes[0]["dim"])
    v = v.where(F.size("v") == dim).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    v = scratch.cut(v, "vectors")
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    listed = v.select("h1", "h2", "vec_id").distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    classes = listed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    classes = scratch.cut(classes, "classes")
    held = scratch.cut(v.join(classes.select("h1", "h2", F.col("rep").alias("vec_id")), ["h1", "h2", "vec_id"], "left_semi").dropDuplicates(["h1", "h2"]).select(F.col("vec_id").alias("rep"), "v"), "held")
    queries = v.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "h1", "h2"]).select(F.col("vec_id").alias("query_id"), "v")
    queries = scratch.cut(queries, "queries")
    n = held.count()
    x, of, near = sampled(queries, held, dim, k, sample, scratch)
    hashes = fitted(max(4, round(0.65 * np.log2(max(n, 2)))), aim, x, of, near, tables, probes, width, seed)
    names = ["key", "kind", "id", "v"]

    def index(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            u = unit(x)
            for t in range(tables):
                keys = Hashes.keys(hashes.slots(u, t)[0], t)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.zeros(len(x), np.int32)), batch.column("rep"), batch.column("v")], names=names)

    def probe(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            u = unit(x)
            for t in range(tables):
                slots, places = hashes.slots(u, t)
                steps = [visits(p, probes) for p in places]
                of = np.repeat(np.arange(len(x)), [len(s) for s in steps])
                keys = Hashes.keys(slots[of] + np.concatenate(steps), t) if len(x) else np.empty(0, np.int64)
                for a in range(0, len(of), 20_000):
                    part = pa.array(of[a : a + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 20_000]), pa.array(np.ones(len(part), np.int32)), batch.column("query_id").take(part), batch.column("v").take(part)], names=names)

    kinds = "key long, kind int, id long, v array<double>"
    entries, calls = held.mapInArrow(index, kinds), queries.mapInArrow(probe, kinds)
    large = entries.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    large = scratch.cut(large, "large")
    entries = entries.join(large, "key", "left").select(*names, F.pmod(F.hash("id"), F.coalesce("parts", F.lit(1))).alias("part"))
    calls = calls.join(large, "key", "left").select(*names, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = entries.unionByName(calls).repartition("key", "part").sortWithinPartitions("key", "part", "kind")

    def rank(batches):
        """Sorted rows: a bucket's entries, then the visits to it."""
        now, ids, rows = None, [], []
        for batch in batches:
            keys, parts, kind = (batch.column(c).to_numpy() for c in ("key", "part", "kind"))
            ident, x = batch.column("id").to_numpy(), matrix(batch.column("v"), dim)
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if (keys[a], parts[a]) != now:
                    now, ids, rows = (keys[a], parts[a]), [], []
                if kind[a] == 0:
                    ids.append(ident[a:b])
                    rows.append(x[a:b])
                elif ids:
                    yield found(ident[a:b], np.concatenate(ids), best(x[a:b], np.concatenate(rows), k + 1))

    hits = met.mapInArrow(rank, "query_id long, rep long, score double")
    hits = scratch.cut(top(hits, k + 1), "hits")
    out = expanded(hits, classes, k)
    have = out.groupBy("query_id").count()
    rows = v.select("vec_id").distinct().count()
    want = min(k, rows - 1)
    short = queries.join(have, "query_id", "left").where(F.coalesce("count", F.lit(0)) < want).select("query_id", "v").orderBy("query_id")
    short = scratch.cut(short, "short")
    if not short.isEmpty():
        more = exact(short, held, dim, k + 1, scratch)
        out = expanded(hits.join(short.select("query_id"), "query_id", "left_anti").unionByName(more), classes, k)
    return out.select("query_id", "rank", "vec_id", "score")


def top(hits: DataFrame, k: int) -> DataFrame:
    """A query's k best classes; a class met in several tables counts once."""
    one = hits.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("place") <= k).drop("place")


def expanded(hits: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Classes to rows: each has its k + 1 smallest ids, enough for k without the query's own."""
    rows = hits.join(classes.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def sampled(queries: DataFrame, held: DataFrame, dim: int, k: int, sample: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of at most `sample` queries, and pairs with their nearest classes besides their own: the query's place, the vector."""
    some = scratch.cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "sample")
    at = {r["query_id"]: r["v"] for r in some.collect()}
    if not at:
        return np.empty((0, dim)), np.empty(0, np.int64), np.empty((0, dim))
    place = {q: i for i, q in enumerate(at)}
    rows = held.join(F.broadcast(exact(some, held, dim, k + 1, scratch)), "rep").select("query_id", "v").collect()
    pairs = [(place[r["query_id"]], r["v"]) for r in rows if r["v"] != at[r["query_id"]]]
    return np.array(list(at.values())), np.array([p for p, _ in pairs], np.int64), np.array([v for _, v in pairs]).reshape(-1, dim)


def exact(short: DataFrame, held: DataFrame, dim: int, k: int, scratch: Scratch, block: int = 1000) -> DataFrame:
    """All classes against the queries that found too few, a block of queries at a time: a pass over the vectors a block."""
    out, last = None, None
    while True:
        part = (short if last is None else short.where(F.col("query_id") > last)).orderBy("query_id").limit(block).collect()
        if not part:
            return out
        ids, x = np.array([r["query_id"] for r in part]), np.array([r["v"] for r in part])
        last = int(ids[-1])

        def run(batches, ids=ids, x=x):
            for batch in batches:
                rows = matrix(batch.column("v"), dim)
                if len(rows):
                    yield found(ids, batch.column("rep").to_numpy(), best(x, rows, k))

        hits = scratch.cut(top(held.mapInArrow(run, "query_id long, rep long, score double"), k), "exact")
        out = hits if out is None else out.unionByName(hits)


def op4_ann(spark, sf_dir):
    return neighbours(read_table(spark, sf_dir, "embeddings"))
