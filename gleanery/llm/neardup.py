"""Near-duplicate documents: banded MinHash candidates, odd-sketch verification, exact confirmation, connected components.

Pass 1 (one read of the texts) makes a small signature a document: set size, 128-bit digest of the shingle set, one key a band, and an odd sketch:
a bitmap whose bit hash(i, m_i) is flipped for each MinHash sample m_i. Two sketches differ where samples differ, so the population count of their XOR
bounds the number of unequal samples and with it the similarity.

Equal sets are one class, held by its smallest id, from the first: thousands of copies cost one row each. Between class representatives:
  1. rounds of pivots: in each band bucket that still holds several components, one member is the pivot, first the one whose buckets are largest in sum, which
     stands near the middle of a group; a member is paired with that pivot of another component that it shares most buckets with (one pair a member, however
     large its buckets), pairs that pass the size bound and the sketch bound are confirmed on full shingle sets, and the links' components are found;
  2. what then remains in buckets of several components is done exactly, by prefixes: with all shingles in one order, those fewest of the remaining documents
     have first, two sets of this similarity share one among the first n - ceil(0.8 n) + 1 of each, and early enough. A passage that many documents share
     stands late in that order and makes no pairs. Pairs within one component need no test, as they can't change it. The others pass the same three tests.
Buckets have no cap. With 64 bands of 6, a pair at 0.8 shares no bucket with probability (1 - 0.8^6)^64 = 4e-9, and the sketch bound (five standard deviations of
the unequal samples at 0.8, three of the bits that they set) loses about one in a million.

Frequent shingles are joined by broadcast, and pivots with many full sets dealt over several tasks; there can be only as many of either as their share of the
rows allows (`common.met`, `common.dealt`). Other joins are of narrow written tables, so Spark splits a skewed key itself.

Defined cases: null or empty text, or text of white space only: no shingles, linked with nothing; fewer words than the shingle length: the whole sequence
is the one shingle; rows with one id are one node; rows without an id link nothing themselves, but show the class of their text (kept only if no row
with an id has an equal set); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, blocks, bounded, dealt, met, read_table
from .components import extended

BANDS, ROWS, SKETCH_WORDS = 64, 6, 32
ROUNDS = 2  # of pivots, first by reach, then by hash; what they leave open is done exactly, however many there are


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (fixed odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, table: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.split() splits at exactly the six white-space bytes of the contract, bytes.lower() at A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((WordHashes() if table is None else table).__getitem__, words), np.uint64, n)
    if n < k:
        k = n
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    return np.unique(mix64(acc))


def samplers(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, 2 * n + 1, dtype=np.uint64)
    r = mix64(i * np.uint64(0x9E3779B97F4A7C15))
    return (r[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[n:] >> np.uint64(32)).astype(np.uint32)


MUL, ADD = samplers(BANDS * ROWS)


def minhashes(s: np.ndarray) -> np.ndarray:
    """The smallest value of each sampler (a permutation of the 32-bit numbers) over the set, in blocks of shingles so that long texts stay in cache."""
    low, h = np.full(len(MUL), 0xFFFFFFFF, np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 512):
        x = h[None, at : at + 512] * MUL[:, None]
        x += ADD[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low.astype(np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    acc = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + low[j::ROWS][:BANDS])
    return acc.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    at = mix64(low ^ (np.arange(len(low), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_bound(similarity: float, samples: int = BANDS * ROWS, bits: int = 64 * SKETCH_WORDS) -> int:
    """Most bits in which sketches of sets this similar differ: n unequal samples flip 2 n bits at random places, which leaves bits / 2 (1 - exp(-4 n / bits)) of them
    odd; n is taken five standard deviations up, the bits three."""
    p = 1 - similarity
    n = samples * p + 5 * (samples * p * (1 - p)) ** 0.5
    odd = bits / 2 * (1 - math.exp(-4 * n / bits))
    return int(odd + 3 * (odd * (1 - odd / bits)) ** 0.5)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, digest, bands, sketch."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        table = WordHashes()
        for batch, texts in blocks(batches):
            n, digest, bands, sketch = [], [], [], []
            for text in texts:
                s = shingle_set(text, k, table)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low = minhashes(s) if len(s) else None
                bands.append(None if low is None else band_keys(low))
                sketch.append(None if low is None else odd_sketch(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                                              pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        table = WordHashes()
        for batch, texts in blocks(batches):
            sets = [shingle_set(t, k, table).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(run, f"id {kind.simpleString()}, shingles array<bigint>")


def alike(percent: int, bound: int):
    """The two cheap tests on (n, sketch) of x and y: set sizes that allow the similarity, sketches that allow it."""
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    differ = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return (100 * small >= percent * large) & (differ <= bound)


class Sets:
    """Full shingle sets of the documents that some candidate pair needs, each made once. A row without an id has none, and of rows with one id the first set does."""

    def __init__(self, docs: DataFrame, k: int, scratch: Scratch):
        self.docs, self.k, self.scratch, self.made = docs, k, scratch, None

    def of(self, ids: DataFrame) -> DataFrame:
        """Sets of the ids and perhaps others."""
        if self.made is not None:
            ids = self.scratch.cut(ids.join(self.made.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "ids")
            if ids.isEmpty():
                return self.made
        new = self.scratch.cut(full_sets(self.docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), self.k), "sets")
        self.made = new if self.made is None else self.made.unionByName(new)
        return self.made


def likely(pairs: DataFrame, sketches: DataFrame, percent: int, bound: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Of pairs(a, b), those that sizes and sketches allow, and their number. A hot `a` is a skewed key of a plain join of written tables, which Spark splits."""
    pairs = scratch.cut(pairs.distinct(), "pairs")
    x = sketches.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("x"))
    y = sketches.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("y"))
    out, n = counted(pairs.join(y, "b").join(x, "a").where(alike(percent, bound)).select("a", "b"), "likely", scratch)
    scratch.drop(pairs)
    return out, n


def counted(df: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """The table written, and its number of rows."""
    seen = Observation()
    out = scratch.cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get.get("n") or 0


def confirmed(pairs: DataFrame, total: int, sets: Sets, percent: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Of pairs(a, b), those with 100 * intersection >= percent * union of the full shingle sets, and their number. The set of `a` is shipped once a block of its pairs, that of `b` once a
    pair; a task holds one block's `a` and streams the others by."""
    if not total:
        return pairs, 0
    full = sets.of(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
    parted, parts = dealt(pairs, "a", total)
    one = parts.join(full.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "shingles")
    many = parted.join(full.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles")
    met = one.unionByName(many).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        key, held = None, None
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            values, ends = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
            keep = []
            for i in range(len(a)):
                s = values[ends[i] : ends[i + 1]].view(np.uint64)
                if b[i] is None:
                    key, held = (a[i], part[i]), s.copy()
                elif key == (a[i], part[i]):
                    both = len(s) + len(held) - len(np.union1d(s, held))
                    if 100 * both >= percent * (len(s) + len(held) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return counted(met.mapInArrow(run, f"a {kind}, b {kind}").distinct(), "confirmed", scratch)


def opened(members: DataFrame, comp: DataFrame | None, scratch: Scratch) -> DataFrame:
    """members(key, id, reach) -> key, id, reach, comp of the buckets that hold several components."""
    m = members.withColumn("comp", F.col("id")) if comp is None else members.join(comp, "id", "left").select("key", "id", "reach", F.coalesce("comp", "id").alias("comp"))
    mixed = m.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
    return scratch.cut(m.join(mixed.select("key"), "key").select("key", "id", "reach", "comp"), "open")


def pivot_pairs(open_: DataFrame, rank: Column) -> DataFrame:
    """(a, b): each member b with the pivot a, of another component, that it shares most buckets with. A bucket's pivot is its member of the lowest rank; ranks are the same in
    all buckets, so a group's buckets choose the same ones."""
    chosen = open_.groupBy("key").agg(F.min(F.struct(rank.alias("h"), F.col("id").alias("p"), F.col("comp").alias("c"))).alias("pivot"))
    pairs = open_.join(chosen, "key").where("comp != pivot.c").groupBy("id", "pivot.p", "pivot.h").agg(F.count(F.lit(1)).alias("times"))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("times")).alias("t"), "h", "p")).alias("best"))
    return best.select(F.col("best.p").alias("a"), F.col("id").alias("b"))


def prefix_pairs(nodes: DataFrame, full: DataFrame, percent: int, scratch: Scratch, hot: int = 1 << 16) -> DataFrame:
    """(a, b) of nodes(id, comp) in different components that share a shingle of both prefixes at places that allow the similarity.

    The order is by the number of nodes that have a shingle, so shingles of one node never make a pair and only count as places. Shingles with more than 1 / `hot` of all
    rows, `hot` of them at most, are joined by broadcast, and so is nothing else. Within a prefix shingle, members outside its largest component meet the others in salted blocks."""
    own = full.join(nodes.select("id"), "id", "left_semi").select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("sh"))
    counts = own.groupBy("sh").agg(F.count(F.lit(1)).alias("n"))
    sums = Observation()
    counts = scratch.cut(counts.observe(sums, F.sum("n").alias("total")).where("n > 1"), "counts")
    total = sums.get.get("total") or 0
    rows = met(own.withColumnRenamed("n", "size"), counts, "sh", total, 1 / hot)
    listed = rows.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sh"))).alias("l"))  # a document's own shingles
    alone = F.col("size") - F.size("l")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    # What of the set stands from this place on bounds the intersection, if this is the first shingle that the two share.
    places = F.transform(F.slice("l", F.lit(1), F.col("first")), lambda x, i: F.struct(x["sh"].alias("sh"), (F.col("size") - alone - i).alias("left")))
    prefix = listed.withColumn("first", first.cast("int")).where("first > 0").select("id", "size", F.explode(places).alias("p"))
    prefix = scratch.cut(prefix.join(nodes, "id").select(F.col("p.sh").alias("sh"), F.col("p.left").alias("left"), "id", "size", "comp"), "prefixes")
    groups = prefix.groupBy("sh", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("sh").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    groups = scratch.cut(groups.where("parts > 1").select("sh", "main", "n"), "groups")
    left = prefix.join(groups, "sh").withColumn("salts", F.ceil(F.col("n") / 256).cast("int"))
    few = left.where("comp != main").select("sh", F.struct("id", "left", "size", "comp").alias("x"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    many = left.select("sh", "main", F.struct("id", "left", "size", "comp").alias("y"), F.pmod(F.hash("id"), "salts").alias("salt"))
    once = (F.col("y.comp") == F.col("main")) | (F.col("x.id") < F.col("y.id"))  # two outsiders meet twice
    fits = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.size") + F.col("y.size"))
    pairs = few.join(many, ["sh", "salt"]).where((F.col("x.comp") != F.col("y.comp")) & once & fits)
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept."""
    bounded(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig = scratch.cut(signatures(docs, k), "signatures")
    bound, sets = sketch_bound(percent / 100), Sets(docs, k, scratch)
    classes = scratch.cut(sig.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    held = sig.where("n_shingles > 0").join(classes, (sig.digest == classes.digest) & (sig.doc_id == classes.rep), "left_semi")
    buckets = held.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.cut(buckets.join(shared, "key"), "members")
    reach = members.groupBy("id").agg((-F.sum("n")).alias("reach"))  # documents near a group's middle share large buckets, and many of them
    members = scratch.cut(members.select("key", "id").join(reach, "id"), "reach")
    sketches = scratch.cut(held.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch").join(members.select("id").distinct(), "id", "left_semi"), "sketches")

    comp = None
    for turn in range(ROUNDS):
        open_ = opened(members, comp, scratch)
        pairs, n = likely(pivot_pairs(open_, F.xxhash64("id", F.lit(turn)) if turn % 2 else F.col("reach")), sketches, percent, bound, scratch)
        comp = extended(comp, *confirmed(pairs, n, sets, percent, scratch), scratch)
        scratch.drop(open_, pairs)

    open_ = opened(members, comp, scratch)
    nodes = scratch.cut(open_.select("id", "comp").distinct(), "nodes")
    scratch.drop(open_, members)
    full = sets.of(nodes.select(F.col("id").alias("doc_id")))
    pairs, n = likely(prefix_pairs(nodes, full, percent, scratch), sketches, percent, bound, scratch)
    comp = extended(comp, *confirmed(pairs, n, sets, percent, scratch), scratch)
    of_class = classes.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("comp"))
    out = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS id, y AS root FROM u UNION SELECT r.id, u.y FROM r JOIN u ON r.root = u.x),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m.root, d.doc_id), d.doc_id) AS component_id, least(coalesce(m.root, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""


def op5_neardup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4)
