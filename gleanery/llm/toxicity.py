"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if a term of bucket i occurs. The pairwise part learns that two terms matter
together, such as an insult and the mention of a group, which additive weights miss.

Fitting: labels of the fitting folds (crc32 of the id as text, modulo 4, not 2), at most `sample` rows of them chosen by a hash of the id (`sample` bounds
what reaches the driver: ids and hashed terms, no texts). Terms are hashed into 2^20 buckets; the `features` buckets that tell the classes apart best, with
a least number of documents each, enter the machine, and of the `frequent` that most documents have those that tell in pairs. A quarter of the sample is kept back to stop the descent, and to calibrate scores as probabilities.
Scoring reads whole texts on the executors; the model that goes to them has `features` x (1 + factors) numbers.

Defined cases: null or empty text scores as a text without any known term; labels null, or ids null, are not used for fitting; without labels of both
classes every score is the share of toxic labels (0 without labels); repeated rows score alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, read_table

BUCKETS = 1 << 20
TERMS = re.compile(r"\w+")
THRESHOLD = 0.3


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Buckets(dict):
    """Term -> bucket (or the place of its bucket in the model, or -1), forgotten when it has grown large."""

    def __init__(self, place=None):
        super().__init__()
        self.place = place

    def __missing__(self, term: str) -> int:
        if len(self) > 100_000:
            self.clear()
        b = bucket(term)
        b = self[term] = b if self.place is None else self.place.get(b, -1)
        return b


def terms(text: str | None) -> set[str]:
    return set(TERMS.findall(text.lower())) if text else set()


def hashed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, toxic, fold) -> doc_id, toxic, fold, buckets."""

    def run(batches):
        table = Buckets()
        for batch in batches:
            out = [sorted({table[t] for t in terms(x.as_py())}) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "toxic", "fold", "buckets"])

    return docs.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.col("fold").cast("int").alias("fold")).mapInArrow(run, "doc_id bigint, toxic int, fold int, buckets array<int>")


class Machine:
    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.buckets, self.bias, self.w, self.v, self.slope, self.shift = buckets, bias, w, v, slope, shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Margins of rows of zeros and ones."""
        w, v = self.w.astype(np.float32), self.v.astype(np.float32)
        s = x @ v
        return (self.bias + x @ w + 0.5 * (s * s - x @ (v * v)).sum(axis=1)).astype(np.float64)

    def score_places(self, places: list[int]) -> float:
        s, v = self.v[places].sum(axis=0), self.v[places]
        z = self.bias + self.w[places].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, features: int = 512, frequent: int = 1024, factors: int = 6, least: int = 4, steps: int = 250, seed: int = 7) -> Machine:
    """rows: each document's distinct buckets; held: rows kept back from the descent for stopping and calibration."""
    y = y.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0) or y[~held].min(initial=1) == y[~held].max(initial=0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(np.empty(0, np.int64), float(np.log(p / (1 - p))) if len(y) else -40.0, np.empty(0), np.empty((0, factors)))
    fit_y = y[~held]
    n1, n0 = fit_y.sum(), len(fit_y) - fit_y.sum()
    c1, c0 = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for r, label, h in zip(rows, y, held, strict=True):
        if not h:
            (c1 if label else c0)[r] += 1
    tell = np.sqrt(n1 * n0 / (n1 + n0)) * np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum((c1 + c0) / (n1 + n0) * (1 - (c1 + c0) / (n1 + n0)), 1e-9))
    # Terms that tell the classes apart by themselves, by three standard errors, and those of pairs that tell them apart though neither does.
    alone = np.where(c1 + c0 < least, 0, tell)
    single = np.argsort(-np.where(alone < 3, 0, alone), kind="stable")[:features]
    often = np.where((c1 + c0 < least) | (c1 + c0 > 0.9 * len(fit_y)), 0, c1 + c0)
    common = np.argsort(-often, kind="stable")[:frequent]
    best = np.union1d(single[alone[single] >= 3], telling_pairs(rows, y, held, common[often[common] > 0], alone))
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))

    def table(chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(chosen), len(best)), np.float32)
        for i, k in enumerate(chosen):
            at = place[rows[k]]
            x[i, at[at >= 0]] = 1
        return x

    xa, xh, ya, yh = table(np.flatnonzero(~held)), table(np.flatnonzero(held)), fit_y, y[held]
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(best)), rng.normal(0, 0.02, (len(best), factors)), float(np.log(n1 / n0))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v, np.zeros(1))]
    m = Machine(best, bias, w, v)
    kept, low, wait = None, np.inf, 0
    for step in range(1, steps + 1):
        w, v = m.w.astype(np.float32), m.v.astype(np.float32)  # in the table's own precision, so that no product copies it
        s = xa @ v
        z = m.bias + xa @ w + 0.5 * (s * s - xa @ (v * v)).sum(axis=1)
        g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - ya) / len(ya)).astype(np.float32)
        col = xa.T @ g
        grads = (col + 2e-4 * m.w, xa.T @ (g[:, None] * s) - col[:, None] * m.v + 2e-3 * m.v, np.array([g.sum()]))
        out = []
        for (a, b), grad, p in zip(moments, grads, (m.w, m.v, np.array([m.bias])), strict=True):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.999
            b += 0.001 * grad * grad
            out.append(p - 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        m = Machine(best, float(out[2][0]), out[0], out[1])
        if step % 10 == 0 and len(yh):
            zh = m.margin(xh)
            loss = float(np.mean(np.logaddexp(0, zh) - yh * zh))
            kept, low, wait = (m, loss, 0) if loss < low - 1e-5 else (kept, low, wait + 1)
            if wait >= 4:
                break
    m = kept or m
    if len(yh) and 0 < yh.mean() < 1:
        m.slope, m.shift = platt(m.margin(xh), yh)
    return m


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, of: np.ndarray, alone: np.ndarray, errors: float = 6.0) -> np.ndarray:
    """Buckets among `of` that occur in a pair whose joint occurrence tells the classes apart by `errors` standard errors (beyond what chance gives among all pairs), and by half
    as much again as either does alone."""
    place = np.full(BUCKETS, -1, np.int32)
    place[of] = np.arange(len(of))
    n, met = np.zeros(2), np.zeros((2, len(of), len(of)), np.float32)
    for label in (0, 1):
        chosen = [r for r, t, h in zip(rows, y, held, strict=True) if not h and int(t) == label]
        n[label] = len(chosen)
        for at in range(0, len(chosen), 2048):
            x = np.zeros((min(2048, len(chosen) - at), len(of)), np.float32)
            for i, r in enumerate(chosen[at : at + 2048]):
                p = place[r]
                x[i, p[p >= 0]] = 1
            met[label] += x.T @ x
    share = met.sum(axis=0) / n.sum()
    tell = np.sqrt(n[0] * n[1] / n.sum()) * np.abs(met[1] / n[1] - met[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tell[(met.sum(axis=0) < 4) | (tell < errors) | (tell < 1.5 * np.maximum(alone[of][:, None], alone[of][None, :]))] = 0
    np.fill_diagonal(tell, 0)
    return of[tell.max(axis=1, initial=0) > 0]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by which margins become probabilities: smoothed targets, a weak pull to slope 1 and shift 0, Newton steps halved until the loss falls."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * z + b) - t * (a * z + b)) + (a - 1) ** 2 + 0.05 * b * b)
    a, b, now = 1.0, 0.0, loss(1.0, 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum() + 2 * (a - 1), (p - t).sum() + 0.1 * b])
        h = np.array([[(q * z * z).sum() + 2, (q * z).sum()], [(q * z).sum(), q.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and loss(a - step[0], b - step[1]) > now:
            step = step / 2
        a, b = float(a - step[0]), float(b - step[1])
        now, was = loss(a, b), now
        if was - now < 1e-9:
            break
    return (a, b) if a > 0.05 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", **how) -> Machine:
    """Fit on at most `sample` labelled documents of the fitting folds."""
    chosen = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
              .where(crc_mod("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = hashed(d.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)))).toArrow()
    ids, y, fold = (rows.column(c).to_numpy() for c in ("doc_id", "toxic", "fold"))
    buckets = [x for chunk in rows.column("buckets").chunks if len(chunk) for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])] if len(y) else []
    order = np.lexsort(([int(x.sum()) for x in buckets], [len(x) for x in buckets], ids))  # the order in which tasks end must not matter
    model = fit([buckets[i] for i in order], y[order].astype(np.int64), fold[order] == 0, **how)
    del rows, buckets
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with two further columns, `names`, made where the text is; columns of those names are replaced."""
    rest = docs.drop(*names) if set(names) & set(docs.columns) else docs
    schema = StructType([*rest.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])
    place = {int(b): i for i, b in enumerate(model.buckets)}

    def run(batches):
        table = Buckets(place)
        for batch in batches:
            out = []
            for x in batch.column(text_col):
                at = {table[t] for t in terms(x.as_py())}
                at.discard(-1)
                out.append(model.score_places(sorted(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())], names=[*batch.schema.names, *names])

    return rest.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
