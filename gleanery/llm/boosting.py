"""Gradient-boosted trees on small tables: fitted on the driver from a bounded fixture, scored as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, least: int, ridge: float):
    """A tree as nested tuples (feature, cut, left if <= cut, right), leaves as numbers: second-order gains over the cuts, from sums by bin."""
    gs, hs, n = g[rows].sum(), h[rows].sum(), len(rows)
    if depth == 0 or n < 2 * least:
        return float(-gs / (hs + ridge))
    best = None
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        b = bins[rows, j]
        gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(at) + 1))[:-1] for w in (g[rows], h[rows], np.ones(n)))
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(nl < least) | (n - nl < least)] = -1
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0] + 1e-12:
            best = (float(gain[k]), j, k)
    if best is None or best[0] < 1e-6:
        return float(-gs / (hs + ridge))
    _, j, k = best
    low = bins[rows, j] <= k
    return (j, float(cuts[j][k]), grow(x, g, h, bins, cuts, rows[low], depth - 1, least, ridge), grow(x, g, h, bins, cuts, rows[~low], depth - 1, least, ridge))


def walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, c, a, b = tree
    return np.where(x[:, j] <= c, walk(a, x), walk(b, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 4, ridge: float = 1.0, bins: int = 32):
    """(bias, trees) for logistic loss."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    cuts = []
    for j in range(x.shape[1]):
        u = np.unique(x[:, j])
        mids = (u[1:] + u[:-1]) / 2
        cuts.append(mids if len(mids) <= bins else np.unique(np.quantile(mids, np.linspace(0, 1, bins))))
    binned = np.stack([np.searchsorted(c, x[:, j], side='left') for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(y), 0), int)
    z, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        tree = grow(x, q - y, q * (1 - q), binned, cuts, np.arange(len(y)), depth, least, ridge)
        trees.append(tree)
        z = z + rate * walk(tree, x)
    return bias, [scale(t, rate) for t in trees]


def scale(tree, by: float):
    return (tree[0], tree[1], scale(tree[2], by), scale(tree[3], by)) if isinstance(tree, tuple) else tree * by


def margin(bias: float, trees, x: np.ndarray) -> np.ndarray:
    return bias + sum((walk(t, x) for t in trees), np.zeros(len(x)))


def expression(bias: float, trees, feature) -> Column:
    """The margin as a column expression; feature(j) gives the column of feature j."""

    def of(tree):
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(feature(tree[0]) <= F.lit(tree[1]), of(tree[2])).otherwise(of(tree[3]))

    out = F.lit(float(bias))
    for t in trees:
        out = out + of(t)
    return out
