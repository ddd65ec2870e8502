"""Expressions over arrays: values bound once, running sums and maxima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running fold. A fold's state is copied at every step, so one growing array over n elements would cost n * n; in blocks it costs n * BLOCK, and
#: the blocks' own fold (n / BLOCK) squared.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: within functions over arrays an expression is computed anew wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, BLOCK))


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op folded over every prefix of an array of int; op is associative and xs holds no nulls."""
    empty = F.array().cast("array<int>")
    add = lambda s, x: F.concat(s, F.array(F.coalesce(op(F.try_element_at(s, F.lit(-1)), x), x)))
    fold = lambda a: F.aggregate(a, empty, add)

    def of(a: Column) -> Column:
        return let(F.transform(cut(a), fold), joined)

    def joined(blocks: Column) -> Column:
        totals = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        place = lambda ts: F.transform(blocks, lambda b, k: let(F.get(ts, k - 1), lambda before: F.transform(b, lambda v: F.coalesce(op(before, v), v))))
        return F.flatten(let(totals, place))

    return F.when(F.size(xs) > 0, let(xs, of)).otherwise(empty)


def sums(xs: Column) -> Column:
    return running(xs, lambda a, b: a + b)


def maxima(xs: Column) -> Column:
    """Running maxima (of int)."""
    return running(xs, lambda a, b: F.when(a >= b, a).when(a < b, b))


def scan(xs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states (int) after each element of an array, for steps in which the order of elements counts: a fold over blocks of folds within them."""
    empty = F.array().cast("array<int>")
    inner = lambda last, b: F.aggregate(b, F.struct(last.alias("last"), empty.alias("out")), lambda s, x: let(step(s["last"], x), lambda v: F.struct(v.alias("last"), F.concat(s["out"], F.array(v)).alias("out"))))
    outer = lambda s, b: let(inner(s["last"], b), lambda r: F.struct(r["last"].alias("last"), F.concat(s["out"], F.array(r["out"])).alias("out")))
    zero = F.struct(start.cast("int").alias("last"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(F.size(xs) > 0, let(xs, lambda a: F.aggregate(cut(a), zero, outer, lambda s: F.flatten(s["out"])))).otherwise(empty)
