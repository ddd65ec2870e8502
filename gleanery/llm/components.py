"""Connected components over a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b), a != b, no nulls -> (id, comp): every linked id with the smallest id reachable from it. Isolated ids do not appear.

    Each step is an aggregation by node with a partial sum on the map side and one join of two written tables, whose hot nodes Spark splits (it can't where a
    join's side is an aggregate), so a node with a third of all links is no single task. The tables of a step are written to the shared folder; the loop ends when a
    step leaves the links as they were (count and sum of hashes, observed while writing)."""
    e, was = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links"), None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = scratch.cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large")
        least = scratch.cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        seen = Observation()
        new = scratch.cut(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        scratch.drop(e, low, large, least)
        e, now = new, seen.get
        if now == was or not now.get("n"):
            break
        was = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def extended(comp: DataFrame | None, links: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Components (id, comp) after `n` further links: only links between components are worked on, each component as one node."""
    if comp is not None and not n:
        return comp
    if comp is None:
        return scratch.cut(components(links, scratch), "components")
    of = lambda c: comp.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = scratch.cut(components(between, scratch), "merged")
    kept = comp.join(merged.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return scratch.cut(kept.unionByName(merged.join(comp, "id", "left_anti")), "components")
