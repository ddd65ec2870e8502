"""Query of the feedback rounds: conversations as posters, their turns as panels, and a judge that goes by sizes and ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import feedback
from ..sources.stages import Stages, shared_dir
from . import fixtures as fx
from .queries import W, query

ROUNDS = 3


def panels_fixture(spark, d):
    """A turn's first sentence (its words before the first full stop) is the lead of its panel, what follows its bullets."""
    c = fx.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    parts = F.filter(F.transform(F.split("text", r"\.", -1), lambda p: F.trim(p)), lambda p: p != "")
    return c.select("conv_id", "turn", F.concat(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit(". "), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit(".")).alias("lead"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))).alias("bullets"))


def judge(panels):
    n = T.word_count(F.concat_ws(" ", "lead", F.array_join("bullets", " ")))
    k = F.col("conv_id") + F.col("turn")
    said = F.array_compact(F.array(F.when(n > 60, "overflow"), F.when(n < 12, "too_blank"), F.when((k % 5 == 0) & (F.col("visual_scale") < 1.2), "visual_too_small"), F.when((k % 7 == 0) & (F.col("visual_scale") > 0.85), "visual_too_large")))
    return panels.select("conv_id", "turn", said.alias("issues"))


def _bound(x, change, low, high):
    return f"greatest(least({x} + {change}, {high}), {low})"


def _round(n: int) -> str:
    """SQL of one round: r{n - 1} -> r{n}, whose `live` says that the poster goes on."""
    fs, ts, vs, vf = "fs", "ts", "vs", "vf"
    steps = f"""j{n} AS (SELECT *, len({W("(lead || ' ' || array_to_string(bullets, ' '))")}) AS n FROM r{n - 1}),
i{n} AS (SELECT *, live AND n > 60 AS o, live AND n < 12 AS b, live AND (conv_id + turn) % 5 = 0 AND vs < 1.2 AS s, live AND (conv_id + turn) % 7 = 0 AND vs > 0.85 AS l FROM j{n}),
a{n} AS (SELECT *, CASE WHEN o AND len(bullets) = 0 THEN CASE WHEN regexp_extract(trim(lead), '(?s)^(.*?[.!?])\\s+', 1) <> '' THEN regexp_extract(trim(lead), '(?s)^(.*?[.!?])\\s+', 1)
      WHEN length(trim(lead)) > 160 THEN rtrim(substr(trim(lead), 1, 150)) || '...' ELSE lead END ELSE lead END AS lead2, CASE WHEN o AND len(bullets) > 0 THEN bullets[1:-2] ELSE bullets END AS bullets2,
    CASE WHEN o THEN {_bound(fs, -0.05, 0.90, 1.00)} ELSE fs END AS f1 FROM i{n}),
b{n} AS (SELECT *, CASE WHEN b THEN {_bound('f1', 0.03, 0.90, 1.10)} ELSE f1 END AS f2, CASE WHEN b THEN {_bound(ts, 0.06, 0.85, 1.15)} ELSE ts END AS t1, CASE WHEN b THEN {_bound(vs, 0.08, 0.85, 1.35)} ELSE vs END AS v1, CASE WHEN b THEN {_bound(vf, 0.08, 0.85, 1.35)} ELSE vf END AS x1 FROM a{n}),
c{n} AS (SELECT *, CASE WHEN s THEN {_bound('t1', -0.04, 0.80, 1.05)} ELSE t1 END AS t2, CASE WHEN s THEN {_bound('v1', 0.15, 0.90, 1.40)} ELSE v1 END AS v2, CASE WHEN s THEN {_bound('x1', 0.15, 0.85, 1.40)} ELSE x1 END AS x2 FROM b{n}),
d{n} AS (SELECT *, round(f2, 3) AS f3, round(CASE WHEN l THEN {_bound('t2', 0.05, 0.80, 1.20)} ELSE t2 END, 3) AS t3, round(CASE WHEN l THEN {_bound('v2', -0.10, 0.75, 1.20)} ELSE v2 END, 3) AS v3, round(CASE WHEN l THEN {_bound('x2', -0.10, 0.75, 1.20)} ELSE x2 END, 3) AS x3 FROM c{n}),
r{n} AS (SELECT conv_id, turn, lead2 AS lead, bullets2 AS bullets, f3 AS fs, t3 AS ts, v3 AS vs, x3 AS vf,
  live AND max(CAST(lead2 <> lead OR bullets2 <> bullets OR f3 <> fs OR t3 <> ts OR v3 <> vs OR x3 <> vf AS INTEGER)) OVER (PARTITION BY conv_id) = 1 AS live FROM d{n})"""
    return steps


@query(f"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(min(text), '.'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM conversations GROUP BY conv_id, turn),
r0 AS (SELECT conv_id, turn, coalesce(ps[1], '') || '. ' || coalesce(ps[2], '') || '.' AS lead, ps[3:] AS bullets, 1.0::DOUBLE AS fs, 1.0::DOUBLE AS ts, 1.0::DOUBLE AS vs, 1.0::DOUBLE AS vf, true AS live FROM p),
{", ".join(_round(n) for n in range(1, ROUNDS + 1))}
SELECT conv_id, turn, md5(lead) AS lead_digest, CAST(len(bullets) AS INTEGER) AS bullets, fs AS font_scale, ts AS text_scale, vs AS visual_scale, vf AS visual_flex FROM r{ROUNDS}""")
def feedback_rounds(spark, d):
    """Three rounds at most; the stage tables of a run of this query are its own."""
    names = [f"round_{n}" for n in range(1, ROUNDS + 1)]
    stages = Stages(spark, f"{shared_dir(spark)}/feedback", uuid.uuid4().hex, names)
    out = feedback.rounds(panels_fixture(spark, d), judge, stages, ROUNDS, "conv_id", "turn")
    return out.select("conv_id", "turn", F.md5("lead").alias("lead_digest"), F.size("bullets").alias("bullets"), "font_scale", "text_scale", "visual_scale", "visual_flex")
