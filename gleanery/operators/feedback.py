"""Feedback rounds: panels are judged, their faults mended, and judged again, until a poster's panels stay as they are or the rounds are used up.

Each round is a stage table, so a run that failed goes on behind the last whole round; only posters that changed enter the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stages import Stages
from . import answers, layout, models

# Characters of a lead of one sentence beyond which it is cut, and to how many.
LONG_LEAD, CUT_LEAD = 160, 150


def shorter_lead(lead: Column) -> Column:
    """The first sentence; of one long sentence, its beginning."""
    t = T.strip(F.coalesce(lead, F.lit("")))
    first = F.regexp_extract(t, r"(?s)^(.*?[.!?])\s+", 1)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, CUT_LEAD), r"\s+$", ""), F.lit("..."))
    return F.when(first != "", first).when(F.length(t) > LONG_LEAD, cut).otherwise(lead)


def mended(panels: DataFrame, issues: str = "issues") -> DataFrame:
    """panels(lead, bullets, style variables, issues) after the fixes: one that overflows loses its last bullet, or the end of its lead if it has none, and its font shrinks; the style
    variables follow the other issues."""
    over = F.array_contains(layout.clean_issues(F.col(issues)), "overflow")
    bullets, has = F.coalesce("bullets", F.array().cast("array<string>")), F.size(F.coalesce("bullets", F.array().cast("array<string>"))) > 0
    lead = F.when(over & ~has, shorter_lead(F.col("lead"))).otherwise(F.col("lead"))
    fewer = F.when(over & has, F.slice(bullets, F.lit(1), F.size(bullets) - 1)).otherwise(F.col("bullets"))
    return layout.apply_fixes(panels.withColumns({"lead": lead, "bullets": fewer}), issues)


def one_round(panels: DataFrame, judge: Callable[[DataFrame], DataFrame], poster: str, panel: str) -> DataFrame:
    """panels after one judgement, with `changed`: whether any panel of the poster did. A panel without a judgement is good."""
    cols = panels.columns
    before = F.struct("lead", "bullets", *layout.STYLE)
    judged = judge(panels).groupBy(poster, panel).agg(F.first("issues").alias("issues"))
    j = panels.withColumn("_before", before).join(judged, [poster, panel], "left").withColumn("issues", F.coalesce("issues", F.array(F.lit("good"))))
    done = mended(j).withColumn("_same", F.col("_before").eqNullSafe(before))
    return done.withColumn("changed", F.max((~F.col("_same")).cast("int")).over(Window.partitionBy(poster)) == 1).select(*cols, "changed")


def rounds(panels: DataFrame, judge: Callable[[DataFrame], DataFrame], stages: Stages, most: int = 2, poster: str = "doc_id", panel: str = "panel") -> DataFrame:
    """panels(poster, panel, lead, bullets, and style variables, 1 where absent) after at most `most` rounds. `judge` gives (poster, panel, issues) for the panels it is handed; `stages`
    names round_1, round_2, ... and keeps their tables."""
    have = [v for v in layout.STYLE if v in panels.columns]
    active = panels.withColumns({v: F.coalesce(F.col(v), F.lit(1.0)) if v in have else F.lit(1.0) for v in layout.STYLE})
    out = None
    for n in range(1, most + 1):
        state = stages.run(f"round_{n}", lambda a=active: one_round(a, judge, poster, panel))
        still, active = state.where(~F.col("changed")).drop("changed"), state.where("changed").drop("changed")
        out = still if out is None else out.unionByName(still)
        if active.isEmpty():
            break
    return out.unionByName(active) if out is not None else active


def judge_by(provider, prompt: Callable[[DataFrame], Column], poster: str = "doc_id", panel: str = "panel", **options) -> Callable[[DataFrame], DataFrame]:
    """A judge that asks a model through the request table; a call that fails, or an answer without known issues, is good."""
    def judge(panels: DataFrame) -> DataFrame:
        asked = models.requests(panels, prompt(panels), "judge", [poster, panel])
        said = models.call(asked, provider, **options)
        each = asked.select("request_id", F.explode("asked_by").alias("k")).join(said, "request_id", "left").select("k.*", "response")
        v = answers.variant_of(each)
        return v.select(poster, panel, layout.clean_issues(F.transform(answers.strings(F.col("answer"), "$.issues"), lambda s: F.trim(s))).alias("issues"))

    return judge
