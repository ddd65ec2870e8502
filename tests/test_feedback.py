"""Feedback rounds against a loop over posters, resumption, calls in flight."""

import random
import re
import threading
import time

import pytest
from gleanery.operators import feedback, layout, models
from gleanery.sources.stages import Stages
from pyspark.sql import functions as F

PANELS = "doc_id int, panel int, lead string, bullets array<string>, font_scale double"


def fake(panels):
    """Overflows while there is much text; too blank where there is little and the text is not large yet."""
    n = F.length(F.concat_ws(" ", "lead", F.array_join("bullets", " ")))
    said = F.array_compact(F.array(F.when(n > 100, "overflow"), F.when((n < 20) & (F.col("text_scale") < 1.1), "too_blank"), F.when(n % 7 == 3, "visual_too_large"), F.lit("nonsense")))
    return panels.where("panel <> 3").select("doc_id", "panel", said.alias("issues"))


def walk(rows, most):
    bounds = dict(layout.FIXES)
    out = {}
    for doc in {r[0] for r in rows}:
        panels = [[r[1], r[2], list(r[3] or []) if r[3] is not None else None, {v: 1.0 for v in layout.STYLE} | {"font_scale": r[4] or 1.0}] for r in rows if r[0] == doc]
        for _ in range(most):
            changed = False
            for p in panels:
                no, lead, bullets, style = p
                n = len(" ".join(x for x in (lead, " ".join(bullets) if bullets is not None else None) if x is not None))
                issues = [] if no == 3 else [i for i, ok in (("overflow", n > 100), ("too_blank", n < 20 and style["text_scale"] < 1.1), ("visual_too_large", n % 7 == 3)) if ok]
                new = dict(style)
                for i in issues:
                    if i == "overflow":
                        if bullets:
                            p[2] = bullets[:-1]
                        elif lead is not None:
                            m = re.match(r"(?s)(.*?[.!?])\s+", lead.strip())
                            p[1] = m[1] if m else lead.strip()[:150].rstrip() + "..." if len(lead.strip()) > 160 else lead
                    for v, (d, low, high) in bounds[i].items():
                        new[v] = max(min(new[v] + d, high), low)
                new = {v: round(x, 3) for v, x in new.items()}
                changed |= new != style or p[1] != lead or p[2] != bullets
                p[3] = new
            if not changed:
                break
        out |= {(doc, p[0]): (p[1], p[2], *(p[3][v] for v in layout.STYLE)) for p in panels}
    return out


def test_rounds_equal_a_loop(spark, tmp_path):
    rng = random.Random(8)
    lead = lambda: rng.choice([None, "", "Short one.", "One sentence. And another! Third?", "word " * 40, "Long sentence without end " * 9])
    rows = [(d, p, lead(), rng.choice([None, [], ["b"] * rng.randint(1, 4), ["long bullet text " * 3] * rng.randint(1, 5)]), rng.choice([None, 0.95])) for d in range(60) for p in range(1, rng.randint(2, 6))]
    df = spark.createDataFrame(rows, PANELS)
    for most in (1, 3):
        st = Stages(spark, f"file://{tmp_path}/{most}", "x", [f"round_{i}" for i in range(1, 4)])
        got = {(r["doc_id"], r["panel"]): (r["lead"], r["bullets"], *(r[v] for v in layout.STYLE)) for r in feedback.rounds(df, fake, st, most).collect()}
        assert got == walk(rows, most)
    assert feedback.rounds(spark.createDataFrame([], PANELS), fake, Stages(spark, f"file://{tmp_path}/0", "x", ["round_1"]), 1).count() == 0


def test_resumes_behind_the_last_round(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "x " * 80, ["a" * 200] * 4, None)], PANELS)
    st = Stages(spark, f"file://{tmp_path}", "x", ["round_1", "round_2", "round_3"])
    asked = []

    def failing(panels):
        asked.append(panels)
        if len(asked) == 2:
            raise RuntimeError("judge is away")
        return fake(panels)

    with pytest.raises(RuntimeError):
        feedback.rounds(df, failing, st, 3)
    assert st.done("round_1") and not st.done("round_2")
    assert len(feedback.rounds(df, failing, st, 3).first()["bullets"]) == 1 and len(asked) == 4  # rounds 2 and 3 only


def test_model_judge_fails_open(spark):
    df = spark.createDataFrame([(1, 1, "good", [], None), (1, 2, "bad", [], None), (1, 3, "away", [], None)], PANELS)

    def provider():
        def ask(prompt):
            if "away" in prompt:
                raise ValueError("no answer")
            return '{"issues": ["overflow ", "odd"]}' if "bad" in prompt else "talk"

        return ask

    judge = feedback.judge_by(provider, lambda d: F.concat(F.lit("Judge: "), "lead"), wait=0.0)
    assert {r["panel"]: r["issues"] for r in judge(df).collect()} == {1: ["good"], 2: ["overflow"], 3: ["good"]}


def test_calls_in_flight(spark):
    reqs = models.requests(spark.range(40).coalesce(1), F.concat(F.lit("p"), F.col("id").cast("string")), "k", ["id"]).coalesce(1)

    def provider():
        now, most, lock = [0], [0], threading.Lock()

        def ask(prompt):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.1)
            with lock:
                now[0] -= 1
            return f"{most[0]}"

        return ask

    took = {}
    for flight in (1, 8):
        at = time.time()
        got = [int(r["response"]) for r in models.call(reqs, provider, flight=flight).collect()]
        took[flight] = time.time() - at
        assert len(got) == 40 and max(got) <= flight
    assert took[8] < took[1] - 1.5
