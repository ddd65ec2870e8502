"""Quiz forms, payloads, shuffles; images as values."""

import json

from gleanery.functions import media
from gleanery.operators import quiz
from pyspark.sql import functions as F


def test_quiz(spark):
    keyed = {"detail": {"questions": {"Question 10": {"question": "j", "options": ["A. x"]}, "Question 2": {"question": "b", "choices": ["A. y"], "aspect": "C"}}, "answers": {"Question 2": "A. y"}, "aspects": {"Question 10": "D"}}}
    listed = {"verbatim": {"questions": [{"question": "q", "options": ["A. 1", "B. 2", "C. 3", "D. 4"], "answer": "B. 2"}], "answers": []}, "interpretive": {"Question 1": {"question": "i", "options": ["A. z"], "answer": "A"}}}
    d = spark.createDataFrame([("k", json.dumps(keyed)), ("l", json.dumps(listed)), ("n", "{}"), ("x", None)], "doc_id string, text string")
    items = quiz.load(d)
    got = [(r["doc_id"], r["qid"], r["question"], r["answer"], r["aspect"], r["qtype"]) for r in items.orderBy("doc_id", "pos").collect()]
    assert got == [("k", "Question 2", "b", "A. y", "C", "verbatim"), ("k", "Question 10", "j", "", "D", "verbatim"), ("l", "Question 1", "q", "B. 2", None, "verbatim"), ("l", "Question 1", "i", "A", None, "interpretive")]
    p = {r["doc_id"]: json.loads(r["payload"]) for r in quiz.payload(items).collect()}
    assert list(p["l"]) == ["Question 1", "Question 2"] and "answer" not in p["l"]["Question 1"]
    s = [r for r in quiz.shuffled(items).collect() if r["question"] == "q"][0]
    assert s["options"][ord(s["answer"]) - 65].endswith(". 2") and sorted(o[3:] for o in s["options"]) == ["1", "2", "3", "4"]


def test_images(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert bytes(one(media.from_data_uri(F.lit("data:image/png;base64,AAEC")))) == b"\0\1\2" and one(media.from_data_uri(F.lit("http://x"))) is None
    assert one(media.to_data_uri(F.lit(b"\0\1\2"), F.lit("image/png"))) == "data:image/png;base64,AAEC"
    assert bytes(one(media.image_of_response(F.lit('{"data":[{"b64_json":"AAEC"}]}')))) == b"\0\1\2"
    assert one(media.large_enough(F.lit(300), F.lit(100))) is False and one(media.large_enough(F.lit(None).cast("int"), F.lit(1))) is True
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(media.distinct_frames(arr(0, 1, 2**40 - 1, 2**40 - 2))) == [0, 2] and one(media.even_sample(arr(*range(24)), 4)) == [0, 6, 12, 18]
    im = spark.createDataFrame([(1, 1, 280, 280, 10), (1, 2, 28, 28, 10), (1, 3, 2800, 2800, 10), (1, 4, 28, 28, 10)], "g int, ord int, width int, height int, bytes int")
    assert [r["ord"] for r in quiz.image_prefix(im, "g", most_tokens=200).orderBy("ord").collect()] == [1, 2]
