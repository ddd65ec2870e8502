"""Running folds over arrays, and the chunker on long marked texts."""

import random
from itertools import accumulate

from gleanery.functions import arrays as A
from gleanery.operators import chunks
from pyspark.sql import functions as F
from test_analysis import brute_paragraphs


def test_running_and_scan(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 99) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 255, 256, 257, 512, 1000, 70000])]
    d = spark.createDataFrame(rows, "i int, xs array<int>")
    got = d.select("i", A.sums(F.col("xs")).alias("s"), A.maxima(F.col("xs")).alias("m"), A.scan(F.col("xs"), F.lit(3), lambda s, x: (s * 3 + x) % 1000).alias("z")).orderBy("i").collect()
    for (_, xs), r in zip(rows, got, strict=True):
        state, states = 3, []
        for x in xs:
            n = state * 3 + x
            state = n - 1000 * int(n / 1000)  # % keeps the sign of the dividend
            states.append(state)
        assert (r["s"], r["m"], r["z"]) == (list(accumulate(xs)), list(accumulate(xs, max)), states)


def test_long_marked_text(spark):
    rng = random.Random(4)
    text = "\n\n".join(rng.choice(["$$ a", "b $$", "words and more words here " * rng.randint(1, 9), "```", " code ", "\\begin{align}", "x \\end{align}"]) for _ in range(9000))
    got = spark.createDataFrame([(text,)], "t string").select(chunks.paragraphs(F.col("t")).alias("p"), chunks.pack(F.col("t")).alias("c")).first()
    want = brute_paragraphs(text)
    assert got["p"] == want
    packed, have = [], None
    for p in want:
        n = len(p.split())
        if n > 800:
            packed.append(None)
            packed.append(None)
            have = None
        elif have is None or have + n > 800:
            packed.append(p)
            have = n
        else:
            packed[-1] += "\n\n" + p
            have += n
    assert len(got["c"]) == len(packed) and all(w is None or w == g for w, g in zip(packed, got["c"], strict=True))
