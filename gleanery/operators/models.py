"""The seam to model calls: a request table, calls partition by partition, a response table. No model is called offline."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor
from concurrent.futures import wait as wait_for

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonrepair import repair_json


def requests(df: DataFrame, prompt: Column, kind: str, keys: list[str]) -> DataFrame:
    """A row a distinct prompt: request_id (a hash of kind and prompt, by which responses can be kept), kind, prompt, and the keys that asked for it."""
    q = df.select(*keys, F.lit(kind).alias("kind"), prompt.alias("prompt")).withColumn("request_id", F.sha2(F.concat_ws("\u0001", "kind", "prompt"), 256))
    return q.groupBy("request_id", "kind", "prompt").agg(F.collect_set(F.struct(*keys)).alias("asked_by"))


def call(reqs: DataFrame, provider: Callable[[], Callable[[str], str]], attempts: int = 3, wait: float = 1.0, known: DataFrame | None = None, flight: int = 8) -> DataFrame:
    """request_id, response, error. `provider()` makes a client once a partition; connection errors and timeouts are tried again with growing waits; known responses
    are not asked for again. A partition keeps at most `flight` calls under way: a new prompt is read when one of them is answered, and answers go on as they come. Clients
    must bear calls from several threads (or set flight to 1)."""
    todo = reqs.join(known.select("request_id"), "request_id", "left_anti") if known is not None else reqs

    def run(batches):
        ask = provider()

        def answer(rid: str, prompt: str) -> tuple[str, str | None, str | None]:
            for n in range(attempts):
                try:
                    return rid, ask(prompt), None
                except (ConnectionError, TimeoutError) as e:
                    if n + 1 == attempts:
                        return rid, None, str(e)
                    time.sleep(wait * 2**n)
                except Exception as e:  # noqa: BLE001  one prompt that fails must not lose the others
                    return rid, None, str(e)
            return rid, None, "not tried"

        frame = lambda done: pd.DataFrame([f.result() for f in done], columns=["request_id", "response", "error"])
        with ThreadPoolExecutor(max_workers=flight) as pool:
            under_way: set[Future] = set()
            for b in batches:
                for rid, prompt in zip(b["request_id"], b["prompt"], strict=True):
                    if len(under_way) >= flight:
                        done, under_way = wait_for(under_way, return_when=FIRST_COMPLETED)
                        yield frame(done)
                    under_way.add(pool.submit(answer, rid, prompt))
            if under_way:
                yield frame(wait_for(under_way).done)

    new = todo.select("request_id", "prompt").mapInPandas(run, "request_id string, response string, error string")
    return new if known is None else known.select("request_id", "response", "error").unionByName(new)


def parsed(reqs: DataFrame, responses: DataFrame, schema: str, default: Column | None = None) -> DataFrame:
    """The askers with their parsed response; what no repair can parse gives the default."""
    r = reqs.select("request_id", F.explode("asked_by").alias("k")).join(responses, "request_id", "left")
    value = F.from_json(repair_json("response"), schema)
    return r.select("k.*", "request_id", (F.coalesce(value, default) if default is not None else value).alias("value"), "error")
