"""Repair of JSON that a model has cut off or quoted badly: a character automaton, as a scalar pandas UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def closed(text: str) -> str:
    """Text with open strings, arrays and objects closed, and commas before a close dropped."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted, escaped = True, False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack and stack[-1] == c:
            stack.pop()
    text += '"' if quoted else ""
    return re.sub(r",\s*(?=[}\]])", "", re.sub(r"[,:\s]+$", "", text) + "".join(reversed(stack)))


def repaired(text: str | None) -> str | None:
    """The first form that parses: as it is, without a fence, from the first to the last brace, closed, closed after the last whole member; null if none does."""
    if not text:
        return None
    bare = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", text.strip())
    start = bare.find("{")
    if start < 0:
        return None
    tries = [bare, bare[start : bare.rfind("}") + 1], closed(bare[start:])]
    cut = bare
    for _ in range(20):
        at = max(cut.rfind(","), cut.rfind("}"), cut.rfind("]"))
        if at <= start:
            break
        cut = cut[:at]
        tries.append(closed(cut[start:]))
    for t in tries:
        try:
            return json.dumps(json.loads(t), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)
