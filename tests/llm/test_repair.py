"""Conversation repair: cheapest edits by exhaustive search, the whole query by a row-wise walk, edge cases."""

import hashlib
import random
import re
import time
import zlib
from heapq import heappop, heappush

import pytest
from gleanery.llm import repair as R

ROWS = "conv_id bigint, turn bigint, role string, text string, audit string, rows int"
FULL = re.compile(r"(s?(ua)+)?")


def cheapest(code):
    """Least (cost, audit, roles) over all strings of edits: uniform-cost search over (rows read, roles written), which need no grammar but the final test."""
    best = 4 * len(code)
    heap, found = [(0, "", 0, "")], []
    while heap:
        cost, audit, at, roles = heappop(heap)
        if cost > best:
            break
        if at == len(code) and FULL.fullmatch(roles):
            best = cost
            found.append((cost, audit, roles))
        if not re.fullmatch(r"s?(ua)*u?", roles):
            continue  # no sound conversation begins so
        for t in "ua":
            if cost + 3 <= best:
                heappush(heap, (cost + 3, audit + "I", at, roles + t))
        if at < len(code):
            role, state = code[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if state != R.MUST_GO:
                late = 3 if state == R.TRUNCATED else 0
                heappush(heap, (cost + late, audit + "K", at + 1, roles + (role or "?")))
                for t in "ua":
                    heappush(heap, (cost + 3 + late, audit + "R", at + 1, roles + t))
    return min(found)


def parsed(code):
    cost, edits = R.parse(code, R.Grammar())
    return cost, "".join(x for x, _ in edits), "".join(t for x, t in edits if x != "D")


def test_parse_is_cheapest_and_least():
    rng = random.Random(5)
    cases = [[("u", 0)], [("a", 0)], [("s", 0)], [("s", 0), ("s", 0)], [("u", 1)], [("u", 2), ("a", 2)], [("", 0)], [("u", 0), ("u", 0), ("u", 0)], [("a", 0), ("u", 0)]]
    cases += [[(rng.choice("uuaas" if rng.random() < 0.9 else [""]), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 6))] for _ in range(400)]
    for code in cases:
        assert parsed(code) == cheapest(code), code
    assert parsed([]) == (0, "", "")


def test_long_conversation_is_linear():
    rng = random.Random(6)
    took = []
    for n in (2000, 20000):
        code = [(rng.choice("uas"), rng.choice([0, 0, 1, 2])) for _ in range(n)]
        at = time.time()
        cost, audit, roles = parsed(code)
        took.append(time.time() - at)
        assert FULL.fullmatch(roles) and sum(x != "I" for x in audit) == n and cost > 0
    assert took[1] < 40 * took[0]


def test_grammars_are_checked():
    with pytest.raises(ValueError):
        R.Grammar(rules=(("S", "aSu"),))
    with pytest.raises(ValueError):
        R.parse([("u", 0)], R.Grammar(rules=(("S", "x"),)))
    assert R.parse([("u", 0), ("a", 0)], R.Grammar(rules=(("S", "a"), ("S", "")), rerole=9)) == (4, [("D", ""), ("K", "a")])


def brute(rows):
    """The query's rows from (conv_id, turn, role, text), by the definitions."""
    convs = {}
    sp = lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        k = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs.setdefault(c, []).extend([(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1))
    out = {}
    for c, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, code = [], set(), []
        for _, role, text in rs:
            body = text.strip(" \t\n\x0b\x0c\r")
            f = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(f)
            code.append((role[:1] if role[:1] in ("s", "u", "a") else "", {"": 0, "truncated": 2}.get(f, 1)))
        cost, audit, roles = cheapest(code) if rs else (0, "", "")
        said, at, to = [], 0, iter(roles)
        for x in audit:
            if x == "I":
                said.append({"u": "user:", "a": "assistant:"}[next(to)])
                continue
            if x == "K":
                next(to)
                said.append(f"{rs[at][1]}:{rs[at][2]}")
            elif x == "R":
                said.append({"u": "user:", "a": "assistant:"}[next(to)] + rs[at][2])
            at += 1
        turns = {r[0] for r in rs} - {None}
        ini = [r[1][:1] for r in rs]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])),
                  cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.op12_conversation_repair(spark, sf_dir).collect()}
    assert got == brute(rows) and any(v[5] > 0 for v in got.values())


def test_edges(spark, tmp_path):
    rows = [(1, None, "user", "First."), (1, None, None, None), (1, 5, "assistant", "So.\r\n "), (1, 2, "tool", "x\x1c"), (1, 2, "", "Empty role!"), (None, 1, "user", "No id?"), (None, 3, "assistant", "Fine"), (2, 1, "user", ""),
            (3, 7, "assistant", "Same."), (3, 7, "assistant", "Same."), (3, 9, "system", "Late."), *[(4, t, "user", f"Turn {t}.") for t in range(6)], *[(c, 0, "user", "Gone?") for c in range(50, 120)], (5, -3, "user", "long " * 100000 + ".")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).write.parquet(f"{tmp_path}/t/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in R.op12_conversation_repair(spark, f"{tmp_path}/t").collect()}
    want = brute(rows)
    assert got == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()  # a conversation whose only row is dropped
    assert R.repair(R.gather(spark.createDataFrame([], ROWS))).count() == 0
