"""Repairing the turns of conversations by error-correcting Earley parsing.

A weighted grammar of role initials says what a sound conversation is; besides its own productions every terminal may be rewritten from another role (Rerole), come from
nothing (Insert), and every turn may stand for nothing (Delete). Chart items keep the least (cost, audit), where the audit is the string of edit initials of the turns
covered; the cheapest completed item over the whole conversation is the repair, ties going to the ASCII-least audit.

The grammar is right-linear and the parser reads the turns from the last to the first, so all items of a chart column share one origin, and an audit grows at its front only:
two audits of one item keep their order whatever is put before them (grown at its end, a proper prefix could change its order). Audits are not built while parsing: an item holds
the letters of its last step and the rank, in the column it came from, of the audit that follows. A column's ranks come from sorting its few items, so time and memory are
linear in the turns.

A conversation is gathered into one row, in the order of its turns, as its repair is one row; tasks go from conversation to conversation and never hold a partition.

Defined cases: null roles and texts are one space; turns in order with nulls first, rows of one turn by role and then text (bytes); repeated rows are duplicates; a null conv_id is
a conversation of its own; a conversation without rows gives zeros, an empty audit and no turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, bounded, read_table

KEEP, MUST_GO, TRUNCATED = 0, 1, 2
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Grammar:
    """Right-linear productions of role initials (upper case: nonterminals, last in their production), the roles that may be written, and the costs."""

    start: str = "S"
    rules: tuple[tuple[str, str], ...] = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "uaP"), ("P", "ua"))  # (s?(ua)+)?
    roles: tuple[tuple[str, str], ...] = (("u", "user"), ("a", "assistant"))
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    terminals: frozenset = field(init=False)

    def __post_init__(self):
        if any(x.isupper() for _, body in self.rules for x in body[:-1]):
            raise ValueError("a nonterminal must be the last symbol of its production")
        object.__setattr__(self, "terminals", frozenset(x for _, body in self.rules for x in body if not x.isupper()))


def parse(rows: Iterable[tuple[str, int]], grammar: Grammar) -> tuple[int, list[tuple[str, str]]]:
    """The least cost and the edits (letter, role initial) of (role initial, state) rows. Items are (production, symbols recognised from its end); values are (cost, letters
    of the last step, rank of the audit after them, edits of the step, item that it came from)."""
    rows, g = list(rows), grammar
    written = {r for r, _ in g.roles}
    bodies = [body for _, body in g.rules]
    waiting = {lhs: [r for r, body in enumerate(bodies) if body.endswith(lhs)] for lhs, _ in g.rules}

    def close(column: dict) -> dict:
        """Insertions and completions until no item gets better; then the column's ranks."""
        open_items = sorted(column, key=lambda i: column[i][:3])
        while open_items:
            r, dot = item = open_items.pop(0)
            cost, letters, rank, edits, came = column[item]
            body, found = bodies[r], []
            if dot == len(body):  # completed from here to the end
                found = [((w, 1), (cost, letters, rank, edits, came)) for w in waiting.get(g.rules[r][0], ())]
            elif (t := body[-1 - dot]) in written:
                found = [((r, dot + 1), (cost + g.insert, "I" + letters, rank, (("I", t), *edits), came))]
            for to, value in found:
                if to not in column or value[:3] < column[to][:3]:
                    column[to] = value
                    open_items = sorted({*open_items, to}, key=lambda i: column[i][:3])
        place = {key: n for n, key in enumerate(sorted({v[1:3] for v in column.values()}))}
        return {item: (v[0], place[v[1:3]], v[3], v[4]) for item, v in column.items()}

    columns = [close({(r, 0): (0, "", 0, (), None) for r in range(len(bodies))})]  # all productions are predicted at the end
    for role, state in reversed(rows):
        column: dict = {}
        late = g.truncated if state == TRUNCATED else 0
        for (r, dot), (cost, rank, _, _) in columns[-1].items():
            body = bodies[r]
            steps = [((r, dot), (cost + g.delete, "D", rank, (("D", ""),), (r, dot)))]
            if state != MUST_GO and dot < len(body):
                t = body[-1 - dot]
                if t == role:
                    steps.append(((r, dot + 1), (cost + late, "K", rank, (("K", t),), (r, dot))))
                elif t in written:
                    steps.append(((r, dot + 1), (cost + g.rerole + late, "R", rank, (("R", t),), (r, dot))))
            for to, value in steps:
                if to not in column or value[:3] < column[to][:3]:
                    column[to] = value
        columns.append(close(column))
    done = [(v[0], v[1], item) for item, v in columns[-1].items() if g.rules[item[0]][0] == g.start and item[1] == len(bodies[item[0]])]
    if not done:
        raise ValueError("the grammar cannot be reached by the edits allowed")
    cost, _, item = min(done)
    edits: list[tuple[str, str]] = []
    for column in reversed(columns):  # from the first turn on
        _, _, step, came = column[item]
        edits += step
        item = came
    return cost, edits


@lru_cache(maxsize=1 << 16)
def short_parse(rows: tuple, grammar: Grammar) -> tuple[int, list[tuple[str, str]]]:
    """Short conversations repeat in their roles and faults; one answer serves all of them."""
    return parse(rows, grammar)


def states(roles: list[str], texts: list[str]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated, or none (an empty string)."""
    seen, out = set(), []
    for row in zip(roles, texts, strict=True):
        said = row[1].rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add(row)
    return out


def gather(rows: DataFrame, copies: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, rows: array of (turn, role, text) in order, of every conversation; a row stands there as often as `copies` says (0: not at all)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    row = F.struct(F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    r = F.array_repeat(row, copies.cast("int")) if copies is not None else F.array(row)
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.flatten(F.collect_list(r))).alias("rows"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(conversations: DataFrame, grammar: Grammar = Grammar()) -> DataFrame:
    """conversations as `gather` gives them -> conv_id, missing turns (gaps), rows by their first fault, neighbours that the grammar forbids (illegal), cost and audit of the
    cheapest repair, and the repaired turns as array of (role, text)."""
    bounded(conversations.sparkSession)
    pairs = {"su", "ua", "au"}
    names = dict(grammar.roles)

    def mend(rows: list[dict]) -> tuple:
        roles, texts = [r["role"] for r in rows], [r["text"] for r in rows]
        faults, initials = states(roles, texts), [r[:1] for r in roles]
        code = tuple((i if i in grammar.terminals else "", MUST_GO if f in ("blank", "duplicate") else TRUNCATED if f else KEEP) for i, f in zip(initials, faults, strict=True))
        cost, edits = (short_parse if len(code) <= 16 else parse)(code, grammar) if rows else (0, [])
        out, at = [], 0
        for letter, t in edits:
            if letter == "I":
                out.append((names[t], ""))
                continue
            if letter != "D":
                out.append((roles[at] if letter == "K" else names[t], texts[at]))
            at += 1
        turns = {r["turn"] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in pairs for a, b in zip(initials, initials[1:]))
        return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, "".join(x for x, _ in edits), out

    def batch_of(ids: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
        *numbers, audits, turns = zip(*found, strict=True)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        made = [[{"role": r, "text": t} for r, t in x] for x in turns]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(n, pa.int64()) for n in numbers), pa.array(audits, pa.string()), pa.array(made, kind)], names=["conv_id", *COUNTS, "audit", "repaired"])

    def run(batches):
        ids, found, size = [], [], 0
        for batch in batches:
            for i, rows in enumerate(batch.column("rows")):
                found.append(mend(rows.as_py() or []))
                ids.append(batch.column("conv_id").slice(i, 1))
                size += sum(len(t) for _, t in found[-1][-1]) + 1000
                if size > BLOCK:
                    yield batch_of(ids, found)
                    ids, found, size = [], [], 0
        if found:
            yield batch_of(ids, found)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return conversations.select("conv_id", "rows").mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired array<struct<role:string,text:string>>")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The query's damage: by crc32 of `conv_id:turn` modulo 20 a row goes, loses its text, its sentence ends or its role, or comes twice; and how often it stands."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), r"[.!?]", "")).otherwise(said("text"))
    d = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    return d, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def op12_conversation_repair(spark, sf_dir):
    rows, copies = damaged(read_table(spark, sf_dir, "conversations"))
    d = repair(gather(rows, copies))
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return d.select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
