"""Personal data in texts, in DataFrame operations only: fixed rules, and boosted trees over the proposals of high-recall generators.

Rules give the base spans (email, ip, card, phone), which always stay. Generators propose further, overlapping spans: written-out emails, telephone numbers
in bounded forms (also inside a rule's match that failed for its length), card numbers beside other numbers, IPv6, credentials, and national and bank
numbers. Each proposal gets features of its form and of its context; boosted trees score it and a calibrated threshold for each kind selects. Proposals that
overlap base spans go; of the others, taken in order of start, one that meets the last that stayed takes its place if it scores higher, or else goes.

The trees are fitted in each process from a fixture that this module makes (no corpus rows): its texts run through the same column expressions.
Positions come from the gaps between matches: split() gives them, their lengths are prefix-summed in blocks of 64, so cost grows with the text, not with its
square. Everything happens inside the row: there is no exchange, and a row's result depends on its text alone.

Defined cases: null and empty text have no spans; a run of any length is matched without recursion (possessive quantifiers); repeated rows give equal rows;
an empty table gives no rows; other columns stay as they are, and a column of the result's name is replaced by it.
"""

from __future__ import annotations

import json
import random
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import boost, expression, margin
from .common import free_name, read_table

KINDS = ["email", "ip", "card", "phone", "secret", "iban", "ssn"]
BLOCK, CHUNK, PIECE = 64, 256, 4096  # matches whose lengths are summed at once, spans of a sweep's inner pass, characters of a text cut at once

# Rules. A start is the match's leftmost: the begin of a run, or where the last match ended (\G).
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must contain for a rule or generator to match at all, cheaper to look for: one of the characters, and whether a digit is needed.
HINTS = {"email": ("@", False), "ip": (".", True), "card": ("", True), "phone": ("+", True), "g_email": ("([{", False), "g_phone": ("", True), "g_card": ("", True),
         "g_ip6": (":", False), "g_secret": ("", True), "g_iban": ("", True), "g_ssn": ("-", True)}
GENERATORS = {
    "g_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,5}+"),
    "g_phone": ("phone", r"(?=[0-9+(])(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    "g_card": ("card", r"(?=[0-9])(?<![0-9])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|[0-9]{12,19})(?![0-9])"),
    "g_ip6": ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "g_secret": ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]{0,40}[0-9])[A-Za-z0-9_/+-]{20,}+"),
    "g_iban": ("iban", r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "g_ssn": ("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
# Words before a proposal that speak for its kind.
CUES = {
    "cue_email": r"e-?mail|mail|contact|write|kontakt|correo|courriel",
    "cue_phone": r"phone|tel|call|fax|mobile|cell|whatsapp|telefon|anruf|appel",
    "cue_card": r"card|visa|credit|debit|payment|amex|karte|carte|tarjeta",
    "cue_secret": r"token|secret|api|key|passw|credential|bearer|auth",
    "cue_id": r"ssn|social|iban|account|bank|konto|compte|cuenta|passport",
    "cue_ip": r"\bip\b|ipv6|host|server|address|client",
    "cue_not": r"order|invoice|isbn|version|serial|commit|sha|hash|part|sku|ref|tracking|build",
}
FEATURES = [*GENERATORS, "length", "digits", "letters", "separators", "distinct", "luhn", "plus", "paren", "hex", "grouped", *CUES, "assigned", "before_word", "after_word"]


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of card numbers over at most 19 digits."""
    back = F.reverse(digits)
    total = F.lit(0)
    for i in range(19):
        d = F.coalesce(F.substring(back, i + 1, 1).try_cast("int"), F.lit(0))
        total = total + (d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) <= 3) & (part(x).try_cast("int") <= 255))
    n = F.length(digits_of(v))
    return n.between(12, 19) & luhn(digits_of(v)) if kind == "card" else n.between(9, 15)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: inside functions over arrays an expression is otherwise computed anew wherever it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def add(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """array of struct(name, found, gaps), for the patterns that match at all: the matches in order and the stretches around them, one more than matches."""

    def one(name: str, pattern: str, digit: Column) -> Column:
        marks, needs_digit = HINTS[name]
        sought = F.rlike(text, F.lit(pattern))
        if marks:
            sought = reduce(or_, (F.contains(text, F.lit(m)) for m in marks)) & sought
        if needs_digit:
            sought = digit & sought
        return F.when(sought, F.struct(F.lit(name).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))

    return let(F.rlike(text, F.lit("[0-9]")), lambda digit: F.array_compact(F.array(*[one(n, p, digit) for n, p in patterns.items()])))


def starts(h: Column, body) -> Column:
    """body(starts) with the start of each match of a hit in code points: lengths of gaps and matches, summed in blocks of BLOCK and then over the blocks."""
    steps = F.zip_with(F.slice(h["gaps"], 1, F.size(h["found"])), h["found"], lambda g, m: F.length(g) + F.length(m))

    def with_steps(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: add(F.slice(xs, k * BLOCK + 1, BLOCK)))

        def with_blocks(b: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda k: F.when(k == 0, 0).otherwise(add(F.slice(b, 1, k))))
            return let(sums, lambda c: F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: F.element_at(c, F.floor(i / BLOCK).cast("int") + 1)
                       + F.when(i % BLOCK == 0, 0).otherwise(add(F.slice(xs, i - i % BLOCK + 1, i % BLOCK))) + F.length(F.element_at(h["gaps"], i + 1))))

        return let(blocks, with_blocks)

    return let(let(steps, with_steps), body)


def located(text: Column, patterns: dict[str, str]) -> Column:
    """array of struct(name, at, upto, value, before, after): every match of every pattern with its context."""

    def of(h: Column) -> Column:
        def one(at: Column):
            return lambda i: F.struct(h["name"].alias("name"), F.element_at(at, i).alias("at"), (F.element_at(at, i) + F.length(F.element_at(h["found"], i))).alias("upto"),
                                      F.element_at(h["found"], i).alias("value"), F.lower(F.substring(F.element_at(h["gaps"], i), -32, 32)).alias("before"),
                                      F.substring(F.element_at(h["gaps"], i + 1), 1, 8).alias("after"))

        return starts(h, lambda at: F.transform(F.sequence(F.lit(1), F.size(at)), one(at)))

    return F.flatten(F.transform(hits(text, patterns), of))


def features(c: Column) -> Column:
    """The features of a proposal, in the order of FEATURES, as an array of doubles."""
    return let(digits_of(c["value"]), lambda d: _features(c, d))


def _features(c: Column, d: Column) -> Column:
    v, before = c["value"], c["before"]
    has = lambda p, x: F.rlike(x, F.lit(p)).cast("double")
    by_name = {g: (c["name"] == g).cast("double") for g in GENERATORS} | {
        "length": F.length(v), "digits": F.length(d), "letters": F.length(F.regexp_replace(v, "[^A-Za-z]", "")), "separators": F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        "distinct": F.size(F.array_distinct(F.split(v, ""))), "luhn": (F.length(d).between(12, 19) & luhn(d)).cast("double"), "plus": F.startswith(v, F.lit("+")).cast("double"),
        "paren": has(r"\([0-9]", v), "hex": has("^[0-9a-f]+$", v), "grouped": has(r"^\+?[0-9 ()]*[0-9]{3}[ .-][0-9]{3,4}[ .-]?[0-9]{4}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$", v),
        "assigned": has(r"[=:]\s*[\"']?\s*$", before), "before_word": has("[a-z0-9_]$", before), "after_word": has("^[A-Za-z0-9_]", c["after"]),
    } | {k: has(p, before) for k, p in CUES.items()}
    return F.array(*[F.coalesce(by_name[f].cast("double"), F.lit(0.0)) for f in FEATURES])


def fixture(seed: int = 11, size: int = 240) -> list[tuple[str, str, int]]:
    """(text, value, answer): texts around one value and whether it is personal, every generator with forms and contexts of both answers. A maker gives the
    words before the value and the value."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice(["er", "an", "th", "in", "on", "re", "st", "le", "qua", "che", "mi", "to"]) for _ in range(r.randint(1, 4)))

    def summed(n: int, ok: bool) -> str:
        while True:
            d = r.choice("3456") + num(n - 1)
            total = sum(int(x) if i % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for i, x in enumerate(reversed(d)))
            if (total % 10 == 0) == ok:
                return d

    def card(ok: bool) -> str:
        d = summed(16, ok)
        return r.choice([d, d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])

    plus = lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}"
    loose = lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}"])
    mail = lambda: r.choice(["{} (at) {}.com", "{} [at] {} [dot] org", "{}(at){}.net", "{} [AT] {} [DOT] com"]).format(word() + num(1), word() + "mail")
    iban = lambda: r.choice(["DE", "FR", "GB", "ES"]) + num(2) + r.choice(["", " "]).join([""] + [num(4) for _ in range(4)])
    mixed = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(n - 2)) + num(2)
    ask = lambda *w: r.choice(w) + r.choice([": ", " = ", " ", " is "])
    bare = lambda f, *a: lambda: ("", f(*a))
    after = lambda words, f, *a: lambda: (ask(*words), f(*a))
    yes = [
        bare(mail), after(["email", "contact", "write to"], mail), bare(plus), bare(plus), after(["phone", "call", "tel"], loose), after(["mobile", "fax"], plus),
        lambda: (r.choice(["", word() + " "]), f"({num(3)}) {num(3)}-{num(4)}"), bare(card, True), bare(card, True), after(["card", "visa"], card, True),
        after(["ipv6", "host", "address"], lambda: ":".join(hexa(4) for _ in range(8))),
        lambda: (r.choice(["token", "api_key", "secret", "password"]) + r.choice([' = "', ": ", "="]), r.choice([hexa(40), hexa(40).upper(), hexa(32), hexa(8) + num(r.choice([9, 10, 11, 12, 14])) + hexa(20), mixed(32), mixed(24)])), after(["iban", "account", "konto"], iban), bare(iban),
        after(["ssn", "social security"], lambda: f"{num(3)}-{num(2)}-{num(4)}"), lambda: (summed(16, False) + " ", card(True)), lambda: (word() + " ", plus()),
    ]
    no = [
        bare(card, False), bare(card, False), after(["card", "visa", "order", "tracking"], card, False), after(["order", "invoice", "serial", "ref"], lambda: num(r.choice([9, 10, 11]))), bare(lambda: num(r.choice([9, 10, 11]))),
        bare(lambda: summed(r.choice([12, 13, 14, 15, 17, 18]), False)), after(["isbn", "part", "sku"], lambda: f"{num(3)}-{num(3)}-{num(4)}"), bare(lambda: f"{num(4)} {num(4)}"), bare(lambda: f"{num(3)} {num(4)} {num(4)}"),
        after(["commit", "sha", "hash", "build"], hexa, 40), lambda: (word() + " ", hexa(40)), bare(lambda: word() + "/" + word() + "-" + word() + "-" + num(4) + "/" + word() + word() + word()),
        bare(lambda: word() + word() + word() + word() + "_" + word() + num(1) + word() + word()), after(["version", "serial", "part"], lambda: f"{num(3)}-{num(2)}-{num(4)}"), lambda: (word() + " ", hexa(6) + num(12) + hexa(6)),
        after(["build", "ref"], lambda: "AB" + num(2) + " " + " ".join(mixed(4).upper() for _ in range(3))), bare(lambda: ":".join(num(2) for _ in range(4))), bare(lambda: f"{num(4)}-{num(4)}-{num(4)}"),
    ]
    out = []
    for answer, makers in ((1, yes), (0, no)):
        for i in range(size * 4):
            lead, value = makers[i % len(makers)]()
            out.append((f"{word()} {word()} {lead}{value}{r.choice(['', ' ', '. ', ' ', '!! ', chr(34)])}{r.choice(['', ' ' + word()])}", value, answer))
    return out


_MODEL: dict = {}


def model(spark: SparkSession) -> tuple[float, list, dict[str, float]]:
    """(bias, trees, threshold on the margin for each kind). A third of the fixture is kept back; a kind's threshold is the lowest margin from which at least
    99 % of the kept-back proposals are personal, and at least even odds. Only the planted value itself is personal, not a proposal within it."""
    if "it" not in _MODEL:
        rows = [{"text": t, "want": v, "y": y} for t, v, y in fixture()]
        df = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,want:string,y:int>>")).alias("r")).select("r.*")
        df = df.select("want", "y", F.explode(located(F.col("text"), {n: p for n, (_, p) in GENERATORS.items()})).alias("p"))
        got = df.select(((F.col("y") == 1) & (F.col("p.value") == F.col("want"))).cast("int").alias("y"), "p.name", features(F.col("p")).alias("x")).collect()
        got = sorted((tuple(r["x"]), r["name"], r["y"]) for r in got)
        x, y = np.array([r[0] for r in got]), np.array([float(r[2]) for r in got])
        kept = np.arange(len(y)) % 3 == 0
        bias, trees = boost(x[~kept], y[~kept])
        z, kind, limits = margin(bias, trees, x[kept]), np.array([GENERATORS[r[1]][0] for r in got])[kept], {}
        for k in KINDS:
            zk, yk = z[kind == k], y[kept][kind == k]
            order = np.argsort(-zk, kind="stable")
            good = np.cumsum(yk[order]) / np.arange(1, len(order) + 1) >= 0.99
            limits[k] = max(0.0, float(zk[order][good][-1])) if good.any() else 3.0
        _MODEL["it"] = bias, trees, limits
    return _MODEL["it"]


SPAN = "array<struct<at:int,rank:int,upto:int,kind:string>>"


def span(c: Column, kind: Column) -> Column:
    return F.struct(c["at"].alias("at"), (F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1).cast("int").alias("rank"), c["upto"].alias("upto"), kind.alias("kind"))


def swept(items: Column, state: Column, follow, emit, out: str) -> Column:
    """One pass over an array: struct(state, out). At each item, `emit(state, item)` (an array of type `out`) is put out, then the state becomes follow(state, item). Items go in
    chunks of CHUNK, so that putting out copies a chunk's array at most, and the cost grows with the items, not with their square."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
    none = F.array().cast(out)

    def step(acc: Column, x: Column) -> Column:
        return F.struct(follow(acc["state"], x).alias("state"), F.concat(acc["out"], emit(acc["state"], x)).alias("out"))

    def chunk(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), step)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    all_ = F.aggregate(chunks, F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out")), chunk)
    return let(F.when(F.size(items) > 0, all_), lambda a: F.struct(F.coalesce(a["state"], state).alias("state"), F.coalesce(F.flatten(a["out"]), none).alias("out")))


SCORED = "struct<z:double,span:struct<at:int,rank:int,upto:int,kind:string>>"
ORDERED = f"struct<at:int,free:boolean,item:{SCORED}>"


def clear(base: Column, free: Column) -> Column:
    """Those of `free` (array of SCORED) that meet no base span: a pass in order of start keeps what no earlier base span reaches into, a pass back what no later one
    starts in. Sorted by start, base spans first."""
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["at"].alias("at"), F.lit(False).alias("free"), F.struct(F.lit(0.0).alias("z"), b.alias("span")).alias("item"))),
                                 F.transform(free, lambda s: F.struct(s["span"]["at"].alias("at"), F.lit(True).alias("free"), s.alias("item")))).cast(f"array<{ORDERED}>"))
    none = F.array().cast(f"array<{ORDERED}>")
    upto = lambda x: x["item"]["span"]["upto"]
    ahead = swept(both, F.lit(0), lambda reach, x: F.when(x["free"], reach).otherwise(F.greatest(reach, upto(x))), lambda reach, x: F.when(~x["free"] | (reach <= x["at"]), F.array(x)).otherwise(none), f"array<{ORDERED}>")
    back = let(F.reverse(ahead["out"]), lambda xs: swept(xs, F.lit(2**31 - 1), lambda start, x: F.when(x["free"], start).otherwise(x["at"]),
                                                         lambda start, x: F.when(x["free"] & (start >= upto(x)), F.array(x)).otherwise(none), f"array<{ORDERED}>"))
    return F.transform(F.reverse(back["out"]), lambda x: x["item"])


def best(items: Column) -> Column:
    """Of spans (array of SCORED) in order of start, as an array of SPAN: one pass that holds a span; the next one that meets it takes its place if it scores higher, or
    goes; one that does not meet it is held next."""
    better = lambda a, b: (a["z"] > b["z"])  # noqa: E731  of equal scores the earlier one stays
    meets = lambda held, x: held.isNotNull() & (x["span"]["at"] < held["span"]["upto"])
    done = let(F.array_sort(F.transform(items, lambda s: F.struct(s["span"]["at"].alias("at"), s["span"]["rank"].alias("rank"), s.alias("s")))), lambda xs: swept(
        F.transform(xs, lambda x: x["s"]), F.lit(None).cast(SCORED), lambda held, x: F.when(meets(held, x) & ~better(x, held), held).otherwise(x),
        lambda held, x: F.when(held.isNull() | meets(held, x), F.array().cast(SPAN)).otherwise(F.array(held["span"])), SPAN))
    return let(done, lambda d: F.when(d["state"].isNull(), d["out"]).otherwise(F.concat(d["out"], F.array(d["state"]["span"]))))


def stretches(spans: Column) -> Column:
    """Maximal stretches of overlapping spans in order of start, with the kind of their first: a span opens one unless an earlier span reaches beyond its start."""
    one = "struct<at:int,upto:int,kind:string>"
    wide = lambda held, x: F.struct(held["at"].alias("at"), F.greatest(held["upto"], x["upto"]).alias("upto"), held["kind"].alias("kind")).cast(one)
    own = lambda x: F.struct(x["at"].alias("at"), x["upto"].alias("upto"), x["kind"].alias("kind")).cast(one)
    joins = lambda held, x: held.isNotNull() & (held["upto"] > x["at"])
    done = swept(spans, F.lit(None).cast(one), lambda held, x: F.when(joins(held, x), wide(held, x)).otherwise(own(x)),
                 lambda held, x: F.when(held.isNull() | joins(held, x), F.array().cast(f"array<{one}>")).otherwise(F.array(held)), f"array<{one}>")
    return let(done, lambda d: F.when(d["state"].isNull(), d["out"]).otherwise(F.concat(d["out"], F.array(d["state"]))))


def find(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """docs with a further column `into`: struct(base, spans), both arrays of struct(at, rank, upto, kind) in order of start and listed kind."""
    bias, trees, limits = model(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind_of = lambda c: F.element_at(F.create_map(*[F.lit(x) for g, (k, _) in GENERATORS.items() for x in (g, k)]), c["name"])
    limit_of = lambda kind: F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)]), kind)

    def holds(c: Column) -> Column:
        out = F.lit(True)
        for k in RULES:
            out = F.when(c["name"] == k, valid(k, c["value"])).otherwise(out)
        return out

    def scored(c: Column) -> Column:
        z = let(features(c), lambda x: expression(bias, trees, lambda j: F.element_at(x, j + 1)))
        return F.struct((z - limit_of(kind_of(c))).alias("z"), span(c, kind_of(c)).alias("span"))

    def chosen(base: Column, props: Column) -> Column:
        """The proposals that stay: likely, clear of base spans, and the better one of those that meet."""
        sure = F.filter(F.transform(props, scored), lambda s: s["z"] >= 0)
        return let(sure, lambda free: F.when(F.size(free) > 0, best(clear(base, free))).otherwise(F.array().cast(SPAN)))

    def result(found: Column) -> Column:
        base = F.array_sort(F.transform(F.filter(found, lambda c: c["name"].isin(*RULES) & holds(c)), lambda c: span(c, c["name"])))
        props = F.filter(found, lambda c: ~c["name"].isin(*RULES))
        return let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, F.when(F.size(props) > 0, chosen(b, props)).otherwise(F.array().cast(SPAN)))).alias("spans")))

    found = located(text, RULES | {g: p for g, (_, p) in GENERATORS.items()})
    none = F.struct(F.array().cast(SPAN).alias("base"), F.array().cast(SPAN).alias("spans"))
    return docs.withColumn(into, let(found, lambda f: F.when(F.size(f) > 0, result(f)).otherwise(none)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["upto"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans are replaced once, by the first of them. Texts are cut in blocks of PIECE characters,
    since each cut reads a string from its begin."""
    found, held = free_name(docs, "_pii"), free_name(docs, "_cuts")
    df = find(docs, text_col, found)
    df = df.withColumn(held, F.when(F.size(F.col(found)["spans"]) > 0, stretches(F.col(found)["spans"])))
    cuts, text = F.col(held), F.col(text_col)

    def block(k: Column) -> Column:
        lo, hi = k * PIECE, (k + 1) * PIECE
        return let(F.substring(text, lo + 1, F.lit(PIECE)), lambda part: let(F.filter(cuts, lambda c: (c["at"] < hi) & (c["upto"] > lo)), lambda own: cut(part, own, lo)))

    def cut(part: Column, own: Column, lo: Column) -> Column:
        upto = lambda i: F.when(i == 1, lo).otherwise(F.greatest(lo, F.try_element_at(own, i - 1)["upto"])) - lo
        at = lambda i: F.greatest(lo, F.element_at(own, i)["at"]) - lo
        mark = lambda c: F.when(c["at"] >= lo, F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">"))).otherwise(F.lit(""))
        pieces = F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.concat(F.substring(part, upto(i) + 1, at(i) - upto(i)), mark(F.element_at(own, i))))
        tail = F.substring(part, F.greatest(lo, F.element_at(own, -1)["upto"]) - lo + 1, F.lit(PIECE))
        return F.when(F.size(own) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(part)

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int")), block), "")
    return df.withColumn(text_col, F.when(F.size(cuts) > 0, whole).otherwise(text)).select(*docs.columns)


def op9_pii(spark, sf_dir):
    df = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter(F.col("pii.base"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[count(k) for k in RULES], F.sha2(written(F.col("pii.base")), 256).alias("base_sha256"), written(F.col("pii.spans")).alias("spans"))
