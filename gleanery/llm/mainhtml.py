"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks with the open elements around each. A logistic classifier, fitted from this module's own labelled pages, gives each
block two costs, of calling it content and of calling it boilerplate; these are its capacities to the two terminals. Neighbours in page order and blocks
of one DOM parent (weaker, the further apart their paths) are joined by smoothness edges. The minimum cut, by max-flow over the blocks, is the labelling of
least total cost. Blocks whose own costs outweigh all their edges are fixed beforehand, which leaves the cut unchanged and the flow a small graph.

Defined cases: null and empty html, and pages without text, give an empty text; a comment, script, style or tag that is never closed runs to the page's end; stray
closing tags are ignored; blocks of one page may repeat and are all kept; repeated rows give equal rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

TAG = re.compile(r"""<(?:(?P<bogus>!--|[!?])|(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?P<torn>["'])))""")
# Fixed values of HTML: elements that open a block, that hold no text for the reader, and that are never closed.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style template noscript textarea iframe svg object title head-meta canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "button", "label", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Words of class and id that speak against content, or for it.
AGAINST = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|menu\w*|nav\w*|sidebar\w*|side|widget\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion|foot\w*|head(?:er)?|masthead|share\w*|social\w*|related\w*|recommend\w*|subscri\w*|newsletter\w*|signup|login|search\w*|breadcrumb\w*|pag(?:er|ination)\w*|tags?|toolbar|copyright|legal|form\w*)(?=$|[\s_-])", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content\w*|main|story\w*|body|text|page)(?=$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
COMMENTISH = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus\w*|repl(?:y|ies)|respond)(?=$|[\s_-])", re.I)


# What an element and those around it say, a bit each.
GROUPS = {"menu": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "aside": ("aside",), "table": ("table",), "list": ("li", "dd", "dt"), "article": ("article", "main"),
          "form": ("form", "button", "label", "select", "option", "fieldset", "dialog", "search", "legend")}
BITS = {g: 1 << i for i, g in enumerate([*GROUPS, "against", "for", "hidden", "comment"])}
OF_NAME = {n: BITS[g] for g, names in GROUPS.items() for n in names}


class Node:
    """An open element: its bits are its own and those of all around it, so a block needs only the innermost."""

    __slots__ = ("bits", "depth", "name", "parent", "serial")

    def __init__(self, name: str, serial: int, parent: Node | None, bits: int):
        self.name, self.serial, self.parent = name, serial, parent
        self.bits = bits | OF_NAME.get(name, 0) | (parent.bits if parent else 0)
        self.depth = parent.depth + 1 if parent else 1


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None  # the innermost open block element
    linked: int  # characters inside links
    tags: int


def attributes(rest: str) -> int:
    words = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(rest)) if rest else ""
    found = {"against": words and AGAINST.search(words), "for": words and FOR.search(words), "hidden": rest and HIDDEN.search(rest), "comment": words and COMMENTISH.search(words)}
    return sum(BITS[k] for k, v in found.items() if v)


def blocks_of(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[Node] = []
    open_: Counter = Counter()  # names on the stack, so that a tag without a partner costs no search

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.name] -= 1
        del stack[i:]

    serial, at, parts, linked, in_link, tags, end = 0, 0, [], 0, 0, 0, len(page)

    def flush():
        nonlocal parts, linked, tags
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked, tags))
        parts, linked, tags = [], 0, 0

    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m["bogus"]:
            close = "-->" if m["bogus"] == "!--" else ">"
            stop = page.find(close, m.start() + 4 if close == "-->" and page[m.start() + 4 : m.start() + 5] != ">" else at)
            at = end if stop < 0 else stop + len(close)
            continue
        if m["torn"]:  # a quote that is never closed: the tag ends at the next angle
            stop = page.find(">", at)
            at = end if stop < 0 else stop + 1
        name = m["name"].lower()
        if m["close"]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCKS:
                flush()
                for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                    if stack[i].name == name:
                        cut(i)
                        break
            continue
        if name in SILENT:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link += 1
        elif name in BLOCKS:
            flush()
            in_link = 0 if name in ("p", "div", "article", "section") else in_link
            if name in CLOSES_P and stack and stack[-1].name == "p":
                cut(len(stack) - 1)
            if name in SAME and any(open_[x] for x in SAME[name]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name in SCOPES[name]:
                        break
                    if stack[i].name in SAME[name]:
                        cut(i)
                        break
            if name not in VOID:
                serial += 1
                stack.append(Node(name, serial, stack[-1] if stack else None, attributes(m["rest"])))
                open_[name] += 1
        else:
            tags += 1
    flush()
    return out


FEATURES = ("bias", "menu", "header", "footer", "aside", "form", "table", "list", "article", "heading", "paragraph", "against", "for", "hidden", "comment", "links", "words", "long", "sentence", "outside", "link_list")


def features(b: Block, has_article: bool) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    links = min(1.0, b.linked / n) if n else 0.0
    bits, last = (b.node.bits, b.node.name) if b.node else (0, "")
    has = {g: float(bool(bits & bit)) for g, bit in BITS.items()}
    return [
        1.0, has["menu"], has["header"], has["footer"], has["aside"], has["form"], has["table"], has["list"], has["article"],
        float(last in ("h1", "h2", "h3", "h4", "h5", "h6")), float(last in ("p", "blockquote", "pre")), has["against"], has["for"], has["hidden"], has["comment"],
        links, min(words, 60) / 60, float(words >= 12), float(b.text[-1] in ".!?…\"'»”"), float(has_article and not has["article"]), float(links > 0.8 and last == "li"),
    ]


# The classifier's labelled pages

def labelled_pages(pages: int = 160, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, content?)]) of pages that this function makes: articles in several kinds of markup between boilerplate of the named kinds."""
    r = random.Random(seed)
    count = iter(range(10**9))
    phrase = lambda a, b: " ".join("".join(r.choice("aeiou") + r.choice("bdlmnrst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))).capitalize()
    unique = lambda a, b: f"{phrase(a, b)} {next(count)}"
    out = []
    for _ in range(pages):
        truth: list[tuple[str, int]] = []

        def put(text: str, content: int, form: str = "{}", truth: list = truth) -> str:
            truth.append((text, content))
            return form.format(text)

        link = lambda t: f'<a href="/{t[:3]}">{t}</a>'
        menu = lambda tag, attr: f"<{tag}{attr}><ul>" + "".join(f"<li>{link(put(unique(1, 2), 0))}</li>" for _ in range(r.randint(3, 7))) + f"</ul></{tag}>"
        head = "<header" + r.choice(["", ' class="masthead"']) + ">" + put(unique(1, 5), 0, r.choice(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"])) + "</header>"
        boiler = [
            lambda: menu("nav", ""), lambda: menu("div", ' class="menu"'), lambda: menu("div", ' id="main-nav"'), lambda: head,
            lambda: put(unique(4, 14) + ".", 0, '<div class="ad">{}</div>'), lambda: put(unique(5, 16) + ".", 0, '<div class="cookie-notice"><p>{}</p></div>'), lambda: put(unique(3, 9), 0, '<div class="banner" role="alert">{}</div>'),
        ]
        after = [
            lambda: put("© " + unique(3, 12) + ".", 0, "<footer>{}</footer>"), lambda: put("© " + unique(3, 12) + ".", 0, '<div id="footer"><p>{}</p></div>'),
            lambda: "<aside>" + put(unique(1, 3), 0, "<h3>{}</h3>") + "".join(put(unique(4, 20) + ".", 0, "<p>{}</p>") for _ in range(2)) + "</aside>",
            lambda: '<div class="sidebar">' + put(unique(2, 3), 0, "<h2>{}</h2>") + "".join(put(unique(4, 20) + ".", 0, "<p>{}</p>") for _ in range(2)) + "</div>",
            lambda: '<section id="comments">' + put(unique(1, 2), 0, "<h2>{}</h2>") + "".join(put(unique(5, 40) + ".", 0, '<div class="comment"><p>{}</p></div>') for _ in range(3)) + "</section>",
            lambda: '<form action="/s">' + put(unique(1, 3), 0, "<label>{}</label>") + put(unique(1, 2), 0, "<button>{}</button>") + "</form>",
            lambda: '<div class="related"><ul>' + "".join(f"<li>{link(put(unique(3, 7), 0))}</li>" for _ in range(3)) + "</ul></div>",
        ]
        say = lambda: unique(r.choice([1, 6, 20]), r.choice([24, 60, 90])) + r.choice([".", ".", ".", ""])
        body = [lambda: put(say(), 1, "<p>{}</p>")] * 5 + [lambda: put(say(), 1, "<p><b>{}<br>"), lambda: put(unique(2, 6), 1, "<h2>{}</h2>"), lambda: "<ul>" + "".join(put(unique(3, 15), 1, "<li>{}</li>") for _ in range(3)) + "</ul>",
                                                             lambda: put(say(), 1, "<blockquote>{}</blockquote>"), lambda: "<table><tr>" + "".join(put(unique(1, 3), 1, "<td>{}</td>") for _ in range(3)) + "</tr></table>"]
        opens, closes = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content">', "</div>"), ("<div>", "</div>")])
        page = ["<html><body>", *(f() for f in r.sample(boiler, r.randint(1, 4))), opens, put(unique(2, 9), 1, "<h1>{}</h1>"), *(r.choice(body)() for _ in range(r.randint(2, 12))), *([after[4]()] if r.random() < 0.1 else []), closes]
        page += [f() for f in r.sample(after, r.randint(1, 4))] + ["</body></html>"]
        out.append(("".join(page), truth))
    return out


_WEIGHTS: list = []


def weights() -> np.ndarray:
    """Logistic weights by Newton's method with a ridge, from labelled_pages()."""
    if not _WEIGHTS:
        x, y = [], []
        for page, truth in labelled_pages():
            found = blocks_of(page)
            has, answer = has_article(found), dict(truth)
            for b in found:
                if b.text in answer:
                    x.append(features(b, has))
                    y.append(answer[b.text])
        x, y = np.array(x), np.array(y, float)
        w = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (p - y) + 0.3 * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        _WEIGHTS.append(w)
    return _WEIGHTS[0]


def has_article(found: list[Block]) -> bool:
    return any(b.node.bits & BITS["article"] for b in found if b.node)


# The cut

def apart(a: Node | None, b: Node | None) -> int:
    """Elements that separate two: those to leave and those to enter from one to the other."""
    steps = 0
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(found: list[Block], next_to: float = 0.5, same_parent: float = 0.6) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next one in page order, and with the last block of its DOM parent; an edge weakens with the elements that separate them."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, next_to / (1 + apart(found[i - 1].node, b.node))))
        parent = b.node.parent.serial if b.node and b.node.parent else 0
        if parent in last:
            out.append((last[parent], i, same_parent))
        last[parent] = i
    return out


def min_cut(content: list[float], other: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """content[i]: cost of calling i content; other[i]: of calling it boilerplate; an edge's capacity is the cost of unlike labels. True: content.
    Nodes that their own costs decide whatever their neighbours do are fixed, their edges become costs of the neighbours, and so on; max-flow labels the rest.
    Ties go to boilerplate (the source side is what a residual path from the content terminal reaches)."""
    n = len(content)
    gain = [o - c for c, o in zip(content, other)]  # > 0: content is cheaper
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) > sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for i in range(n):  # what is left falls apart into small graphs, each with a flow of its own
        if label[i] is None:
            part, todo = {i}, [i]
            while todo:
                todo += (new := [j for j in near[todo.pop()] if j not in part])
                part.update(new)
            reached = max_flow(sorted(part), gain, near)
            for j in part:
                label[j] = j in reached
    return [bool(x) for x in label]


def max_flow(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the content terminal's side of a minimum cut, by shortest augmenting paths (breadth first, so at most nodes x edges of them)."""
    residual = {i: dict(near[i]) for i in nodes}
    source = {i: gain[i] for i in nodes if gain[i] > 0}
    sink = {i: -gain[i] for i in nodes if gain[i] < 0}
    while True:
        parent: dict[int, int | None] = {i: None for i, c in source.items() if c > 1e-12}
        todo, end = deque(parent), None
        while todo and end is None:
            i = todo.popleft()
            if sink.get(i, 0) > 1e-12:
                end = i
                break
            for j, c in residual[i].items():
                if c > 1e-12 and j not in parent:
                    parent[j] = i
                    todo.append(j)
        if end is None:
            return set(parent)
        path = [end]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        path.reverse()
        flow = min(source[path[0]], sink[end], *(residual[a][b] for a, b in zip(path, path[1:])))
        source[path[0]] -= flow
        sink[end] -= flow
        for a, b in zip(path, path[1:]):
            residual[a][b] -= flow
            residual[b][a] = residual[b].get(a, 0.0) + flow


def main_blocks(page: str | None, w: np.ndarray) -> list[str]:
    found = blocks_of(page) if page else []
    if not found:
        return []
    has = has_article(found)
    z = np.clip(np.array([features(b, has) for b in found]) @ w, -20, 20)
    content, other = np.logaddexp(0, -z).tolist(), np.logaddexp(0, z).tolist()
    return [b.text for b, keep in zip(found, min_cut(content, other, edges_of(found))) if keep]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: content blocks in page order, two line feeds between them."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    w = weights()

    def run(batches):
        for batch in batches:
            out = ["\n\n".join(main_blocks(x.as_py(), w)) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return d.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op8_mainhtml(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
