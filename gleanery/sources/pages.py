"""Web pages as Markdown: one pass over the tags with a stack, on the executors; menus, headers, footers, forms and scripts stay out.

What lies in <main> or <article> is the page, if there is text in one; else the body. Headings, lists, tables, quotes, code and images keep their form, links their text only.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Elements by what they do: void ones, those that are left out, those that are within a page's own part, and those that begin and end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUT = frozenset("script style noscript template svg nav footer aside form iframe button select textarea object head dialog".split())
OWN = frozenset(["main", "article"])
LEVEL = {f"h{i}": i for i in range(1, 7)}
BLOCK = frozenset([*LEVEL, *"p div section article main header ul ol li dl dt dd table caption tr blockquote pre figure figcaption address details summary hr body html title".split()])
#: An element that ends, by beginning, an open one of these (up to the nearest of the others).
ENDS = {"p": ({"p"}, {"td", "th", "li", "blockquote", "div", "section", "article"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()  # how often each element is on the stack
        self.out = 0  # elements on the stack that are left out
        self.blocks: list[tuple[bool, str]] = []
        self.inline: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.lists: list[int] = []  # 0: bullets, else the next number
        self.mark = ""
        self.title, self.author, self.images = "", "", []

    # what the stack says

    def push(self, tag: str) -> None:
        self.stack.append(tag)
        self.open[tag] += 1
        self.out += tag in OUT

    def pop(self) -> str:
        tag = self.stack.pop()
        self.open[tag] -= 1
        self.out -= tag in OUT
        return tag

    def own(self) -> bool:
        return any(self.open[t] for t in OWN)

    def left_out(self) -> bool:
        return self.out > 0 or self.open["header"] > 0 and not self.own()

    def flush(self) -> None:
        raw = "".join(self.inline)
        self.inline = []
        pre = self.open["pre"] > 0
        text = raw.strip("\n") if pre else SPACES.sub(" ", raw).strip()
        if not text.strip():
            return
        if self.tables:
            if self.tables[-1] and self.tables[-1][-1]:
                cell = self.tables[-1][-1]
                cell[-1] = f"{cell[-1]} {text}".strip().replace("|", "\\|").replace("\n", " ")
            return
        level = next((n for t, n in LEVEL.items() if self.open[t]), 0)
        if level:
            text = "#" * level + " " + text
        elif pre:
            text = f"```\n{text}\n```"
        else:
            text = re.sub(r"^(#+ )", r"\\\1", text)
            if self.lists:
                text = "  " * (len(self.lists) - 1) + (self.mark or "  ") + text
                self.mark = ""
        if self.open["blockquote"]:
            text = "\n".join("> " + line for line in text.split("\n"))
        self.blocks.append((self.own(), text))

    # tokens

    def handle_starttag(self, tag, attrs):
        ended, walls = ENDS.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, -1, -1) if any(self.open[t] for t in ended) else ():
            if self.stack[i] in ended:
                self.end(i)
                break
            if self.stack[i] in walls:
                break
        a = dict(attrs)
        if tag == "meta":
            name, said = (a.get("name") or a.get("property") or "").lower(), (a.get("content") or "").strip()
            if name == "og:title" and said:
                self.title = said
            if name in ("author", "article:author") and said and not self.author:
                self.author = said
            return
        if tag == "br":
            self.inline.append("\n" if self.open["pre"] else " ")
            return
        if tag in BLOCK:
            self.flush()
        if self.left_out():
            if tag not in VOID:
                self.push(tag)
            return
        if tag == "img":
            src = (a.get("src") or "").strip()
            if src and not src.startswith("data:"):
                alt = SPACES.sub(" ", a.get("alt") or "").strip()
                self.images.append((self.own(), src, alt))
                self.inline.append(f" ![{alt}]({src}) ")
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else 0)
        elif tag == "li" and self.lists:
            n = self.lists[-1]
            self.mark = f"{n}. " if n else "- "
            self.lists[-1] += 1 if n else 0
        if tag not in VOID:
            self.push(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            self.end(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def end(self, at: int) -> None:
        """Ends the element at a place of the stack and all within it."""
        while len(self.stack) > at:
            tag = self.stack[-1]
            if tag in BLOCK or tag in ("td", "th"):
                self.flush()
            self.pop()
            if self.left_out() or tag in OUT:
                continue
            if tag == "table" and self.tables:
                self.end_table()
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def end_table(self) -> None:
        rows = [r for r in self.tables.pop() if any(r)]
        if not rows:
            return
        wide = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (wide - len(r))) + " |"
        if self.tables:  # within a cell only its text counts
            self.inline.append(" ".join(c for r in rows for c in r if c))
            self.flush()
            return
        self.blocks.append((self.own(), "\n".join([line(rows[0]), "|" + "---|" * wide, *map(line, rows[1:])])))

    def handle_data(self, data):
        if self.stack and self.stack[-1] == "title" and not self.open["svg"]:
            self.title = self.title or SPACES.sub(" ", data).strip()
        elif not self.left_out():
            self.inline.append(data)


def markdown_of(html: str) -> tuple[str, str, list[str], list[dict]]:
    """(title, Markdown, authors, images as path and caption) of a page."""
    p = Markdown()
    p.feed(html)
    p.close()
    p.end(0)
    p.flush()
    own = any(mine for mine, _ in p.blocks)
    said = [t for mine, t in p.blocks if mine or not own]
    heading = next((t.lstrip("# ") for t in said if t.startswith("#")), "")
    authors = [a.strip() for a in p.author.split(",") if a.strip()]
    return p.title or heading or "Untitled", "\n\n".join(said), authors, [{"path": s, "caption": a} for mine, s, a in p.images if mine or not own]


def to_markdown(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """doc_id, title, text (Markdown), authors, figures (array of path and caption). Null and empty pages have the title Untitled and no text."""
    kind = pages.schema[id_col].dataType.simpleString()
    figures = pa.list_(pa.struct([("path", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for b in batches:
            found = [markdown_of(x.as_py() or "") for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.list_(pa.string()), figures)))], names=["doc_id", "title", "text", "authors", "figures"])

    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"doc_id {kind}, title string, text string, authors array<string>, figures array<struct<path:string,caption:string>>")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """`to_markdown` of the HTML files under a folder."""
    r = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").text(path, wholetext=True)
    return to_markdown(r.select(F.col("_metadata.file_path").alias("doc_id"), T.drop_controls(F.col("value")).alias("html")))
