"""Readers of text-like sources into documents and sections; binary office files through a zip reader on the executors.

Plain files are read whole by Spark's own sources (any file system); what is parsed inside a row stays in expressions where expressions can say it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media
from ..functions import text as T
from ..operators import sections as S
from ..operators import transcripts
from . import office, pages
from .images import LEAST, sized
from .latex import inline_includes, latex_head, latex_sections, tabular  # noqa: F401

EXTENSIONS = {"markdown": "*.{md,markdown,txt}", "latex": "*.tex", "notebook": "*.ipynb", "html": "*.{html,htm}", "video": "*.vtt", "docx": "*.docx", "pptx": "*.pptx", "pdf": "*.pdf"}


def whole(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """path -> doc_id (the file's path), text."""
    r = spark.read.option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", EXTENSIONS[kind]) if kind else r
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), T.drop_controls(F.col("value")).alias("text"))


def front(text: Column, key: str) -> Column:
    """A field of the YAML head, without quotes."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{key}:\s*(.+)$", 1), r"^[\"']|[\"']$", ""))


def markdown_head(docs: DataFrame) -> DataFrame:
    """doc_id, title (head, else first level-1 header, else first header, else Untitled Document), authors (array), figures (array of alt and source), tables."""
    t = F.col("text")
    some = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(some(front(t, "title")), some(F.trim(F.regexp_extract(t, r"(?m)^#\s+(.+)$", 1))), some(F.trim(F.regexp_extract(t, r"(?m)^#{1,6}\s+(.+)$", 1))), F.lit("Untitled Document"))
    authors = F.filter(F.transform(F.split(F.regexp_replace(front(t, "authors?"), r"^\[|\]$", ""), ","), lambda a: F.trim(F.regexp_replace(F.trim(a), r"^[\"']|[\"']$", ""))), lambda a: a != "")
    image = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    figures = F.zip_with(F.regexp_extract_all(t, F.lit(image), F.lit(1)), F.regexp_extract_all(t, F.lit(image), F.lit(2)), lambda a, b: F.struct(a.alias("caption"), b.alias("path")))
    tables = F.regexp_extract_all(t, F.lit(r"(?m)((?:^\|[^\n]*\|[ \t]*\n)(?:^\|[ :|-]+\|[ \t]*\n)(?:^\|[^\n]*\|[ \t]*+(?:\n|$))++)"), F.lit(1))  # possessive: rows are not stacked
    return docs.select("doc_id", title.alias("title"), authors.alias("authors"), figures.alias("figures"), F.transform(tables, lambda x: T.strip(x)).alias("tables"))


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    docs = whole(spark, path, "markdown")
    return markdown_head(docs), S.split_headers(docs)


CELL = "struct<cell_type:string,source:string,input:string,outputs:array<struct<output_type:string,text:string,data:map<string,string>>>>"


def notebook_cells(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text of JSON) -> doc_id, cell, kind, source, outputs: formats 4 and 3; a source or output given as a list of lines is joined."""
    schema = f"cells array<{CELL}>, worksheets array<struct<cells:array<{CELL}>>>"
    j = F.from_json("text", schema)
    d = docs.select("doc_id", j.alias("j")).select("doc_id", F.posexplode(F.coalesce(F.col("j.cells"), F.try_element_at("j.worksheets", F.lit(1))["cells"])).alias("cell", "c"))
    lines = lambda c: F.coalesce(F.array_join(F.from_json(c, "array<string>"), ""), c)
    return d.select("doc_id", "cell", F.col("c.cell_type").alias("kind"), lines(F.coalesce("c.source", "c.input")).alias("source"),
                    F.transform("c.outputs", lambda o: F.struct(o["output_type"].alias("kind"), lines(o["text"]).alias("text"), o["data"].alias("data"))).alias("outputs"))


def code_prose(code: Column) -> Column:
    """Comments of more than five characters and docstrings of code, in that order; kept if together they have six words."""
    comments = F.filter(F.transform(F.regexp_extract_all(code, F.lit(r"(?m)^\s*#+\s*(.+)$"), F.lit(1)), lambda c: F.trim(c)), lambda c: F.length(c) > 5)
    docs = F.regexp_extract_all(code, F.lit(r'(?s)(?:"""|\'\'\')(.*?)(?:"""|\'\'\')'), F.lit(1))
    text = F.trim(F.concat_ws(" ", comments, docs))
    return F.when(T.word_count(text) >= 6, text)


def notebook_sections(docs: DataFrame) -> DataFrame:
    """Cells under the first header of each Markdown cell: doc_id, ord, section_id, title, content, section_type, word_count. Code gives its prose, outputs their short
    text; cells before the first header only name the notebook; sections without text go, and their number with them."""
    c = notebook_cells(docs)
    title = F.trim(F.regexp_extract("source", r"(?m)^#{1,6}\s+(.+)$", 1))
    header = (F.col("kind") == "markdown") & (title != "")
    said = F.filter(F.transform(F.coalesce("outputs", F.array().cast("array<struct<kind:string,text:string,data:map<string,string>>>")), lambda o: F.coalesce(o["text"], o["data"]["text/plain"])), lambda t: t.isNotNull() & (F.length(t) < 600) & ~F.startswith(F.trim(t), F.lit("<")))
    body = F.when(header, F.regexp_replace("source", r"(?m)\A\s*#{1,6}\s+.+$", "")).when(F.col("kind") == "code", F.concat_ws("\n", code_prose(F.col("source")), F.array_join(said, "\n"))).otherwise(F.col("source"))
    w = Window.partitionBy("doc_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("title", F.when(header, title)).withColumn("body", T.strip(body)).withColumn("g", F.sum(F.when(header, 1).otherwise(0)).over(w)).where("g > 0")
    g = c.groupBy("doc_id", "g").agg(F.max("title").alias("title"), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("cell", "body"))), lambda s: s["body"] != ""), lambda s: s["body"]), "\n\n").alias("content")).where("content <> ''")
    g = g.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("g")))
    return g.select("doc_id", "ord", F.concat(F.lit("section_"), F.col("ord").cast("string")).alias("section_id"), "title", "content", T.section_type(F.col("title")).alias("section_type"), T.word_count(F.col("content")).alias("word_count"))


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    return transcripts.parse_vtt(whole(spark, path, "video"))


# Binary office files

W_NS, A_NS, P_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def docx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of paragraphs and tables in document order; a table is its Markdown."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W_NS}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{W_NS}t"))
    for e in body if body is not None else ():
        if e.tag == f"{W_NS}p":
            style = e.find(f"{W_NS}pPr/{W_NS}pStyle")
            m = re.match(r"(?i)heading\s*([1-9])", style.get(f"{W_NS}val", "") if style is not None else "")
            if said(e).strip():
                out.append(("heading" if m else "paragraph", int(m[1]) if m else 0, said(e).strip()))
        elif e.tag == f"{W_NS}tbl":
            rows = [[said(c).strip() for c in r.findall(f"{W_NS}tc")] for r in e.findall(f"{W_NS}tr")]
            if rows:
                line = lambda r: "| " + " | ".join(r) + " |"
                out.append(("table", 0, "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])])))
    return out


def pptx_blocks(data: bytes) -> list[tuple[str, int, str]]:
    """A slide's title as a heading, its other text as paragraphs, in slide order."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        for n in slides:
            for shape in ET.fromstring(z.read(n)).iter(f"{P_NS}sp"):
                kind = shape.find(f"{P_NS}nvSpPr/{P_NS}nvPr/{P_NS}ph")
                text = "\n".join(t for t in ("".join(r.text or "" for r in p.iter(f"{A_NS}t")) for p in shape.iter(f"{A_NS}p")) if t.strip())
                if text.strip():
                    out.append(("heading" if kind is not None and kind.get("type") in ("title", "ctrTitle") else "paragraph", 1, text.strip()))
    return out


DECODERS: dict[str, Callable[[bytes], list[tuple[str, int, str]]]] = {"docx": docx_blocks, "pptx": pptx_blocks}


def read_binary(spark: SparkSession, path: str, kind: str, decode: Callable[[bytes], list[tuple[str, int, str]]] | None = None) -> DataFrame:
    """doc_id, ord, kind, level, text of a binary format's blocks; `decode` plugs in formats that this library has no decoder for (pdf, video). Unreadable files give
    one block of kind error."""
    decode = decode or DECODERS[kind]

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, i, *x) for i, x in enumerate(decode(bytes(data)), 1)]
                except Exception as e:  # noqa: BLE001  a damaged file must not end the job
                    rows.append((p, 1, "error", 0, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "kind", "level", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS[kind]).load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, ord int, kind string, level int, text string")


def block_sections(blocks: DataFrame) -> DataFrame:
    """Blocks to sections: a heading opens one; what stands before the first goes."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("g", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w)).where("g > 0")
    g = b.groupBy("doc_id", "g").agg(F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("title"), F.max("level").alias("level"),
                                     F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))), lambda s: s["kind"] != "heading"), lambda s: s["text"]), "\n\n").alias("content"))
    g = g.where("content <> ''").withColumnRenamed("g", "ord")
    return g.withColumn("section_type", T.section_type(F.col("title"))).withColumn("word_count", T.word_count(F.col("content")))


# Notebooks: heads and pictures

def notebook_heads(docs: DataFrame) -> DataFrame:
    """doc_id, title, authors. The Markdown before the first header (or with it) names a notebook: its YAML head, else its first level-1 header; else the first section's title, else
    the file's name."""
    c = notebook_cells(docs).where("kind = 'markdown'")
    w = Window.partitionBy("doc_id").orderBy("cell")
    header = F.rlike("source", F.lit(r"(?m)^#{1,6}\s+\S"))
    c = c.withColumn("_before", F.coalesce(F.sum(header.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before = 0")
    lead = c.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "source"))), lambda s: s["source"]), "\n").alias("_lead"))
    field = lambda key: F.trim(F.regexp_extract(F.regexp_extract("_lead", r"(?s)^---\s*\n(.*?)\n---", 1), rf"(?m)^{key}:\s*['\"]?([^'\"\n]+)", 1))
    first = notebook_sections(docs).groupBy("doc_id").agg(F.min_by("title", "ord").alias("_first"))
    stem = F.initcap(F.regexp_replace(F.regexp_extract(F.col("doc_id").cast("string"), r"([^/]*?)(?:\.ipynb)?$", 1), "[_-]", " "))
    some = lambda x: F.nullif(x, F.lit(""))
    j = docs.select("doc_id").join(lead, "doc_id", "left").join(first, "doc_id", "left")
    h1 = F.trim(F.regexp_extract("_lead", r"(?m)^#[ \t]+(.+)$", 1))
    return j.select("doc_id", F.coalesce(some(field("title")), some(h1), "_first", stem).alias("title"), F.coalesce(field("authors?"), F.lit("")).alias("authors"))


def notebook_pictures(docs: DataFrame, least_px: int = LEAST["notebook"]) -> DataFrame:
    """doc_id, figure_id, cell, kind, content (bytes), width, height: pictures of outputs, PNG before JPEG, those below `least_px` left out (unknown sizes stay) without a number."""
    o = notebook_cells(docs).select("doc_id", "cell", F.posexplode("outputs").alias("n", "o")).where("o.kind in ('display_data', 'execute_result')")
    coded = lambda mime: F.nullif(F.regexp_replace(F.coalesce(F.array_join(F.from_json(F.col("o.data")[mime], "array<string>"), ""), F.col("o.data")[mime]), r"\s+", ""), F.lit(""))
    raw = F.coalesce(F.when(coded("image/png").isNotNull(), F.struct(F.lit("png").alias("kind"), F.try_to_binary(coded("image/png"), F.lit("base64")).alias("content"))),
                     F.when(coded("image/jpeg").isNotNull(), F.struct(F.lit("jpg").alias("kind"), F.try_to_binary(coded("image/jpeg"), F.lit("base64")).alias("content"))))
    p = o.withColumn("p", raw).where("p.content is not null").select("doc_id", "cell", "n", "p.kind", "p.content", F.col("p.content").alias("_data"))
    s = sized(p, "_data", ("doc_id", "cell", "n", "kind", "content")).where(media.large_enough(F.col("width"), F.col("height"), least_px, None))
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("cell", "n"))
    return s.select("doc_id", F.concat(F.lit("fig_"), no.cast("string")).alias("figure_id"), "cell", "kind", "content", "width", "height")


# One call for all formats

SECTION = ["doc_id", "ord", "title", "section_type", "content", "word_count"]
OWN_KINDS = ["markdown", "latex", "notebook", "html", "docx", "pptx", "video"]


def vtt_sections(docs: DataFrame) -> DataFrame:
    """A transcript as sections: labels by time, moved on by phrases, never back; runs of a label, short ones merged."""
    segs = transcripts.parse_vtt(docs)
    shared = transcripts.with_share(segs.withColumn("ord", F.col("seg_no")), "doc_id")
    t = shared.withColumn("idx", transcripts.advanced(transcripts.label_index(F.col("share")), F.col("text")))
    t = transcripts.monotone(t, "doc_id", ["seg_no"]).withColumn("label", F.get(F.array(*map(F.lit, transcripts.LABELS)), F.col("idx")))
    r = transcripts.runs(t, "doc_id", ["seg_no"], "label").groupBy("doc_id", "run").agg(F.first("label").alias("label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"]), " ").alias("content"))
    s = transcripts.merge_short(r.withColumn("content", T.clean_speech(F.col("content"))), "doc_id", "run")
    return s.select("doc_id", F.col("section_no").alias("ord"), "title", T.section_type(F.col("title")).alias("section_type"), "content", "word_count")


def parse(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], list[tuple[str, int, str]]]] | None = None, errors: bool = True) -> DataFrame:
    """Sections (SECTION) of all files under a folder, each read by its extension; `decoders` adds formats (pdf) or replaces the readers of docx and pptx. With `errors`, files of
    other kinds, damaged ones and those without any section give one row of section_type error, whose title says why (files of no bytes are not listed)."""
    mine = decoders or {}
    html = lambda: S.split_headers(pages.read_pages(spark, path).select("doc_id", "text"))
    readers = {"markdown": lambda: S.split_headers(whole(spark, path, "markdown")), "latex": lambda: latex_sections(whole(spark, path, "latex"), with_abstract=True), "notebook": lambda: notebook_sections(whole(spark, path, "notebook")),
               "html": html, "video": lambda: vtt_sections(whole(spark, path, "video")), "docx": lambda: office.read_docx(spark, path)["sections"], "pptx": lambda: office.deck_sections(spark, path)}
    readers |= {kind: (lambda k=kind, f=decode: block_sections(read_binary(spark, path, k, f))) for kind, decode in mine.items()}
    typed = [F.col("ord").cast("long").alias("ord") if c == "ord" else F.col("word_count").cast("long").alias("word_count") if c == "word_count" else F.col(c) for c in SECTION]
    out = None
    for read in readers.values():
        p = read().select(*typed)
        out = p if out is None else out.unionByName(p)
    if not errors:
        return out
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("doc_id"))
    kind = F.coalesce(T.source_format(F.col("doc_id")), F.lit(""))
    known = kind.isin(list(readers))
    why = F.when(known, "no sections").otherwise(F.concat(F.lit("no reader for "), F.coalesce(F.nullif(F.lower(F.regexp_extract("doc_id", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("files without extension"))))
    lost = files.join(out.select("doc_id").distinct(), "doc_id", "left_anti")
    bad = lost.select("doc_id", F.lit(0).cast("long").alias("ord"), why.alias("title"), F.lit("error").alias("section_type"), F.lit("").alias("content"), F.lit(0).cast("long").alias("word_count"))
    return out.unionByName(bad)


def plain_title(text: Column, named: Column) -> Column:
    """The title of text without marked fields: the named one, else the first line without header marks if it is below 200 characters."""
    line = T.strip(F.element_at(F.split(T.strip(F.coalesce(text, F.lit(""))), "\n"), 1))
    line = F.regexp_replace(line, r"^#+\s*", "")
    return F.coalesce(F.nullif(named, F.lit("")), F.when(F.length(line) < 200, line), F.lit("Untitled Document"))


# Fixed value: a line that begins a list of names.
NAMES = r"[A-Z][a-z]+\s+[A-Z][a-z]+.*,"


def plain_authors(text: Column, most: int = 10) -> Column:
    """The names in the first of the 20 leading lines that holds two capitalised words and then a comma; marks and digits go, names of three characters or fewer too."""
    lines = F.slice(F.split(T.strip(F.coalesce(text, F.lit(""))), "\n"), 1, 20)
    named = F.filter(lines, lambda x: F.rlike(x, F.lit(NAMES)))
    names = lambda x: F.filter(F.transform(F.split(F.regexp_replace(x, r"\*+|\d+", ""), r",|\s+and\s+"), lambda a: T.strip(a)), lambda a: F.length(a) > 3)
    found = F.filter(F.transform(named, names), lambda a: F.size(a) > 0)
    return F.slice(F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>")), 1, most)
