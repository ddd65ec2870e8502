"""Office packages (DOCX, PPTX) as tables.

Each file is opened once, on the executors, and its parts are flattened to elements: (doc_id, part, n, kind, a), a row for each run, shape, style, relationship, chart
point and so on, its fields in the map `a`. All that follows are joins and windows over elements: relationships lead from slides and paragraphs to media, charts, notes and
layouts; run formats are resolved through style chains. A damaged file gives one element of kind error.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import media as M
from ..functions import text as T
from ..operators import headings as H
from ..operators import slides as S
from ..operators import visuals as V
from .images import LEAST, image_size

_ROOT = "http://schemas.openxmlformats.org/"
W, D, P, C = (f"{{{_ROOT}{x}}}" for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "presentationml/2006/main", "drawingml/2006/chart"))
R = f"{{{_ROOT}officeDocument/2006/relationships}}"
KIND = pa.map_(pa.string(), pa.string())
Element = tuple[str, dict[str, str | None]]


# Parts to elements

def switch(e: ET.Element | None) -> str | None:
    """A toggle such as bold: on unless it says otherwise, null if it is not there."""
    return None if e is None else "false" if e.get(f"{W}val", "true").lower() in ("0", "false", "off", "none") else "true"


def half_points(e: ET.Element | None) -> str | None:
    return None if e is None or not e.get(f"{W}val", "").isdigit() else str(int(e.get(f"{W}val")) / 2)


def word_text(e: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" for x in e.iter() if x.tag in (f"{W}t", f"{W}br") or x.tag == f"{W}tab" and not x.attrib)


def word_document(root: ET.Element) -> Iterator[Element]:
    body = root.find(f"{W}body")
    for block, e in enumerate(body if body is not None else (), 1):
        at = {"block": str(block)}
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            yield "paragraph", at | {"style": style.get(f"{W}val") if style is not None else None, "bullet": "false" if e.find(f"{W}pPr/{W}numPr") is None else "true", "text": word_text(e)}
            for i, r in enumerate(e.iter(f"{W}r"), 1):
                rs = r.find(f"{W}rPr/{W}rStyle")
                yield "run", at | {"run": str(i), "style": rs.get(f"{W}val") if rs is not None else None, "bold": switch(r.find(f"{W}rPr/{W}b")), "size": half_points(r.find(f"{W}rPr/{W}sz")), "text": word_text(r)}
            for b in e.iter(f"{D}blip"):
                yield "picture", at | {"rid": b.get(f"{R}embed")}
        elif e.tag == f"{W}tbl":
            yield "table", at
            for i, row in enumerate(e.findall(f"{W}tr"), 1):
                for j, cell in enumerate(row.findall(f"{W}tc"), 1):
                    yield "cell", at | {"row": str(i), "col": str(j), "text": "\n".join(word_text(p) for p in cell.findall(f"{W}p")).strip()}


def word_styles(root: ET.Element) -> Iterator[Element]:
    own = lambda e: {"bold": switch(e.find(f"{W}rPr/{W}b")), "size": half_points(e.find(f"{W}rPr/{W}sz"))}
    for d in root.iter(f"{W}rPrDefault"):
        yield "defaults", own(d)
    for s in root.findall(f"{W}style"):
        name, base = s.find(f"{W}name"), s.find(f"{W}basedOn")
        yield "style", own(s) | {"id": s.get(f"{W}styleId"), "type": s.get(f"{W}type"), "default": s.get(f"{W}default", "0"), "name": name.get(f"{W}val") if name is not None else "", "base": base.get(f"{W}val") if base is not None else None}


def core_properties(root: ET.Element) -> Iterator[Element]:
    said = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in root}
    yield "properties", {"title": said.get("title"), "author": said.get("creator")}


def relationships(root: ET.Element, part: str) -> Iterator[Element]:
    """Relationships of the part that this one belongs to; targets as paths of the package."""
    folder, name = posixpath.split(part)
    source = posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))
    for e in root:
        target = e.get("Target", "")
        path = target if e.get("TargetMode") == "External" else target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(source), target))
        yield "relationship", {"source": source, "id": e.get("Id"), "type": e.get("Type", "").rpartition("/")[2], "target": path}


def place(e: ET.Element, frame: tuple[float, float, float, float]) -> dict[str, str | None]:
    """Position and size on the slide; a group's children are scaled and moved by `frame` (x and y factor, x and y offset)."""
    x = next((x for x in e.iter() if x.tag in (f"{D}xfrm", f"{P}xfrm")), None)
    off, ext = (x.find(f"{D}off"), x.find(f"{D}ext")) if x is not None else (None, None)
    if off is None or ext is None:
        return {"left": None, "top": None, "width": None, "height": None}
    fx, fy, dx, dy = frame
    return {"left": str(round(int(off.get("x")) * fx + dx)), "top": str(round(int(off.get("y")) * fy + dy)), "width": str(round(int(ext.get("cx")) * fx)), "height": str(round(int(ext.get("cy")) * fy))}


def inner_frame(group: ET.Element, frame: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    x = group.find(f"{P}grpSpPr/{D}xfrm")
    if x is None or any(x.find(f"{D}{t}") is None for t in ("off", "ext", "chOff", "chExt")):
        return frame
    n = lambda t, k: int(x.find(f"{D}{t}").get(k))
    sx, sy = n("ext", "cx") / (n("chExt", "cx") or 1), n("ext", "cy") / (n("chExt", "cy") or 1)
    fx, fy, dx, dy = frame
    return fx * sx, fy * sy, (n("off", "x") - n("chOff", "x") * sx) * fx + dx, (n("off", "y") - n("chOff", "y") * sy) * fy + dy


def shape_lines(e: ET.Element) -> tuple[str, bool]:
    lines, bullets = [], False
    for p in e.iter(f"{D}p"):
        text = "".join(x.text or "" if x.tag == f"{D}t" else "\v" for x in p.iter() if x.tag in (f"{D}t", f"{D}br")).strip()
        ppr = p.find(f"{D}pPr")
        deep = ppr is not None and int(ppr.get("lvl", "0")) > 0
        bullets |= deep
        lines += [("- " if deep else "") + text] if text else []
    return "\n".join(lines), bullets


def slide_shapes(tree: ET.Element, frame: tuple[float, float, float, float] = (1, 1, 0, 0)) -> Iterator[Element]:
    for e in tree:
        if e.tag == f"{P}grpSp":
            yield from slide_shapes(e, inner_frame(e, frame))
        elif e.tag == f"{P}sp":
            ph = e.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            marks = {} if ph is None else {"ph": ph.get("type", "obj"), "idx": ph.get("idx", "0")}
            text, bullets = shape_lines(e)
            sizes = [int(r.get("sz")) / 100 for r in e.iter(f"{D}rPr") if r.get("sz", "").isdigit()]
            colours = ",".join(c.get("val", "") for r in e.iter(f"{D}rPr") for c in r.findall(f"{D}solidFill/{D}srgbClr"))
            yield "shape", place(e, frame) | marks | {"text": text, "bullets": str(bullets).lower(), "font": str(max(sizes, default=12.0)), "colours": colours}
        elif e.tag == f"{P}pic":
            blip = next(e.iter(f"{D}blip"), None)
            if blip is not None:
                yield "picture", place(e, frame) | {"rid": blip.get(f"{R}embed")}
        elif e.tag == f"{P}graphicFrame":
            chart = next(e.iter(f"{C}chart"), None)
            if chart is not None:
                yield "chart_ref", place(e, frame) | {"rid": chart.get(f"{R}id")}


def slide(root: ET.Element) -> Iterator[Element]:
    fill = root.find(f"{P}cSld/{P}bg/{P}bgPr/{D}solidFill/{D}srgbClr")
    yield "slide", {"background": fill.get("val") if fill is not None else "FFFFFF"}
    tree = root.find(f"{P}cSld/{P}spTree")
    yield from slide_shapes(tree if tree is not None else ())


def presentation(root: ET.Element) -> Iterator[Element]:
    size = root.find(f"{P}sldSz")
    yield "deck", {"width": size.get("cx") if size is not None else None, "height": size.get("cy") if size is not None else None}
    for e in root.iter(f"{P}sldId"):
        yield "slide_ref", {"rid": e.get(f"{R}id")}


def notes(root: ET.Element) -> Iterator[Element]:
    for sp in root.iter(f"{P}sp"):
        ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
        if ph is not None and ph.get("type") == "body":
            yield "notes", {"text": "\n".join("".join(t.text or "" for t in p.iter(f"{D}t")) for p in sp.iter(f"{D}p"))}


def chart(root: ET.Element) -> Iterator[Element]:
    """The title and the points of the first plot: series by number, categories and values by index (ragged series keep their holes)."""
    yield "chart", {"title": "".join(t.text or "" for x in root.findall(f"{C}chart/{C}title") for t in x.iter(f"{D}t")).strip()}
    area = root.find(f"{C}chart/{C}plotArea")
    plot = next((e for e in (area if area is not None else ()) if e.tag.endswith("Chart")), None)
    for i, s in enumerate(plot.findall(f"{C}ser") if plot is not None else (), 1):
        name = next((v.text for x in s.findall(f"{C}tx") for v in x.iter(f"{C}v")), None)
        counts = {tag: next((n.get("val") for x in s.findall(f"{C}{tag}") for n in x.iter(f"{C}ptCount")), None) for tag in ("cat", "val")}
        yield "series", {"series": str(i), "name": name or f"Series {i}", "categories": counts["cat"], "values": counts["val"]}
        for tag, kind in (("cat", "category"), ("val", "value")):
            for x in s.findall(f"{C}{tag}"):
                for pt in x.iter(f"{C}pt"):
                    v = pt.find(f"{C}v")
                    text = v.text if v is not None else None
                    yield kind, {"series": str(i), "idx": pt.get("idx"), "text": text if kind == "category" or text is None else str(round(float(text), 4))}


def elements_of(data: bytes) -> Iterator[tuple[str, int, str, dict]]:
    """(part, n, kind, a) of a package."""
    readers = {"word/document.xml": word_document, "word/styles.xml": word_styles, "docProps/core.xml": core_properties, "ppt/presentation.xml": presentation}
    folders = {"ppt/slides": slide, "ppt/slideLayouts": slide, "ppt/slideMasters": slide, "ppt/notesSlides": notes, "ppt/charts": chart}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in z.namelist():
            folder = posixpath.dirname(part)
            if part.endswith(".rels"):
                found = relationships(ET.fromstring(z.read(part)), part)
            elif folder.endswith("/media"):
                w, h = image_size(z.read(part)) or (None, None)
                found = iter([("media", {"width": w and str(w), "height": h and str(h)})])
            elif part.endswith(".xml") and (f := readers.get(part) or folders.get(folder)):
                found = f(ET.fromstring(z.read(part)))
            else:
                continue
            for n, (kind, a) in enumerate(found, 1):
                yield part, n, kind, a


def elements(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """doc_id (the file's path), part, n, kind, a."""
    names, rows_a_batch = ["doc_id", "part", "n", "kind", "a"], 5000

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), KIND]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for p, data in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                try:
                    for part, n, kind, a in elements_of(data.as_buffer().to_pybytes()):
                        rows.append((p.as_py(), part, n, kind, list(a.items())))
                except Exception as e:  # noqa: BLE001  a damaged file must not end the job, nor half of it pass for the whole
                    rows = [(p.as_py(), "", 1, "error", [("message", str(e)[:200])])]
                for i in range(0, len(rows), rows_a_batch):
                    yield batch_of(rows[i : i + rows_a_batch])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "doc_id string, part string, n int, kind string, a map<string,string>")


# Elements to tables

def of_kind(e: DataFrame, kind: str, **fields: str) -> DataFrame:
    """doc_id, part, n and the named fields of the elements of a kind, cast."""
    return e.where(F.col("kind") == kind).select("doc_id", "part", "n", *[F.col("a")[f].cast(t).alias(f) for f, t in fields.items()])


def related(e: DataFrame, rows: DataFrame, kind: str | None = None) -> DataFrame:
    """rows(doc_id, part, rid) with the part that rid leads to, as `target`."""
    r = of_kind(e, "relationship", source="string", id="string", type="string", target="string")
    r = r.where(F.col("type") == kind) if kind else r
    return rows.join(r.select("doc_id", F.col("source").alias("part"), F.col("id").alias("rid"), "target"), ["doc_id", "part", "rid"])


def effective_styles(e: DataFrame) -> DataFrame:
    """doc_id, id, name, type, default, bold, size: each style's own format, else that of the style it is based on, and so on, else the document's. A chain is followed for as many
    steps as the document has styles, so a circle ends."""
    s = of_kind(e, "style", id="string", name="string", type="string", default="string", base="string", bold="boolean", size="double")
    base = of_kind(e, "defaults", bold="boolean", size="double").groupBy("doc_id").agg(F.max("bold").alias("d_bold"), F.max("size").alias("d_size"))
    g = s.groupBy("doc_id").agg(F.collect_list(F.struct("id", "name", "type", "default", "base", "bold", "size")).alias("styles")).join(base, "doc_id", "left")
    known = F.map_from_entries(F.transform(F.array_distinct(F.transform("styles", lambda x: x["id"])), lambda i: F.struct(i, F.element_at(F.filter("styles", lambda x: x["id"] == i), 1))))

    def resolved(x: Column) -> Column:
        start = F.struct(x["base"].alias("next"), x["bold"].alias("bold"), x["size"].alias("size"))
        step = lambda st, _: A.let(F.try_element_at("known", st["next"]), lambda b: F.struct(b["base"].alias("next"), F.coalesce(st["bold"], b["bold"]).alias("bold"), F.coalesce(st["size"], b["size"]).alias("size")))
        return F.aggregate("styles", start, step)

    full = F.transform("styles", lambda x: A.let(resolved(x), lambda r: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["type"].alias("type"), (x["default"].isin("1", "true")).alias("default"),
                                                                             F.coalesce(r["bold"], F.col("d_bold"), F.lit(False)).alias("bold"), F.coalesce(r["size"], F.col("d_size")).alias("size"), r["bold"].alias("own_bold"), r["size"].alias("own_size"))))
    return g.withColumn("known", known).select("doc_id", F.inline(full))


def docx_paragraphs(e: DataFrame) -> DataFrame:
    """doc_id, block, style (its name), bullet, text, runs: the paragraphs of a document with their runs as (text, bold, size), formats resolved: the run's own, its character
    style's, the paragraph style's, the document's."""
    p = of_kind(e, "paragraph", block="int", style="string", bullet="boolean", text="string")
    r = of_kind(e, "run", block="int", run="int", style="string", bold="boolean", size="double", text="string")
    st = effective_styles(e)
    char = st.where("type = 'character'").select("doc_id", F.col("id").alias("style"), F.col("own_bold").alias("c_bold"), F.col("own_size").alias("c_size"))
    r = r.join(char, ["doc_id", "style"], "left").select("doc_id", "block", F.struct("run", "text", F.coalesce("bold", "c_bold").alias("bold"), F.coalesce("size", "c_size").alias("size")).alias("r"))
    r = r.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    paragraph = st.where("type = 'paragraph'")
    named = paragraph.select("doc_id", F.col("id").alias("style"), F.col("name").alias("p_name"), F.col("bold").alias("p_bold"), F.col("size").alias("p_size"))
    plain = paragraph.where("default").groupBy("doc_id").agg(F.min("name").alias("n_name"), F.min("bold").alias("n_bold"), F.min("size").alias("n_size"))
    own = of_kind(e, "defaults", bold="boolean", size="double").groupBy("doc_id").agg(F.max("bold").alias("o_bold"), F.max("size").alias("o_size"))
    j = p.join(named, ["doc_id", "style"], "left").join(plain, "doc_id", "left").join(own, "doc_id", "left").join(r, ["doc_id", "block"], "left")
    bold, size = F.coalesce("p_bold", "n_bold", "o_bold", F.lit(False)), F.coalesce("p_size", "n_size", "o_size")
    runs = F.transform(F.coalesce("runs", F.array().cast("array<struct<run:int,text:string,bold:boolean,size:double>>")), lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["bold"], bold).alias("bold"), F.coalesce(x["size"], size).alias("size")))
    return j.select("doc_id", "block", F.coalesce("p_name", "n_name", F.lit("")).alias("style"), "bullet", T.strip(F.col("text")).alias("text"), runs.alias("runs"))


def docx_tables(e: DataFrame) -> DataFrame:
    """doc_id, block, no, content: tables in order as Markdown; rows without text go, and a table of such rows too, but its number stays taken."""
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("block"))
    t = of_kind(e, "table", block="int").select("doc_id", "block").withColumn("no", no)
    c = of_kind(e, "cell", block="int", row="int", col="int", text="string")
    rows = c.groupBy("doc_id", "block", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells")).where(F.exists("cells", lambda x: x != ""))
    full = rows.groupBy("doc_id", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    return t.join(full, ["doc_id", "block"]).select("doc_id", "block", "no", markdown_table(F.col("rows")).alias("content"))


def markdown_table(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.size(F.element_at(rows, 1))), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(F.element_at(rows, 1)), rule, F.transform(F.slice(rows, F.lit(2), F.size(rows)), line))


def media(e: DataFrame, pictures: DataFrame) -> DataFrame:
    """pictures(doc_id, part, rid, ...) with the media part, its width and height in pixels (null if unknown)."""
    sizes = of_kind(e, "media", width="int", height="int").select("doc_id", F.col("part").alias("target"), F.col("width").alias("px_width"), F.col("height").alias("px_height"))
    return related(e, pictures).join(sizes, ["doc_id", "target"])


def docx_pictures(e: DataFrame) -> DataFrame:
    """doc_id, block, no, path, px_width, px_height: pictures of paragraphs in order."""
    p = media(e, of_kind(e, "picture", block="int", rid="string"))
    return p.select("doc_id", "block", F.row_number().over(Window.partitionBy("doc_id").orderBy("n")).alias("no"), F.col("target").alias("path"), "px_width", "px_height")


def slide_parts(e: DataFrame) -> DataFrame:
    """doc_id, part, slide (from 0, in the deck's order), deck_width, deck_height, background (red, green, blue)."""
    order = related(e, of_kind(e, "slide_ref", rid="string")).select("doc_id", F.col("target").alias("part"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).alias("slide"))
    size = of_kind(e, "deck", width="long", height="long").select("doc_id", F.col("width").alias("deck_width"), F.col("height").alias("deck_height"))
    fill = of_kind(e, "slide", background="string").select("doc_id", "part", channels(F.col("background")).alias("background"))
    return order.join(fill, ["doc_id", "part"]).join(size, "doc_id", "left")


def channels(hex_colour: Column) -> Column:
    return F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substring(hex_colour, i, F.lit(2)), 16, 10).cast("int"))


PLACE = ["left", "top", "width", "height"]


def pptx_shapes(e: DataFrame) -> DataFrame:
    """The shapes that `slides.shown` and `slides.slides` take: deck, slide, shape_no, text, left, top, width, height, font, is_title, bullets, colours, background, deck_width,
    deck_height. A placeholder without a place of its own has that of its slide's layout (by index, then kind), then of the layout's master (by kind)."""
    fields = {c: "long" for c in PLACE} | {"ph": "string", "idx": "string", "text": "string", "bullets": "boolean", "font": "double", "colours": "string"}
    s = of_kind(e, "shape", **fields)
    rel = of_kind(e, "relationship", source="string", type="string", target="string").select("doc_id", F.col("source").alias("part"), "type", "target")
    parts = slide_parts(e)
    layout = rel.where("type = 'slideLayout'").groupBy("doc_id", "part").agg(F.min("target").alias("layout"))
    master = rel.where("type = 'slideMaster'").groupBy("doc_id", F.col("part").alias("layout")).agg(F.min("target").alias("master"))
    j = s.join(parts, ["doc_id", "part"]).join(layout, ["doc_id", "part"], "left").join(master, ["doc_id", "layout"], "left")
    kind = F.when(F.col("ph").isin("title", "ctrTitle"), "title").otherwise(F.col("ph"))
    placed = s.where("ph is not null and width is not null")
    spot = F.min(F.struct("n", *PLACE))

    def spots(by: list[Column], name: str) -> DataFrame:
        return placed.groupBy("doc_id", *by).agg(spot.alias(name))

    j = j.withColumn("ph_kind", kind)
    j = j.join(spots([F.col("part").alias("layout"), "idx"], "by_idx"), ["doc_id", "layout", "idx"], "left")
    j = j.join(spots([F.col("part").alias("layout"), kind.alias("ph_kind")], "by_kind"), ["doc_id", "layout", "ph_kind"], "left")
    j = j.join(spots([F.col("part").alias("master"), kind.alias("ph_kind")], "by_master"), ["doc_id", "master", "ph_kind"], "left")
    where = [F.coalesce(c, *[F.when(F.col("ph").isNotNull(), F.col(f"{x}.{c}")) for x in ("by_idx", "by_kind", "by_master")]).alias(c) for c in PLACE]
    title = F.coalesce(F.col("ph").isin("title", "ctrTitle") | ((F.col("idx") == "0") & F.col("ph").isNotNull()), F.lit(False))
    colours = F.transform(F.filter(F.split("colours", ","), lambda c: F.length(c) == 6), channels)
    return j.select(F.col("doc_id").alias("deck"), "slide", F.col("n").alias("shape_no"), "text", *where, "font", title.alias("is_title"), "bullets", F.lit(True).alias("marked"),
                    colours.alias("colours"), "background", "deck_width", "deck_height")


def pptx_notes(e: DataFrame) -> DataFrame:
    """deck, slide, notes."""
    rel = of_kind(e, "relationship", source="string", type="string", target="string").where("type = 'notesSlide'")
    said = of_kind(e, "notes", text="string").select("doc_id", F.col("part").alias("target"), "text")
    j = slide_parts(e).select("doc_id", "part", "slide").join(rel.select("doc_id", F.col("source").alias("part"), "target"), ["doc_id", "part"]).join(said, ["doc_id", "target"])
    return j.groupBy(F.col("doc_id").alias("deck"), "slide").agg(F.min("text").alias("notes"))


def pptx_pictures(e: DataFrame) -> DataFrame:
    """deck, slide, n, path, px_width, px_height, left, top, width, height."""
    p = media(e, of_kind(e, "picture", rid="string", **{c: "long" for c in PLACE}))
    return p.join(slide_parts(e).select("doc_id", "part", "slide"), ["doc_id", "part"]).select(F.col("doc_id").alias("deck"), "slide", "n", F.col("target").alias("path"), "px_width", "px_height", *PLACE)


def pptx_charts(e: DataFrame) -> DataFrame:
    """deck, slide, no, caption, content: charts as Markdown tables, a row a category and a column a series, holes empty. Without categories the first series' values are
    numbered; a chart without series or rows goes, but its number stays taken."""
    refs = related(e, of_kind(e, "chart_ref", rid="string")).join(slide_parts(e).select("doc_id", "part", "slide"), ["doc_id", "part"])
    refs = refs.select("doc_id", "slide", F.col("target").alias("part"), F.row_number().over(Window.partitionBy("doc_id").orderBy("slide", "n")).alias("no"))
    points = lambda kind: of_kind(e, kind, series="int", idx="int", text="string")
    names = of_kind(e, "series", series="int", name="string", categories="int", values="int").select("doc_id", "part", "series", "name", F.coalesce("categories", "values").alias("count"))
    values = points("value").groupBy("doc_id", "part", "series").agg(F.collect_list(F.struct("idx", "text")).alias("v"))
    series = names.join(values, ["doc_id", "part", "series"], "left").groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("series", "name", "count", "v"))).alias("ss"))
    labels = points("category").where("series = 1").groupBy("doc_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))).alias("labels"))
    titles = of_kind(e, "chart", title="string").select("doc_id", "part", "title")
    j = refs.join(series, ["doc_id", "part"]).join(labels, ["doc_id", "part"], "left").join(titles, ["doc_id", "part"], "left")
    first = F.element_at("ss", 1)
    last = F.coalesce(first["count"] - 1, F.array_max(F.map_keys("labels")), F.array_max(F.transform(first["v"], lambda x: x["idx"])))
    label = lambda i: F.when(F.col("labels").isNotNull(), F.coalesce(F.try_element_at("labels", i), F.lit(""))).otherwise((i + 1).cast("string"))
    cell = lambda s, i: F.coalesce(F.try_element_at(F.map_from_entries(s["v"]), i), F.lit(""))
    row = lambda i: F.concat(F.array(label(i)), F.transform("ss", lambda s: cell(s, i)))
    rows = F.concat(F.array(F.concat(F.array(F.lit("Category")), F.transform("ss", lambda s: s["name"]))), F.transform(F.sequence(F.lit(0), last), row))
    j = j.where(last >= 0).withColumn("rows", rows)
    caption = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chart "), F.col("no").cast("string"), F.lit(" (slide "), (F.col("slide") + 1).cast("string"), F.lit(")")))
    return j.select(F.col("doc_id").alias("deck"), "slide", "no", caption.alias("caption"), markdown_table(F.col("rows")).alias("content"))


# Documents

def read_docx(spark: SparkSession, path: str, least_px: int = LEAST["docx"]) -> dict[str, DataFrame]:
    """Tables of all DOCX files under a folder: documents (doc_id, title, authors), sections, figures (figure_id, section_id, path, caption), tables (table_id, section_id,
    caption, content), errors (doc_id, message). Elements are kept in the session's cache; `elements` gives them for a stage table of the caller's own."""
    e = elements(spark, path, "*.docx").persist()
    paragraphs = docx_paragraphs(e).persist()
    lines = H.outline(paragraphs)
    secs = H.sections(lines)
    props = of_kind(e, "properties", title="string", author="string").groupBy("doc_id").agg(F.max("title").alias("title"), F.max("author").alias("author"))
    pictures = docx_pictures(e).where(M.large_enough(F.col("px_width"), F.col("px_height"), least_px, None))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    blocks = paragraphs.select("doc_id", "block", F.lit("paragraph").alias("kind"), "text")
    blocks = blocks.unionByName(of_kind(e, "table", block="int").select("doc_id", "block", F.lit("table").alias("kind"), empty("text", "string")))
    w = Window.partitionBy("doc_id").orderBy("block").rowsBetween(1, 3)
    captions = V.captions_in(blocks, w).select("doc_id", "block", "caption")
    figures = H.carried(pictures.join(captions, ["doc_id", "block"], "left"), lines, secs)
    tables = H.carried(docx_tables(e), lines, secs)
    number = F.col("no").cast("string")
    return {"documents": H.heads(paragraphs, secs, props), "sections": secs, "errors": of_kind(e, "error", message="string").select("doc_id", "message"),
            "figures": figures.select("doc_id", F.concat(F.lit("fig_"), number).alias("figure_id"), "section_id", "path", F.coalesce("caption", F.lit("")).alias("caption")),
            "tables": tables.select("doc_id", F.concat(F.lit("table_"), number).alias("table_id"), "section_id", F.concat(F.lit("Table "), number).alias("caption"), "content")}


def read_pptx(spark: SparkSession, path: str, least_px: int = LEAST["pptx"]) -> dict[str, DataFrame]:
    """Tables of all PPTX files under a folder: documents (doc_id, title, authors, affiliation), slides (with notes in their content), sections, figures (figure_id, slide, path,
    caption), tables (table_id, slide, caption, content), errors."""
    e = elements(spark, path, "*.pptx").persist()
    shapes = pptx_shapes(e).persist()
    seen = S.shown(shapes, F.col("deck_width"), F.col("deck_height"))
    made = S.with_notes(S.every_slide(S.slides(seen), slide_parts(e).select(F.col("doc_id").alias("deck"), "slide")), pptx_notes(e))
    kept = pptx_pictures(e).join(made.where("kind <> 'title'").select("deck", "slide"), ["deck", "slide"]).where(M.large_enough(F.col("px_width"), F.col("px_height"), least_px, None))
    figures = S.captioned_pictures(kept, shapes).withColumn("no", F.row_number().over(Window.partitionBy("deck").orderBy("slide", "n")))
    charts = pptx_charts(e).join(made.where("kind <> 'title'").select("deck", "slide"), ["deck", "slide"])
    return {"documents": S.title_metadata(seen, made), "slides": made, "sections": S.sections(made), "errors": of_kind(e, "error", message="string").select("doc_id", "message"),
            "figures": figures.select("deck", F.concat(F.lit("fig_"), F.col("no").cast("string")).alias("figure_id"), "slide", "path", "caption"),
            "tables": charts.select("deck", F.concat(F.lit("table_"), F.col("no").cast("string")).alias("table_id"), "slide", "caption", "content")}


def deck_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of all PPTX files under a folder, as documents: doc_id, ord, title, section_type, content, word_count."""
    s = read_pptx(spark, path)["sections"]
    return s.select(F.col("deck").alias("doc_id"), F.col("section_no").alias("ord"), "title", T.section_type(F.col("title")).alias("section_type"), "content", T.word_count(F.col("content")).alias("word_count"))
