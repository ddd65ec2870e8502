"""Office packages made here, against walks over the same descriptions."""

import random
import re
import struct
import zipfile
from xml.sax.saxutils import escape

import pytest
from gleanery.operators import headings
from gleanery.sources import images, office

NS = ('xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
      'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"')
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


def rels(pairs):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}{t}" Target="{x}"/>' for i, t, x in pairs) + "</Relationships>"


# DOCX

STYLES = {  # id: (type, name, base, bold, size)
    "N": ("paragraph", "Normal", None, None, None), "B": ("paragraph", "Base", "N", True, 15.0), "Sub": ("paragraph", "Derived", "B", None, None), "Loop1": ("paragraph", "Loop one", "Loop2", None, None),
    "Loop2": ("paragraph", "Loop two", "Loop1", None, 9.0), "H1": ("paragraph", "heading 1", "B", None, None), "H2": ("paragraph", "Heading 2", "H1", False, None), "T": ("paragraph", "Title", None, True, 30.0),
    "Au": ("paragraph", "Authors", None, None, None), "Big": ("character", "Big", "Bigger", None, None), "Bigger": ("character", "Bigger", None, True, 22.0)}


def fmt(bold, size):
    return (f'<w:b w:val="{"1" if bold else "0"}"/>' if bold is not None else "") + (f'<w:sz w:val="{int(size * 2)}"/>' if size else "")


def write_docx(path, blocks, default_size, props=None):
    body, links = "", []
    for b in blocks:
        if b["kind"] == "table":
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in b["rows"]) + "</w:tbl>"
            continue
        ppr = (f'<w:pStyle w:val="{b["style"]}"/>' if b["style"] else "") + ("<w:numPr/>" if b["bullet"] else "")
        runs = ""
        for text, style, bold, size in b["runs"]:
            rpr = (f'<w:rStyle w:val="{style}"/>' if style else "") + fmt(bold, size)
            runs += f"<w:r><w:rPr>{rpr}</w:rPr><w:t>{escape(text)}</w:t></w:r>"
        for px in b.get("pictures", ()):
            links.append((f"rId{len(links) + 1}", px))
            runs += f'<w:r><w:drawing><a:blip r:embed="rId{len(links)}"/></w:drawing></w:r>'
        body += f"<w:p><w:pPr>{ppr}</w:pPr>{runs}</w:p>"
    styles = "".join(f'<w:style w:styleId="{i}" w:type="{t}"{" w:default=" + chr(34) + "1" + chr(34) if i == "N" else ""}><w:name w:val="{n}"/>{f"<w:basedOn w:val={chr(34)}{base}{chr(34)}/>" if base else ""}<w:rPr>{fmt(bold, size)}</w:rPr></w:style>' for i, (t, n, base, bold, size) in STYLES.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr>{fmt(None, default_size)}</w:rPr></w:rPrDefault></w:docDefaults>{styles}</w:styles>")
        z.writestr("word/_rels/document.xml.rels", rels([(i, "image", f"media/{i}.png") for i, _ in links]))
        for i, px in links:
            z.writestr(f"word/media/{i}.png", png(*px) if px else b"not a picture")
        if props:
            z.writestr("docProps/core.xml", f"<cp><title>{props[0]}</title><creator>{props[1]}</creator></cp>")


def chained(style, field, default):
    seen = set()
    while style in STYLES and style not in seen:
        seen.add(style)
        if STYLES[style][field] is not None:
            return STYLES[style][field]
        style = STYLES[style][2]
    return default


def walk(blocks, default_size, props):
    """Levels, sections, title, authors, figures and tables by going through the blocks once."""
    paras = []
    for at, b in enumerate(blocks, 1):
        if b["kind"] != "paragraph":
            continue
        style = b["style"] if b["style"] in STYLES else "N"
        text = "".join(r[0] for r in b["runs"]).strip()
        name = STYLES[style][1]
        sizes, bolds = [], []
        for t, rs, bold, size in b["runs"]:
            if t.strip():
                sizes.append(size or chained(rs, 4, None) or chained(style, 4, default_size))
                own = bold if bold is not None else chained(rs, 3, None)
                bolds.append(own if own is not None else chained(style, 3, False))
        paras.append({"at": at, "text": text, "name": name, "bullet": b["bullet"], "size": max((s for s in sizes if s), default=None), "bold": bool(bolds) and all(bolds), "caps": text.upper() == text and any(c.isalpha() for c in text), "styled": name.lower().startswith("heading")})
    levels = {p["at"]: int(m[0]) if (m := re.search(r"\d+", p["name"])) else 1 for p in paras if p["styled"]}
    if len(levels) < 2:
        pool = sorted(p["size"] for p in paras if len(p["text"].split()) >= 5 and not p["styled"] and not p["caps"] and p["size"])
        body = pool[len(pool) // 2] if pool else 11.0
        found = {p["at"]: p["size"] or body for p in paras if p["text"] and not p["bullet"] and ((p["caps"] and len(p["text"].split()) <= 8) or (p["bold"] and p["size"] and p["size"] >= body + 1))}
        ranks = sorted(set(found.values()), reverse=True)
        levels = {at: ranks.index(s) + 1 for at, s in found.items()}
    sections, no, current, number = [], 0, None, {}
    for p in paras:
        if p["at"] in levels:
            no += 1
            current = [no, p["text"] or f"Section {no}", levels[p["at"]], []]
            sections.append(current)
            number[p["at"]] = no
        elif current and p["text"]:
            current[3].append(p["text"])
    sections = [(n, t, lv, "\n".join(c)) for n, t, lv, c in sections if c]
    full = "\n".join(p["text"] for p in paras if p["text"])
    if not sections and full:
        sections = [(1, "Content", 1, full)]
    title = (props and props[0]) or next((p["text"] for p in paras[:10] if p["name"] == "Title" and p["text"]), None) or (sections[0][1] if sections else None) or next((p["text"][:200] for p in paras if p["text"]), "Untitled Document")
    authors = (props and props[1]) or next((p["text"] for p in paras[:12] if p["name"].lower() in ("author", "authors", "subtitle") and p["text"]), None)
    if not authors:
        at = next((i for i, p in enumerate(paras[:20]) if p["text"] and p["text"] == title), None)
        near = paras[at + 1 : at + 4] if at is not None else []
        authors = ", ".join(p["text"] for p in near if p["text"] and not p["styled"] and not p["bullet"] and not re.match(r"(?i)(abstract|introduction|results?)\b", p["text"]) and len(p["text"].split()) <= 20)
    have = {n for n, *_ in sections}
    first, current, figures, tables, f, t = (sections[0][0] if sections else None), None, [], [], 0, 0
    for i, b in enumerate(blocks, 1):
        current = number.get(i, current)
        at = current if current is not None else first
        at = f"section_{at}" if at in have else None
        if b["kind"] == "table":
            t += 1
            rows = [r for r in b["rows"] if any(r)]
            if rows:
                tables.append((f"table_{t}", at, "\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["| " + " | ".join(["---"] * len(rows[0])) + " |"] + ["| " + " | ".join(r) + " |" for r in rows[1:]])))
            continue
        for px in b.get("pictures", ()):
            f += 1
            if px and min(px) < 200:
                continue
            caption = ""
            for nxt in blocks[i : i + 3]:
                said = "".join(r[0] for r in nxt["runs"]).strip() if nxt["kind"] == "paragraph" else ""
                if said:
                    caption = said if re.match(r"(?i)(?:Figure|Fig\.?)\s*\d+[.:]", said) or (len(said.split()) <= 12 and said.lower().startswith("figure")) else ""
                    break
            figures.append((f"fig_{f}", at, caption))
    return {b: lv for b, lv in levels.items()}, sections, title, authors, figures, tables


def random_blocks(rng):
    words = ["plain", "Words", "results", "ABC", "deep", "Ünder"]
    out = []
    for _ in range(rng.randint(0, 25)):
        if rng.random() < 0.1:
            out.append({"kind": "table", "rows": [[rng.choice(["", "x", "long cell"]) for _ in range(2)] for _ in range(rng.randint(1, 3))]})
            continue
        text = rng.choice([" ".join(rng.choices(words, k=rng.randint(5, 9))), " ".join(rng.choices(words, k=rng.randint(1, 3))), "BIG TITLE", "", "Figure 3: it shows", "figure of a thing", "Introduction"])
        cut = rng.randint(0, len(text))
        run = lambda t: (t, rng.choice([None, None, None, "Big"]), rng.choice([None, None, True, False]), rng.choice([None, None, 10.0, 12.0, 16.0]))
        out.append({"kind": "paragraph", "style": rng.choice(["", "", "", "N", "B", "Sub", "Loop1", "T", "Au", "gone"] + (["H1", "H2"] if rng.random() < 0.3 else [])), "bullet": rng.random() < 0.1, "runs": [run(text[:cut]), run(text[cut:])],
                    "pictures": [rng.choice([(300, 250), (100, 500), None])] if rng.random() < 0.15 else []})
    return out


def test_docx_equals_a_walk(spark, tmp_path):
    rng = random.Random(9)
    made = {}
    for i in range(40):
        name, default, props = f"d{i:02}.docx", rng.choice([None, 11.0]), rng.choice([None, None, ("Given", ""), ("", "Someone")])
        made[name] = (random_blocks(rng), default, props)
        write_docx(tmp_path / name, *made[name])
    (tmp_path / "bad.docx").write_bytes(b"no package")
    got = office.read_docx(spark, str(tmp_path))
    of = lambda df, *cols: {(r["doc_id"].rpartition("/")[2], *(r[c] for c in cols)) for r in df.collect()}
    want = {n: walk(*m) for n, m in made.items()}
    e = office.elements(spark, str(tmp_path), "*.docx")
    assert of(headings.headings(office.docx_paragraphs(e)).where("level is not null"), "block", "level") == {(n, b, lv) for n, w in want.items() for b, lv in w[0].items()}
    assert of(got["sections"], "ord", "title", "level", "content") == {(n, *s) for n, w in want.items() for s in w[1]}
    assert of(got["documents"], "title", "authors") == {(n, w[2], w[3]) for n, w in want.items() if any(b["kind"] == "paragraph" for b in made[n][0])}
    assert of(got["figures"], "figure_id", "section_id", "caption") == {(n, *f) for n, w in want.items() for f in w[4]}
    assert of(got["tables"], "table_id", "section_id", "content") == {(n, *t) for n, w in want.items() for t in w[5]}
    assert [r["doc_id"].rpartition("/")[2] for r in got["errors"].collect()] == ["bad.docx"]


# PPTX

def box(x, y, w, h):
    return f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>' if x is not None else ""


def shape(text, x=None, y=None, w=3_000_000, h=500_000, size=None, ph=None, idx=None, colour=None, levels=()):
    mark = f'<p:ph{f" type={chr(34)}{ph}{chr(34)}" if ph else ""}{f" idx={chr(34)}{idx}{chr(34)}" if idx else ""}/>' if ph or idx else ""
    fill = f'<a:solidFill><a:srgbClr val="{colour}"/></a:solidFill>' if colour else ""
    paras = "".join(f'<a:p><a:pPr lvl="{levels[i] if i < len(levels) else 0}"/><a:r><a:rPr{f" sz={chr(34)}{size * 100}{chr(34)}" if size else ""}>{fill}</a:rPr><a:t>{escape(t)}</a:t></a:r></a:p>' for i, t in enumerate(text.split("\n")))
    return f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:spPr>{box(x, y, w, h)}</p:spPr><p:txBody>{paras}</p:txBody></p:sp>"


def test_pptx(spark, tmp_path):
    tree = lambda shapes, bg="": f"<p:sld {NS}><p:cSld>{bg}<p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
    pic = lambda rid, x, y: f'<p:pic><p:blipFill><a:blip r:embed="{rid}"/></p:blipFill><p:spPr>{box(x, y, 200_000, 200_000)}</p:spPr></p:pic>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="1000000" y="2000000"/><a:ext cx="2000000" cy="1000000"/><a:chOff x="0" y="0"/><a:chExt cx="4000000" cy="2000000"/></a:xfrm></p:grpSpPr>{shape("grouped", 400_000, 400_000, 800_000, 400_000)}</p:grpSp>'
    frame = '<p:graphicFrame><p:xfrm><a:off x="0" y="0"/><a:ext cx="9" cy="9"/></p:xfrm><a:graphic><a:graphicData><c:chart r:id="rC"/></a:graphicData></a:graphic></p:graphicFrame>'
    notes = " ".join(f"word{i}" for i in range(31))
    ser = lambda name, cats, vals, n: f'<c:ser>{f"<c:tx><c:v>{name}</c:v></c:tx>" if name else ""}<c:cat><c:strCache><c:ptCount val="{n}"/>{"".join(f"<c:pt idx={chr(34)}{i}{chr(34)}><c:v>{v}</c:v></c:pt>" for i, v in cats)}</c:strCache></c:cat><c:val><c:numCache>{"".join(f"<c:pt idx={chr(34)}{i}{chr(34)}><c:v>{v}</c:v></c:pt>" for i, v in vals)}</c:numCache></c:val></c:ser>'
    chart = f'<c:chartSpace {NS}><c:chart><c:title><a:t>Sales </a:t><a:t>2020</a:t></c:title><c:plotArea><c:layout/><c:barChart>{ser("A", [(0, "q1"), (2, "q3")], [(0, "1"), (1, "2.123456")], 3)}{ser("", [], [(2, "7.5")], 3)}</c:barChart></c:plotArea></c:chart></c:chartSpace>'
    with zipfile.ZipFile(tmp_path / "deck.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldSz cx="9000000" cy="6000000"/><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r3"/><p:sldId r:id="r2"/><p:sldId r:id="r4"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels([("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "/ppt/slides/slide2.xml"), ("r3", "slide", "slides/slide3.xml"), ("r4", "slide", "slides/slide4.xml")]))
        z.writestr("ppt/slides/slide1.xml", tree(shape("On Things", ph="ctrTitle", size=40) + shape("Ann Lee, Bo Ray", 100, 2_000_000) + shape("University of X", 100, 3_000_000)))
        z.writestr("ppt/slides/slide2.xml", tree(shape("Second", 0, 100_000, ph="title", size=20) + shape("one\ntwo", 0, 1_000_000, levels=[0, 1]) + shape("ghost", 0, 4_000_000, colour="FEFEFE") + shape("small", 0, 5_000_000, w=5000) + shape("far", 8_000_000, 0)
                                                  + group + pic("rP", 1_600_000, 2_500_000) + pic("rQ", 0, 0) + frame))
        z.writestr("ppt/slides/slide3.xml", tree(shape("Part A", 0, 0, size=30)))
        z.writestr("ppt/slides/slide4.xml", tree("", '<p:bg><p:bgPr><a:solidFill><a:srgbClr val="000000"/></a:solidFill></p:bgPr></p:bg>'))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels([("rL", "slideLayout", "../slideLayouts/l1.xml")]))
        z.writestr("ppt/slides/_rels/slide2.xml.rels", rels([("rP", "image", "../media/a.png"), ("rQ", "image", "../media/b.png"), ("rC", "chart", "../charts/c1.xml"), ("rN", "notesSlide", "../notesSlides/n2.xml")]))
        z.writestr("ppt/slideLayouts/l1.xml", tree(shape("", 500_000, 600_000, ph="title")))
        z.writestr("ppt/notesSlides/n2.xml", f"<p:notes {NS}><p:cSld><p:spTree>{shape(notes, ph='body')}{shape('7', ph='sldNum')}</p:spTree></p:cSld></p:notes>")
        z.writestr("ppt/charts/c1.xml", chart)
        z.writestr("ppt/media/a.png", png(400, 300))
        z.writestr("ppt/media/b.png", png(400, 30))
    got = office.read_pptx(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in got["documents"].collect()] == [("On Things", "Ann Lee, Bo Ray", "University of X")]
    slides = [(r["slide"], r["title"], r["kind"], r["content"]) for r in got["slides"].orderBy("slide").collect()]
    assert slides == [(0, "On Things", "title", "Ann Lee, Bo Ray\nUniversity of X"), (1, "Part A", "content", ""), (2, "Second", "content", f"one\n- two\ngrouped\n\n[Presenter Notes]\n{notes}"), (3, "Slide 4", "content", "")]
    assert [(r["slide"], r["text"], r["left"], r["top"], r["width"]) for r in office.pptx_shapes(office.elements(spark, str(tmp_path), "*.pptx")).where("text in ('grouped', 'On Things')").orderBy("slide").collect()] == [(0, "On Things", 500_000, 600_000, 3_000_000), (2, "grouped", 1_200_000, 2_200_000, 400_000)]
    assert [tuple(r)[1:] for r in got["figures"].collect()] == [("fig_1", 2, "ppt/media/a.png", "grouped")]
    table = "| Category | A | Series 2 |\n| --- | --- | --- |\n| q1 | 1.0 |  |\n|  | 2.1235 |  |\n| q3 |  | 7.5 |"
    assert [tuple(r)[1:] for r in got["tables"].collect()] == [("table_1", 2, "Sales 2020", table)]
    assert [(r["section_no"], r["title"]) for r in got["sections"].orderBy("section_no").collect()] == [(1, "Part A"), (2, "Second"), (3, "Slide 4")]


@pytest.mark.parametrize("data,want", [
    (png(7, 9), (7, 9)), (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4)), (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), (5, 6)), (b"", None), (b"\xff\xd8\xff", None), (b"\x89PNG\r\n\x1a\n", None),
    (b"\xff\xd8\xff\xe1" + struct.pack(">H", 300) + b"\xff\xc0" * 149 + b"\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", 11, 12), (12, 11)),
    (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), (100, 50)), (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 20, 30), (20, 30)),
    (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (19 | 9 << 14).to_bytes(4, "little"), (20, 10))])
def test_image_sizes(data, want):
    assert images.image_size(data) == want


def test_read_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(300, 20))
    (tmp_path / "b.jpg").write_bytes(b"broken")
    assert sorted((r["path"][-5:], r["width"], r["height"]) for r in images.read_images(spark, str(tmp_path)).collect()) == [("a.png", 300, 20), ("b.jpg", None, None)]
