"""LaTeX sources: head, sections, figures and tables, as expressions over a document's text.

Groups are read by one scan over brace positions with a running depth (no recursive pattern: those end the executor on long or unclosed groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T

BRACE, COMMENT = r"(?<!\\)[{}]", r"(?m)(?<!\\)%[^\n]*$"
HEADER = r"(?i)\\(?:sub){0,2}section\*?\s*\{"
# Environments that hold no prose, and those that float.
CODE, FLOAT = ["algorithm", "lstlisting", "verbatim"], ["figure", "table"]
# Commands that name an affiliation, in order of preference.
AFFILIATION = ["affiliation", "institute", "address", "institution"]


def environments(names: list[str]) -> str:
    either = "|".join(names)
    return rf"(?is)\\begin\{{(?:{either})\*?\}}(.*?)\\end\{{(?:{either})\*?\}}"


def group_length(rest: Column) -> Column:
    """Characters of `rest`, the text behind an opening brace, before the brace that closes it; null if none does."""
    plain = F.regexp_extract(rest, r"^([^{}\\]*+)\}", 1)
    marks = F.regexp_extract_all(rest, F.lit(BRACE), F.lit(0))
    depth = A.sums(F.transform(marks, lambda m: F.when(m == "{", 1).otherwise(-1)))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    before = lambda k: add(F.transform(F.slice(F.split(rest, BRACE, -1), F.lit(1), k), lambda p: F.length(p))) + k - 1
    nested = A.let(F.array_position(depth, F.lit(-1)).cast("int"), lambda k: F.when(k > 0, before(k)))
    return F.when(F.rlike(rest, F.lit(r"^[^{}\\]*+\}")), F.length(plain)).otherwise(nested)


def group(rest: Column) -> Column:
    """(inner, after) of the group that `rest` continues; an unclosed group ends with its line."""
    line = F.length(F.regexp_extract(rest, r"^[^\n]*+", 0))
    pieces = lambda r, n: F.struct(F.substring(r, F.lit(1), F.coalesce(n, line)).alias("inner"), F.substring(r, F.coalesce(n + 2, line + 1), F.length(r)).alias("after"))
    return A.let(group_length(rest), lambda n: pieces(rest, n))


def argument(text: Column, command: str) -> Column:
    """The first argument in braces of a command; empty if it is not there."""
    opening = rf"\\{command}\s*(?:\[[^\]]*\])?\s*\{{"
    rest = F.regexp_extract(text, rf"(?s){opening}(.*)$", 1)
    return F.when(F.rlike(text, F.lit(opening)), A.let(rest, lambda r: group(r)["inner"])).otherwise("")


def plain_source(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "")


def body(source: Column) -> Column:
    inner = F.regexp_extract(source, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    whole = F.regexp_replace(F.regexp_replace(source, r"(?s)^.*?\\begin\{document\}", ""), r"(?s)\\end\{document\}.*$", "")
    return F.when(inner != "", inner).otherwise(whole)


def abstract(text: Column) -> Column:
    return T.clean_latex(F.regexp_extract(text, r"(?is)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1))


def authors(raw: Column) -> Column:
    """Names between \\and and commas, cleaned after the split; notes, addresses and what follows a line break go, and what has more than eight words."""
    notes = r"(?s)\\thanks\s*\{(?:[^{}]|\{[^{}]*+\})*+\}"
    name = lambda a: F.trim(F.regexp_replace(T.clean_latex(F.regexp_replace(F.regexp_replace(a, notes, ""), r"(?s)\\\\.*$", "")), r"\S+@\S+", ""))
    return F.filter(F.transform(F.split(raw, r"\\(?:and|And|AND)\b|,"), name), lambda a: (a != "") & (T.word_count(a) <= 8))


def latex_head(docs: DataFrame) -> DataFrame:
    """doc_id, title (the file's name if the source has none), authors, affiliation, abstract of LaTeX source."""
    t = plain_source(F.col("text"))
    stem = F.initcap(F.regexp_replace(F.regexp_replace(F.regexp_extract(F.col("doc_id").cast("string"), r"([^/]*)$", 1), r"\.tex$", ""), "_", " "))
    named = F.coalesce(*[F.nullif(T.clean_latex(argument(F.col("_t"), c)), F.lit("")) for c in AFFILIATION], F.lit(""))
    d = docs.select("doc_id", t.alias("_t"))
    return d.select("doc_id", F.coalesce(F.nullif(T.clean_latex(argument(F.col("_t"), "title")), F.lit("")), stem).alias("title"), authors(argument(F.col("_t"), "author")).alias("authors"),
                    F.substring(named, 1, 200).alias("affiliation"), abstract(F.col("_t")).alias("abstract"))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, i, level, title, raw: a row for each section header (0: a source without headers), with all that stands up to the next."""
    t = F.regexp_replace(body(plain_source(F.col("text"))), environments(CODE), "")
    pieces = F.split(t, f"(?={HEADER})", -1)
    header = lambda p: F.regexp_extract(p, "^" + HEADER, 0)
    heads = F.filter(pieces, lambda p: F.rlike(p, F.lit("^" + HEADER)))

    def piece(p: Column) -> Column:
        h = header(p)
        level = ((F.length(h) - F.length(F.regexp_replace(h, "(?i)sub", ""))) / 3 + 1).cast("int")
        return A.let(group(F.substring(p, F.length(h) + 1, F.length(p))), lambda g: F.struct(level.alias("level"), T.clean_latex(g["inner"]).alias("title"), g["after"].alias("raw")))

    content = F.struct(F.lit(1).alias("level"), F.lit("Content").alias("title"), t.alias("raw"))
    found = F.when(F.size(heads) > 0, F.transform(heads, piece)).otherwise(F.array(content))
    return docs.select("doc_id", F.posexplode(found).alias("i", "p")).select("doc_id", (F.col("i") + 1).alias("i"), "p.*")


def numbered(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    d = rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))).drop("i")
    return d.withColumn("section_id", F.concat(F.lit("section_"), F.col("ord").cast("string"))).withColumn("section_type", T.section_type(F.col("title"))).withColumn("word_count", T.word_count(F.col("content")))


def latex_sections(docs: DataFrame, with_abstract: bool = False) -> DataFrame:
    """Sections of three levels: doc_id, ord, section_id, level, title, content, section_type, word_count. Comments, code and floats go before headers are sought; reference
    lists and sections without prose go. `with_abstract` puts the abstract before them."""
    listing = F.rlike("title", F.lit(r"(?i)\b(reference|bibliograph)\b"))
    d = parts(docs).select("doc_id", "i", "level", "title", T.clean_latex(F.regexp_replace(F.regexp_replace("raw", environments(FLOAT), ""), r"(?is)\\begin\{abstract\}.*?\\end\{abstract\}", "")).alias("content"))
    d = d.where((F.col("content") != "") & ~listing)
    if with_abstract:
        said = docs.select("doc_id", F.lit(0).alias("i"), F.lit(1).alias("level"), F.lit("Abstract").alias("title"), abstract(plain_source(F.col("text"))).alias("content"))
        d = said.where("content <> ''").unionByName(d)
    return numbered(d)


GRAPHIC = r"\\includegraphics\s*(?:\[[^\]]*\])?\{([^}]+)\}"


def latex_figures(docs: DataFrame) -> DataFrame:
    """doc_id, figure_id, path, caption, section (title of the last header before it; null before the first): a row for each graphic of a figure. Figures lie in the part that
    their header opens, so no join by position is needed."""
    rows = pre(docs).unionByName(parts(docs).select("doc_id", "i", "title", "raw"))
    envs = F.regexp_extract_all("raw", F.lit(environments(["figure"])), F.lit(1))
    figure = lambda e: F.transform(F.regexp_extract_all(e, F.lit(GRAPHIC), F.lit(1)), lambda g: F.struct(F.trim(g).alias("path"), T.clean_latex(argument(e, "caption")).alias("caption")))
    found = rows.select("doc_id", F.struct("i", "title", F.flatten(F.transform(envs, figure)).alias("figures")).alias("s")).where("size(s.figures) > 0")
    every = found.groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    each = F.flatten(F.transform("ss", lambda s: F.transform(s["figures"], lambda f: F.struct(f["path"].alias("path"), f["caption"].alias("caption"), s["title"].alias("section")))))
    return every.select("doc_id", F.posexplode(each).alias("n", "f")).select("doc_id", F.concat(F.lit("fig_"), (F.col("n") + 1).cast("string")).alias("figure_id"), "f.path", "f.caption", "f.section")


def pre(docs: DataFrame) -> DataFrame:
    """What stands before the first header of sources that have one."""
    pieces = F.split(F.regexp_replace(body(plain_source(F.col("text"))), environments(CODE), ""), f"(?={HEADER})", -1)
    d = docs.select("doc_id", pieces.alias("ps")).where(F.size("ps") > 1)
    return d.select("doc_id", F.lit(0).alias("i"), F.lit(None).cast("string").alias("title"), F.get("ps", F.lit(0)).alias("raw")).where(~F.rlike("raw", F.lit("^" + HEADER)))


def latex_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_id, caption, content (Markdown): the tabular of each table environment; tables without rows go and take no number."""
    envs = F.regexp_extract_all(body(plain_source(F.col("text"))), F.lit(environments(["table"])), F.lit(1))
    inner = lambda e: F.regexp_extract(e, r"(?is)\\begin\{tabular\*?\}(?:\[[^\]]*\])?(.*?)\\end\{tabular\*?\}", 1)
    columns = lambda r: F.when(F.startswith(r, F.lit("{")), group(F.substring(r, F.lit(2), F.length(r)))["after"]).otherwise(r)
    table = lambda e: F.struct(T.clean_latex(argument(e, "caption")).alias("caption"), tabular(A.let(inner(e), columns)).alias("content"))
    d = docs.select("doc_id", F.posexplode(F.filter(F.transform(envs, table), lambda t: t["content"].isNotNull())).alias("n", "t"))
    number = (F.col("n") + 1).cast("string")
    return d.select("doc_id", F.concat(F.lit("table_"), number).alias("table_id"), F.coalesce(F.nullif(F.col("t.caption"), F.lit("")), F.concat(F.lit("Table "), number)).alias("caption"), "t.content")


def tabular(rows_of: Column) -> Column:
    """A LaTeX tabular as a Markdown table: rows are split before they are cleaned, short rows padded; cells over several columns or rows keep their text once."""
    spanned = F.regexp_replace(rows_of, r"\\multi(?:column|row)\{[^}]*\}\{[^}]*\}\{([^{}]*)\}", "$1")
    ruled = F.regexp_replace(spanned, r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "")
    rows = F.filter(F.transform(F.split(ruled, r"\\\\"), lambda r: F.transform(F.split(r, r"(?<!\\)&"), lambda c: T.clean_latex(c))), lambda r: F.array_join(r, "") != "")

    def table(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, lambda r: F.size(r)))
        line = lambda r, w: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))), " | "), F.lit(" |"))
        made = lambda w: A.let(F.transform(rs, lambda r: line(r, w)), lambda m: F.concat_ws("\n", F.element_at(m, 1), F.concat(F.lit("|"), F.repeat(F.lit("---|"), w)), F.slice(m, F.lit(2), F.size(m))))
        return F.when(F.size(rs) > 0, A.let(width, made))

    return A.let(rows, table)


def inline_includes(files: DataFrame, main: DataFrame, depth: int = 8) -> DataFrame:
    """files(name, text), main(doc_id, text): \\input and \\include replaced by the named files, to a depth; missing files by nothing. One join a level, on the name."""
    out = main.select("doc_id", "text")
    pattern = r"\\(?:input|include)\{([^}]+)\}"
    clean = lambda n: F.regexp_replace(n, r"\.tex$", "")
    f = files.select(clean(F.col("name")).alias("name"), F.col("text").alias("body"))
    for level in range(depth):
        found = out.select("doc_id", F.posexplode(F.arrays_zip(F.split("text", pattern).alias("t"), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("n"))).alias("i", "z"))
        found = found.select("doc_id", "i", "z.t", clean(F.col("z.n")).alias("name")).join(f, "name", "left")
        text = F.coalesce("body", F.lit("")) if level + 1 < depth else F.lit("")
        out = found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("t", text).alias("s")))), lambda s: s["s"]), "").alias("text"))
    return out
