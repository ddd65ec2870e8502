"""Scalar text functions as column expressions (inside code generation; no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Section title keywords and their types, looked up in this order.
SECTION_TYPES = [
    ("abstract", "abstract"), ("introduction", "introduction"), ("background", "background"), ("related work", "background"), ("literature review", "background"), ("prior work", "background"),
    ("preliminary", "background"), ("preliminaries", "background"), ("method", "methods"), ("methods", "methods"), ("methodology", "methods"), ("approach", "methods"), ("model", "methods"),
    ("proposed method", "methods"), ("framework", "methods"), ("architecture", "methods"), ("algorithm", "methods"), ("formulation", "methods"), ("experiment", "experiments"),
    ("experiments", "experiments"), ("experimental setup", "experiments"), ("experimental settings", "experiments"), ("setup", "experiments"), ("implementation", "experiments"),
    ("implementation details", "experiments"), ("evaluation", "experiments"), ("result", "results"), ("results", "results"), ("findings", "results"), ("main results", "results"),
    ("quantitative results", "results"), ("qualitative results", "results"), ("ablation", "results"), ("ablation study", "results"), ("discussion", "discussion"), ("analysis", "discussion"),
    ("limitation", "discussion"), ("limitations", "discussion"), ("conclusion", "conclusion"), ("conclusions", "conclusion"), ("summary", "conclusion"), ("concluding remarks", "conclusion"),
    ("future work", "conclusion"), ("conclusion and future work", "conclusion"), ("reference", "references"), ("references", "references"), ("bibliography", "references"),
    ("acknowledgment", "acknowledgments"), ("acknowledgments", "acknowledgments"), ("acknowledgements", "acknowledgments"),
]
# Title keywords of sections that no summary needs.
BOILERPLATE = [
    "copyright", "license", "licence", "legal", "disclaimer", "terms of use", "terms and conditions", "project gutenberg", "gutenberg", "public domain", "about the author",
    "about the publisher", "acknowledgment", "acknowledgement", "support", "donation", "how to donate", "colophon", "bibliograph", "mission statement", "foundation", "publisher's note",
    "editor's note", "transcriber", "errata",
]

# Patterns of speech fillers, immediate repetitions, and caption noise.
FILLERS = r"(?i)\b(?:uh+h*|um+|hmm+|hm+|mhm+|uh-?huh|uh-?uh|uhuh+|uhhuh+|um-hm|you know|i mean|sort of|kind of|like i said|right\??|okay\??|you see)\b"
REPEATED = r"(?i)\b(\w[\w']*)\s+\1\b"
NOISE = r"\[.*?\]|\(.*?\)|<[^>]+>|&\w+;|>>\s*"


def strip(text: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|(?<!\s)\s+$", "")  # a run of white space within the text is tried once, not from each of its characters


def words(text: Column) -> Column:
    """Tokens between white space, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def regex_word_count(text: Column) -> Column:
    """Unicode word runs, the length that density scores divide by."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\pL\pM\pN_]+")).cast("long")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def drop_controls(text: Column) -> Column:
    """Without NUL and the replacement character."""
    return F.regexp_replace(text, "[\\x00�]", "")


def section_type(title: Column) -> Column:
    """Exact key, else the first listed key that the title contains, else other; leading numbering is dropped."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(title)), r"^[0-9.\-) ]+", ""))
    known = F.create_map(*[F.lit(x) for k, v in reversed(dict(SECTION_TYPES).items()) for x in (k, v)])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SECTION_TYPES])
    inside = lambda b: F.try_element_at(F.filter(pairs, lambda p: F.contains(b, p["k"])), F.lit(1))["v"]
    return let(t, lambda b: F.coalesce(F.try_element_at(known, b), inside(b), F.lit("other")))


def is_boilerplate(title: Column) -> Column:
    words = F.array(*map(F.lit, BOILERPLATE))
    return let(F.lower(F.trim(title)), lambda t: F.exists(words, lambda k: F.contains(t, k)))


def slugify(text: Column, most: int = 60) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text)), r"[^\pL\pM\pN_]+", "_")
    return F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, most)


def answer_letter(answer: Column) -> Column:
    """The letter A-D that an answer opens with, else its first character in upper case."""
    got = F.regexp_extract(answer, r"^\s*([ABCD])(?:[^\pL\pN_]|$)", 1)
    return F.coalesce(F.nullif(got, F.lit("")), F.upper(F.substring(F.trim(answer), 1, 1)))


def cap_bullet(text: Column, most: int = 10) -> Column:
    """Trimmed, without closing dots, at most ten words."""
    return first_words(F.regexp_replace(F.trim(text), r"\.+$", ""), most)


def cap_bullets(bullets: Column, k: int) -> Column:
    return F.slice(F.filter(F.transform(bullets, lambda b: cap_bullet(b)), lambda b: b != ""), 1, k)


def cap_title(title: Column, most_words: int = 10, most_chars: int = 72) -> Column:
    t = first_words(title, most_words)
    return F.when(F.length(t) > most_chars, F.concat(F.rtrim(F.substring(t, 1, most_chars - 3)), F.lit("..."))).otherwise(t)


def cap_authors(authors: Column, most: int = 6, keep: int = 4, most_chars: int = 90) -> Column:
    """More than six names, or more than ninety characters: the first four and et al."""
    parts = F.filter(F.transform(F.split(authors, ","), lambda a: F.trim(a)), lambda a: a != "")
    full = F.array_join(parts, ", ")
    short = F.concat(F.array_join(F.slice(parts, 1, keep), ", "), F.lit(", et al."))
    return F.when((F.size(parts) > most) | (F.length(full) > most_chars), short).otherwise(full)


def head_middle_tail(text: Column, most: int) -> Column:
    """Half the allowance from the start, a fifth from the middle, the rest from the end, with markers between; shorter texts whole."""
    w = words(text)
    n, head, tail = F.size(w), most * 50 // 100, most * 30 // 100
    mid = most - head - tail
    at = F.floor((n - mid) / 2).cast("int")
    part = lambda a, k: F.array_join(F.slice(w, a, k), " ")
    cut = F.concat_ws("\n\n[...]\n\n", part(F.lit(1), F.lit(head)), part(at + 1, F.lit(mid)), part(n - tail + 1, F.lit(tail)))
    return F.when(n <= most, F.array_join(w, " ")).otherwise(cut)


def strip_tags(html: Column) -> Column:
    t = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def bold_markup(text: Column) -> Column:
    return F.regexp_replace(escape_html(text), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(strip_code_fence(text), r"(?s)(\{.*\})", 1), F.lit(""))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def ratio(xs: Column) -> Column:
    """Largest over smallest positive number; null below two numbers."""
    pos = F.filter(xs, lambda x: x > 0)
    return F.when(F.size(pos) >= 2, F.array_max(pos) / F.array_min(pos))


def vtt_seconds(stamp: Column) -> Column:
    """HH:MM:SS.mmm or MM:SS.mmm."""
    p = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    at = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)).try_cast("double"), F.lit(0.0))
    return at(-1) + 60 * at(-2) + 3600 * F.when(F.size(p) > 2, at(-3)).otherwise(0.0)


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60)


def clean_caption(text: Column) -> Column:
    """Without bracketed noise, tags, entities and turn marks; spaces joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, " "), r"\s+", " "))


def clean_speech(text: Column) -> Column:
    """Without filler words and immediate repetitions (two passes for triples)."""
    t = F.regexp_replace(text, FILLERS, "")
    for _ in range(2):
        t = F.regexp_replace(t, REPEATED, "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+([,.!?;:])", "$1"), r"([,;:])(?:\s*[,;:])+", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# LaTeX commands whose argument is kept, commands that go with their argument, and environments that hold formulas, or nothing to read.
KEPT = "textbf|textit|emph|textrm|texttt|textsc|underline|text|mathrm"
DROPPED = "label|ref|eqref|cite|citep|citet|citealt|footnote|footnotemark|footnotetext|vspace|hspace|vskip|hskip|bibliographystyle|bibliography|includegraphics|thanks"
FORMULAS = "equation|align|gather|multline|eqnarray"
UNREAD = "figure|table|verbatim|lstlisting|algorithm|algorithmic|tikzpicture|tabular|array|minipage|wrapfigure"
#: Order counts: formulas before environments, arguments kept or dropped before bare commands, escapes before braces.
LATEX_STEPS = [
    (r"(?m)(?<!\\)%[^\n]*$", ""),
    (rf"\\(?:{KEPT})\{{([^{{}}]*)\}}", "$1"),
    (rf"(?s)\\begin\{{(?:{FORMULAS})\*?\}}.*?\\end\{{(?:{FORMULAS})\*?\}}", " [eq] "),
    (r"(?s)\$\$.*?\$\$", " [eq] "),
    (r"(?<!\\)\$[^$\n]+(?<!\\)\$", " [eq] "),
    (rf"(?s)\\begin\{{(?:{UNREAD})\*?\}}.*?\\end\{{(?:{UNREAD})\*?\}}", " "),
    (rf"\\(?:{DROPPED})\*?(?:\[[^\]]*\])*+\{{[^{{}}]*\}}", ""),
    (r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1"),
    (r"\\item\s*(?:\[[^\]]*\])?\s*", "\n- "),
    (r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", ""),
    (r"\\\\", "\n"),
    (r"\\([%&_#${}])", "$1"),
    (r"\\[,;:!]", " "),
    (r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", ""),
    (r"[{}]", ""),
    (r"~", " "),
    (r"``|''", '"'),
    (r"`", "'"),
    (r"---?", "\u2014"),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
]


def clean_latex(text: Column) -> Column:
    """Prose of LaTeX source: comments, labels, citations and markup commands go, arguments of text commands stay, formulas leave a mark."""
    for pattern, new in LATEX_STEPS:
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


# The address forms of video platforms, with the id of a video behind each.
YOUTUBE = [r"youtube\.com/watch\?.*?v=", r"youtu\.be/", r"youtube\.com/embed/", r"youtube\.com/v/"]
YOUTUBE_ID = r"[A-Za-z0-9_\-]{11}"
VIMEO = r"(?:https?://)?(?:www\.)?(?:vimeo\.com|player\.vimeo\.com/video)/(\d+)"


def video_platform(url: Column) -> Column:
    return F.when(F.rlike(url, F.lit(f"(?i)(?:{'|'.join(YOUTUBE)}){YOUTUBE_ID}")), "youtube").when(F.rlike(url, F.lit(f"(?i){VIMEO}")), "vimeo").otherwise("other")


def source_format(path: Column) -> Column:
    """The reader of a path: video address first, then web address, then extension; null for an unknown one."""
    table = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "txt": "markdown", "docx": "docx", "pptx": "pptx", "tex": "latex", "ipynb": "notebook", "html": "html", "htm": "html", "mp4": "video", "vtt": "video"}
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext)
    return F.when(video_platform(path) != "other", "video").when(F.rlike(path, F.lit("(?i)^https?://")), "html").otherwise(by_ext)
