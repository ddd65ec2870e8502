"""BPE encoding and decoding with a public tokenizer file, exact to the tokenizers library, by tree concatenation.

A text is normalised as the file says and stays unsplit: it is cut into halves, and these again, down to leaves at any character. A leaf is encoded by itself,
as if nothing stood around it, so halves don't wait for each other; neighbours are then joined level by level. At a join, a window of the left side's last and
the right side's first words is encoded anew, and grows until its first word is the left side's and its last word the right side's: both sides then agree with
the window, and what lies outside it stays as it was.

Why agreement is enough: the file's split pattern looks at no text before a match and at most two characters behind the one it starts at (contractions), and
a word's ids depend on its characters alone. If the window's first word is the left side's own, no earlier match can have looked over the cut; if its last
word starts where a word of the right side starts, all that follows is split alike. A side that the window uses up needs no agreement there.

Words stay text while a join can still reach them, and become ids behind that: by the library's model, or by a bounded table of words met before. So a word
that is longer than many leaves is encoded once, when it is whole. Texts with letters outside the Latin blocks are split by the library's own classes of
characters. Files of another normaliser or split pattern go through the library whole. A worker holds one block of texts and its ids at a time.

Defined cases: null and empty text have no ids (decoded text empty); special-token strings in a text become their ids, as the library does; repeated rows
are encoded alike; texts of many words and of one long word are joined alike; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, read_table

LEAF = 3072  # characters of a leaf
# Fixed values of the file's scheme, for which the agreement above is proved, and its split pattern with the Latin blocks' letters and digits written out.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
LATIN = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ‐-‧]")  # a character outside the blocks whose classes are written out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes()


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Classes(dict):
    """Code point -> one that Python's pattern puts where the library's own tables put it: a letter, a digit, white space or other; asked once a code point."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, point: int) -> int:
        c = chr(point)
        pieces = len(self.split("a" + c))  # white space and letters leave one piece, and so on
        kind = ("a" if self.split("a" + c)[0][1][1] == 2 else " ") if pieces == 1 else "1" if len(self.split(c + c)) == 2 else "!"
        found = self[point] = ord(kind)
        return found


class Splitter:
    """The file's split pattern. Letters and digits of the Latin blocks are written out; a text with others is split by a copy of it in which each character is
    replaced by one of its class."""

    def __init__(self, pre_tokenizer):
        self.classes = Classes(pre_tokenizer.pre_tokenize_str)
        self.classes.update({i: i for i in range(0x250) if not LATIN.match(chr(i))})

    def __call__(self, text: str) -> list[str]:
        if not LATIN.search(text):
            return PIECES.findall(text)
        return [text[a:b] for a, b in (m.span() for m in PIECES.finditer(text.translate(self.classes)))]


class Words(dict):
    """Word -> ids as little-endian bytes. Of the words met last, at least `most` are kept and at most twice as many; words longer than `longest` are not."""

    def __init__(self, model, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.tokenize, self.most, self.longest, self.old = model.tokenize, most, longest, {}
        self.alphabet = str.maketrans(byte_characters())

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            ids = [t.id for t in self.tokenize(word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.alphabet))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class Side:
    """A stretch [start, end) of a text, encoded by itself: its first and last words as lists, plain ids between."""

    __slots__ = ("end", "first", "ids", "last", "start")

    def __init__(self, start: int, end: int, first: list[str], ids: list[bytes] | None = None, last: list[str] | None = None):
        self.start, self.end, self.first, self.ids, self.last = start, end, first, ids, last  # one list of words only: first, with ids and last None

    @property
    def tail(self) -> list[str]:
        return self.first if self.last is None else self.last


class Bpe:
    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        normal, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        #: Whether the file has the scheme that the agreement is proved for.
        self.known = ([n["type"] for n in normal.get("normalizers", [])] == NORMAL and split[0].get("pattern", {}).get("Regex") == SPLIT and plain and spec.get("decoder") is None)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.special_ids = {t: packed([i]) for t, i in special.items()}
        self.tokens = [""] * library.get_vocab_size(True)
        for t, i in library.get_vocab(True).items():
            self.tokens[i] = t
        self.library, self.leaf, self.joins = library, leaf, 0
        if self.known:
            self.split, self.words = Splitter(library.pre_tokenizer), Words(library.model)

    def normal(self, text: str) -> str:
        """As the file says, but for the joining of white space, which no word holds. Python's tables are the library's within the Latin blocks."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).lower() if not LATIN.search(text) and "İ" not in text else self.library.normalizer.normalize_str(text)

    def encode(self, text: str | None) -> bytes:
        """ids of the whole text as little-endian unsigned 32-bit integers."""
        if not self.known:
            return packed(self.library.encode(text or "", add_special_tokens=False).ids)
        if not text:
            return b""
        if not (self.special and "<|" in text):
            return self.tree(self.normal(text))
        # Special tokens are cut out first; what lies between is normalised by itself.
        return b"".join(self.special_ids.get(part) or self.tree(self.normal(part)) for part in self.special.split(text) if part)

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def tree(self, text: str) -> bytes:
        """ids of a normalised text. A text longer than a block is taken in stretches, so that words are held for a block only."""
        if len(text) <= self.leaf:
            return self.plain(self.split(text))
        return self.plainly(self.half(text, 0, len(text)))

    def plain(self, words: list[str]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def plainly(self, side: Side) -> bytes:
        return b"".join([self.plain(side.first), *(side.ids or []), self.plain(side.last or [])])

    def half(self, text: str, start: int, end: int) -> Side:
        """The stretch as a side: a leaf, or its two halves joined."""
        if end - start <= self.leaf:
            return Side(start, end, self.split(text[start:end]))
        middle = (start + end) // 2
        return self.join(text, self.half(text, start, middle), self.half(text, middle, end))

    def join(self, text: str, left: Side, right: Side) -> Side:
        """The two as one side. The window has the last n words of the left and the first n of the right side, and grows until it agrees with both."""
        self.joins += 1
        a, b, n = left.tail, right.first, 2
        while True:
            i, j = max(0, len(a) - n), min(len(b), n)  # a side whose outer words are used up is taken whole
            whole_left, whole_right = i == 0, j == len(b)
            start, end = left.start if whole_left else backward(text, a[i:], left.end), right.end if whole_right else forward(text, b[:j], right.start)
            got = self.split(text[start:end])
            if (whole_left or (got and got[0] == a[i])) and (whole_right or (got and got[-1] == b[j - 1])):
                break
            n *= 2
        before = [] if whole_left else [left.first, *(left.ids or []), left.last] if left.last is not None else [left.first]
        if before:
            before[-1] = a[:i]
        behind = [] if whole_right else [right.first, *(right.ids or []), right.last] if right.last is not None else [right.first]
        if behind:
            behind[0] = b[j:]
        parts = [*before, got, *behind]
        if len(parts) == 1:
            return Side(left.start, right.end, got)
        # Words of the outer ends stay words, for the joins to come; those between become ids.
        return Side(left.start, right.end, parts[0], [p if isinstance(p, bytes) else self.plain(p) for p in parts[1:-1]], parts[-1])

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        got = np.frombuffer(ids, "<u4").tolist()
        if self.known:  # without a decoder the tokens are joined by spaces
            return " ".join(map(self.tokens.__getitem__, got))
        return self.library.decode(got, skip_special_tokens=False)


def backward(text: str, words: list[str], end: int) -> int:
    """Where the first of the words stands that end a stretch: only white space lies between them and behind them."""
    for w in reversed(words):
        end = text.rindex(w, 0, end)
    return end


def forward(text: str, words: list[str], start: int) -> int:
    """Where the last of the words ends that a stretch begins with."""
    for w in words:
        start = text.index(w, start) + len(w)
    return start


KEPT: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """One a process: the file's tables, which don't grow with what is encoded."""
    if path not in KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        KEPT[path] = Bpe(path)
    return KEPT[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        b = bpe(path)
        for batch, texts in blocks(batches):
            out = [np.frombuffer(ids, "<i4") for ids in b.encode_texts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(out)], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list column from the arrays' own bytes, without a Python object a value."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (text)."""
    kinds = {"ids": pa.binary(), "decoded": pa.string()}
    return _run(docs, path or default_path(), id_col, text_col, "ids binary, decoded string", kinds, lambda ids, out: (ids, out))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with the two results as SHA-256, taken where they are made."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    kinds = {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _run(docs, path or default_path(), id_col, text_col, "ids_sha256 string, decoded_sha256 string", kinds, lambda ids, out: (sha(ids), sha(out.encode("utf-8"))))


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, kinds: dict[str, pa.DataType], last) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        b = bpe(path)
        for batch, texts in blocks(batches):
            found = b.encode_texts(texts)
            rows = [last(ids, b.decode(ids)) for ids in found]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(ids) // 4 for ids in found], pa.int64()), *cols], names=["doc_id", "n_tokens", *kinds])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {schema}")


def op2_bpe(spark, sf_dir):
    return digests(read_table(spark, sf_dir, "documents"))
