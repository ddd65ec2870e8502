"""Media columns: Matroska files as binary values, written and parsed into packet tables.

The parser walks variable-length EBML elements (also of unknown size), clusters with SimpleBlocks and BlockGroups, the three lacings, and cues, and gives a
row a packet: track, timestamp, byte range, cluster, key-frame mark. It copies no payload; byte ranges point into the value. The writer stores samples of
8-bit PCM: frames of `FRAME` bytes, eight to a block with fixed lacing, the last block with EBML lacing if its frames differ in size, clusters with their own
timestamps, and one cue a cluster.

Defined cases: null and empty text give a payload of 64 zero bytes; a damaged or cut-off value gives the packets before the damage and `damaged` true;
null media have no packets; repeated rows give equal rows (nothing random or dated is written); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_table

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, LACING = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_HEADER = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, b"matroska"), (0x4287, 4), (0x4285, 2))
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
CODEC_PCM, SAMPLE_RATE = b"A_PCM/INT/LIT", 8000
FRAME, LACED, CLUSTER_FRAMES = 1024, 8, 128


# Writing

def size_bytes(n: int, width: int = 0) -> bytes:
    """A length as a variable-size integer: the leading bit's place tells the width; all ones is reserved."""
    while not width or n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes | int | float) -> bytes:
    if isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def block(number: int, relative: int, frames: list[bytes]) -> bytes:
    """The body of a SimpleBlock of key frames: one frame plain, equal ones with fixed lacing, others with EBML lacing."""
    head = size_bytes(number) + struct.pack(">h", relative)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len({len(f) for f in frames}) == 1:
        return head + bytes([0x84, len(frames) - 1]) + b"".join(frames)
    sizes = size_bytes(len(frames[0]))
    for a, b in zip(frames[:-2], frames[1:-1], strict=True):
        width, d = 1, len(b) - len(a)
        while abs(d) >= (1 << (7 * width - 1)) - 1:
            width += 1
        sizes += size_bytes(d + (1 << (7 * width - 1)) - 1, width)
    return head + bytes([0x86, len(frames) - 1]) + sizes + b"".join(frames)


def mux(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A Matroska file whose one track holds the payload as unsigned 8-bit samples."""
    ms = lambda at: at * 1000 // rate
    head = element(EBML, b"".join(element(k, v) for k, v in EBML_HEADER))
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, len(payload) * 1000.0 / rate) + element(MUXER, b"gleanery") + element(WRITER, b"gleanery"))
    audio = element(AUDIO, element(RATE, float(rate)) + element(CHANNELS, 1) + element(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACING, 1) + element(CODEC, CODEC_PCM) + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(payload), FRAME * CLUSTER_FRAMES):
        chunk, start = payload[c : c + FRAME * CLUSTER_FRAMES], ms(c)
        blocks = [element(TIMESTAMP, start)]
        for b in range(0, len(chunk), FRAME * LACED):
            body = chunk[b : b + FRAME * LACED]
            blocks.append(element(SIMPLE_BLOCK, block(1, ms(c + b) - start, [body[i : i + FRAME] for i in range(0, len(body), FRAME)])))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# Parsing

class Damaged(ValueError):
    pass


def number_at(data: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """(value, place after it) of a variable-size integer; None if all value bits are ones (an unknown size)."""
    if at >= end or not data[at]:
        raise Damaged(f"no length at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    value = n ^ (1 << (7 * width))
    return (n if keep_mark else None if value == (1 << (7 * width)) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, ends_at: frozenset = frozenset()):
    """(id, start, body, body end) in turn; a body of unknown size goes on to an element of the parent's level or the parent's end."""
    while at < end:
        start = at
        ident, at = number_at(data, at, end, keep_mark=True)
        n, at = number_at(data, at, end)
        if n is not None and at + n > end:
            raise Damaged(f"element {ident:x} at {start} runs over its parent's end")
        stop = at + n if n is not None else unknown_end(data, ident, at, end)
        yield ident, start, at, stop
        at = stop


def unknown_end(data: bytes, ident: int, at: int, end: int) -> int:
    if ident != CLUSTER:
        return end
    while at < end:  # a cluster ends where an element stands that only a segment holds
        inner, body = number_at(data, at, end, keep_mark=True)
        if inner in TOP:
            return at
        n, body = number_at(data, body, end)
        if n is None:
            raise Damaged(f"unknown size inside a cluster at {at}")
        at = body + n
    return end


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int, bool]] = field(default_factory=list)  # track, timestamp ns, byte start, bytes, cluster, key frame
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # timestamp ns, track, place of the cluster in the file
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    damaged: str = ""


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, byte ranges of the laced frames) of a block's body."""
    number, at = number_at(data, at, end)
    if at + 3 > end:
        raise Damaged(f"block cut off at {at}")
    relative, flags, at = struct.unpack_from(">h", data, at)[0], data[at + 2], at + 3
    lacing = flags >> 1 & 3
    if not lacing:
        return number, relative, flags, [(at, end - at)]
    if at >= end:
        raise Damaged(f"lace cut off at {at}")
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise Damaged("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == 1:
                s = 0
                while True:
                    if at >= end:
                        raise Damaged("lace cut off")
                    s, at = s + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            else:
                width = 9 - data[at].bit_length() if at < end and data[at] else 0
                raw, at = number_at(data, at, end)
                raw = (1 << (7 * width)) - 1 if raw is None else raw
                s = raw if i == 0 else sizes[-1] + raw - ((1 << (7 * width - 1)) - 1)
            sizes.append(s)
        sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise Damaged("lace sizes exceed the block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return number, relative, flags, out


def parse(data: bytes) -> Media:
    m = Media()
    try:
        for ident, _, a, b in elements(data, 0, len(data)):
            if ident == SEGMENT:
                segment(data, a, b, m)
    except (Damaged, struct.error) as e:
        m.damaged = str(e) or "damaged"
    return m


def segment(data: bytes, start: int, end: int, m: Media) -> None:
    for ident, at, a, b in elements(data, start, end):
        if ident == INFO:
            for k, _, x, y in elements(data, a, b):
                if k == TIMESTAMP_SCALE:
                    m.scale = uint(data, x, y)
                elif k == DURATION:
                    m.duration = real(data, x, y)
        elif ident == TRACKS:
            for k, _, x, y in elements(data, a, b):
                if k == TRACK:
                    t = track(data, x, y)
                    m.tracks[t.get("number", 0)] = t
        elif ident == CLUSTER:
            m.clusters.append(at)
            cluster(data, a, b, m)
        elif ident == CUES:
            for k, _, x, y in elements(data, a, b):
                if k == CUE_POINT:
                    got = dict.fromkeys((CUE_TIME, CUE_TRACK, CUE_CLUSTER), 0)
                    for k2, _, x2, y2 in elements(data, x, y):
                        if k2 == CUE_POSITIONS:
                            got |= {k3: uint(data, x3, y3) for k3, _, x3, y3 in elements(data, x2, y2)}
                        else:
                            got[k2] = uint(data, x2, y2)
                    m.cues.append((got[CUE_TIME] * m.scale, got[CUE_TRACK], start + got[CUE_CLUSTER]))


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def track(data: bytes, a: int, b: int) -> dict:
    t: dict = {}
    for k, _, x, y in elements(data, a, b):
        if k in (NUMBER, KIND):
            t["number" if k == NUMBER else "kind"] = uint(data, x, y)
        elif k == CODEC:
            t["codec"] = data[x:y].decode("ascii", "replace")
        elif k == AUDIO:
            for k2, _, x2, y2 in elements(data, x, y):
                if k2 == RATE:
                    t["rate"] = real(data, x2, y2)
                elif k2 in (CHANNELS, DEPTH):
                    t["channels" if k2 == CHANNELS else "depth"] = uint(data, x2, y2)
    return t


def cluster(data: bytes, a: int, b: int, m: Media) -> None:
    base, number = 0, len(m.clusters) - 1
    for k, _, x, y in elements(data, a, b):
        if k == TIMESTAMP:
            base = uint(data, x, y)
        elif k == SIMPLE_BLOCK:
            put(data, x, y, m, base, number, None)
        elif k == BLOCK_GROUP:
            inner = [(k2, x2, y2) for k2, _, x2, y2 in elements(data, x, y)]
            key = all(k2 != REFERENCE for k2, _, _ in inner)
            for k2, x2, y2 in inner:
                if k2 == BLOCK:
                    put(data, x2, y2, m, base, number, key)


def put(data: bytes, a: int, b: int, m: Media, base: int, number: int, key: bool | None) -> None:
    """Add a block's packets; laced frames of PCM follow each other by their sample counts, others share the block's timestamp."""
    of, relative, flags, frames = frames_of(data, a, b)
    m.blocks += 1
    t = m.tracks.get(of, {})
    unit = t.get("channels", 1) * t.get("depth", 0) // 8 * t.get("rate", 0) if t.get("codec", "").startswith("A_PCM") else 0
    at, first = (base + relative) * m.scale, frames[0][0]
    key = bool(flags & 0x80) if key is None else key
    for x, n in frames:
        m.packets.append((of, at + (round((x - first) * 1e9 / unit) if unit else 0), x, n, number, key))


def payload_of(data: bytes, m: Media, number: int = 1) -> bytes:
    return b"".join(data[x : x + n] for of, _, x, n, _, _ in m.packets if of == number)


def feature(payload: bytes, m: Media) -> str:
    """What is stored, in whole numbers: container counts, then sums over the samples."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64)
    last = max((t for _, t, *_ in m.packets), default=0) // 1_000_000
    codec = m.tracks.get(1, {}).get("codec", "")
    return (f"codec={codec};clusters={len(m.clusters)};cues={sum(c[2] in set(m.clusters) for c in m.cues)};blocks={m.blocks};packets={len(m.packets)};last_ms={last};"
            f"sum={s.sum()};squares={(s * s).sum()};crossings={int(np.count_nonzero(np.diff(s >= 128)))}")


# Columns

def padded(text: str | None) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a Matroska file) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            media, n = [], []
            for t in batch.column("text"):
                payload, size = padded(t.as_py())
                media.append(mux(payload))
                n.append(size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def packets(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row a packet: doc_id, packet, track, timestamp_ns, byte_start, n_bytes, cluster, key_frame, damaged."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["doc_id", "packet", "track", "timestamp_ns", "byte_start", "n_bytes", "cluster", "key_frame", "damaged"]

    def run(batches):
        for batch in batches:
            for ident, value in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                m = parse(value.as_py() or b"")
                rows = [(ident.as_py(), i, *p, bool(m.damaged)) for i, p in enumerate(m.packets)]
                if rows:
                    kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.bool_(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = f"doc_id {kind}, packet bigint, track bigint, timestamp_ns bigint, byte_start bigint, n_bytes bigint, cluster bigint, key_frame boolean, damaged boolean"
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def read_back(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> digests of the payload read back and of the stored form, and the feature."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                data = value.as_py()
                m = parse(data)
                p = payload_of(data, m)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(p, m)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op10_media(spark, sf_dir):
    return read_back(Scratch(spark, "media").cut(to_media(read_table(spark, sf_dir, "documents")), "media"))
