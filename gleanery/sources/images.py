"""Widths and heights from image headers: nothing is decoded, and what is not understood has no size (and passes size filters)."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least sides in pixels that the readers ask of a picture.
LEAST = {"pptx": 150, "docx": 200, "notebook": 80, "html": 100, "poster": 300}


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """The frame header, past all other segments."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def webp_size(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    return None


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of PNG, JPEG, GIF, BMP and WebP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        return jpeg_size(data)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return webp_size(data)
    return None


def sized(images: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """`keep` columns with width and height (null if unknown or if there is no content)."""
    kinds = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            found = [image_size(x.as_buffer().to_pybytes()) if x.is_valid else None for x in b.column(content)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([f and f[0] for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.int32())], names=[*keep, "width", "height"])

    return images.select(*keep, content).mapInArrow(run, f"{kinds}, width int, height int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height of the pictures (png, jpg, jpeg, gif, webp, bmp) under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp,bmp,PNG,JPG,JPEG}").load(path)
    return sized(files.select("path", F.col("content")))
