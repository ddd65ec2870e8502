"""Hex colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_hex(c: Column) -> Column:
    return F.rlike(c, F.lit("^#[0-9A-Fa-f]{6}$"))


def channel(c: Column, i: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")


def brightness(c: Column) -> Column:
    """Perceived brightness, 0 to 255."""
    return channel(c, 0) * 0.299 + channel(c, 1) * 0.587 + channel(c, 2) * 0.114


def text_on(c: Column, dark: str = "#1A1A1A", light: str = "#FFFFFF", limit: float = 140.0) -> Column:
    return F.when(brightness(c) > limit, dark).otherwise(light)


def shift(c: Column, by: int) -> Column:
    part = lambda i: F.lpad(F.hex(F.greatest(F.least(channel(c, i) + by, F.lit(255)), F.lit(0))), 2, "0")
    return F.concat(F.lit("#"), part(0), part(1), part(2))
