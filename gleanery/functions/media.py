"""Images as values: data addresses, payloads of model responses, size filters, perceptual-hash dedup of frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_data_uri(uri: Column) -> Column:
    return F.when(F.rlike(uri, F.lit(r"^data:[^,]*;base64,")), F.try_to_binary(F.regexp_replace(uri, r"^data:[^,]*,", ""), F.lit("base64")))


def to_data_uri(data: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))


def image_of_response(response: Column) -> Column:
    """The picture of a response: the first of the places where providers put it."""
    places = ["$.choices[0].message.images[0].image_url.url", "$.choices[0].message.images[0].url", "$.choices[0].message.content[0].image_url.url", "$.data[0].url", "$.data[0].b64_json"]
    found = F.coalesce(*[F.nullif(F.get_json_object(response, p), F.lit("")) for p in places])
    return F.coalesce(from_data_uri(found), F.try_to_binary(found, F.lit("base64")))


def large_enough(width: Column, height: Column, least: int = 300, ratios: tuple[float, float] | None = (0.25, 4.0)) -> Column:
    """At least so many pixels each way and not too long; an image of unknown size passes."""
    ok = (width >= least) & (height >= least)
    ok = ok & (width / height).between(*ratios) if ratios else ok
    return F.when(width.isNull() | height.isNull(), True).otherwise(ok)


def distinct_frames(hashes: Column, least_distance: int = 8) -> Column:
    """Of 64-bit perceptual hashes in order, the places of those more than the distance from every one kept before."""
    pairs = F.transform(hashes, lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    start = F.array().cast("array<struct<i:int,h:bigint>>")
    kept = F.aggregate(pairs, start, lambda acc, p: F.when(F.exists(acc, lambda k: F.bit_count(k["h"].bitwiseXOR(p["h"])) <= least_distance), acc).otherwise(F.concat(acc, F.array(p))))
    return F.transform(kept, lambda p: p["i"])


def even_sample(xs: Column, most: int = 12) -> Column:
    """At most so many elements, evenly spread, the first included."""
    return F.when(F.size(xs) <= most, xs).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(xs, F.floor(i * F.size(xs) / most).cast("int") + 1)))
