"""Scalar rules over manifest columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as true, and the file extensions and types each step takes.
TRUE_WORDS = ("1", "true", "yes", "y")
PREPROCESS_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tiff", "heic", "heif")
EXTRACT_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")
IMAGE_MIME_TYPES = ("image/jpeg", "image/png", "image/bmp", "image/webp", "image/tiff", "image/heic", "image/heif")
QUERY_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "heic", "heif")


def truthy(c: Column | str) -> Column:
    """Whether a string says true; null says false."""
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def location_of(image_id: Column | str) -> Column:
    """What stands before the first slash; an id without one is its own location."""
    return F.split_part(image_id, F.lit("/"), F.lit(1))


def extension_of(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem_of(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def parent_of(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def shuffle_key(seed: int, key: Column | str) -> Column:
    """A reproducible stand-in for a seeded shuffle: order by this, then by the key."""
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")))
