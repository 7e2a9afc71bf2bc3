"""Path keys and categories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_PATH, INVALID_KEY = "invalid_path", "invalid"
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")


def _segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def file_key(path: Column) -> Column:
    """The bare file name; null and blank paths give a sentinel."""
    return F.when(path.isNull() | (F.trim(path) == ""), INVALID_PATH).otherwise(F.element_at(_segments(path), -1))


def folder_key(path: Column) -> Column:
    """Folder and file name, or the only segment; null and blank paths give a sentinel."""
    parts = _segments(path)
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(path.isNull() | (F.trim(path) == ""), INVALID_KEY).otherwise(F.array_join(last, "/"))


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def category(path: Column) -> Column:
    """The parent folder, ``root`` where there is none."""
    parts = _segments(path)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("root")


def first_segment(key: Column) -> Column:
    return F.element_at(_segments(key), 1)


def has_extension(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return F.lower(F.element_at(F.split(path, "[.]"), -1)).isin(*extensions) & path.contains(".")
