"""Validation: driver-side guards that raise, and the same rules as columns."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.errors import ValidationError

#: Metadata keys that the library sets itself.
RESERVED = ("id", "embedding", "document", "text", "chunk_id", "document_id", "source_filename", "file_type", "page_number", "chunk_index", "total_chunks", "uploaded_at", "breadcrumb", "has_table", "has_image")
EXTENSIONS = (".pdf", ".md", ".docx", ".pptx")
NAME = r"^[A-Za-z0-9]([A-Za-z0-9_-]*[A-Za-z0-9])?$"
MAX_NAME = 63


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValidationError(what)


def _whole(value: Any, name: str) -> None:
    _need(isinstance(value, int) and not isinstance(value, bool), f"{name} must be a whole number")


def check_text(text: Any, most: int = 100_000) -> str:
    _need(isinstance(text, str), "text must be a string")
    _need(bool(text.strip()), "text must not be blank")
    _need(len(text) <= most, f"text must have at most {most} characters")
    return text.strip()


def check_name(name: Any) -> str:
    _need(isinstance(name, str) and bool(name.strip()), "collection name must not be blank")
    _need(len(name) <= MAX_NAME and re.fullmatch(NAME[1:-1], name) is not None, f"invalid collection name {name!r}")
    return name


def check_metadata(metadata: Any) -> dict[str, Any]:
    if metadata is None:
        return {}
    _need(isinstance(metadata, dict), "metadata must be a mapping")
    _need(all(isinstance(k, str) for k in metadata), "metadata keys must be strings")
    held = sorted(set(metadata) & set(RESERVED))
    _need(not held, f"reserved metadata keys: {', '.join(held)}")
    try:
        json.dumps(metadata)
    except (TypeError, ValueError) as e:
        raise ValidationError(f"metadata must be JSON: {e}") from e
    return metadata


def check_top_k(k: Any, most: int = 100) -> int:
    _whole(k, "top_k")
    _need(1 <= k <= most, f"top_k must be from 1 to {most}")
    return k


def check_chunk(size: Any, overlap: Any = 0) -> None:
    _whole(size, "chunk size")
    _whole(overlap, "chunk overlap")
    _need(size > 0, "chunk size must be positive")
    _need(0 <= overlap < size, "chunk overlap must be from 0 to less than the size")


def check_vector(vector: Any, dimension: int | None = None) -> list[float]:
    ok = isinstance(vector, (list, tuple)) and len(vector) > 0 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector)
    _need(ok, "an embedding must be a list of numbers")
    _need(all(math.isfinite(x) for x in vector), "an embedding must be finite")
    _need(dimension is None or len(vector) == dimension, f"an embedding must have {dimension} components")
    return [float(x) for x in vector]


def valid_text(text: Column, most: int = 100_000) -> Column:
    return F.coalesce(text.isNotNull() & (F.regexp_replace(text, r"\s+", "") != "") & (F.char_length(text) <= most), F.lit(False))


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME) & (F.char_length(name) <= MAX_NAME), F.lit(False))


def reserved_keys(keys: Column) -> Column:
    """The reserved ones among an array of metadata keys, in order."""
    return F.array_sort(F.array_intersect(keys, F.array(*[F.lit(k) for k in RESERVED])))


def valid_file(path: Column, length: Column, max_mb: float = 20.0) -> Column:
    from siltstone.functions.text import extension

    return extension(path).isin(*EXTENSIONS) & (length <= F.lit(max_mb * 1024 * 1024))
