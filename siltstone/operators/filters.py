"""Metadata filters: a mapping compiled to a Column, pushed into the scan by Catalyst.

``{}`` and None select everything; several keys are joined by and. A value is an equality, or a mapping of
operators ``$eq $ne $gt $gte $lt $lte $in $nin``; the single keys ``$and`` and ``$or`` hold lists of filters.
A missing key (null) fails equality and ranges, and passes ``$ne`` and ``$nin``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import ValidationError

Lookup = Callable[[str, Any], Column]

# Conditions of a where: null is as good as false there, and what is not wrapped is pushed into the scan.
_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c.isNull() | (c != v),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: c.isNull() | ~c.isin(*v),
}
_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def kind_of(value: Any) -> str:
    """The type in which a key is looked up for a filter's value; of a list that of its first."""
    return _TYPES.get(type(value[0] if isinstance(value, (list, tuple)) and value else value), "string")


def columns_of(df: DataFrame, metadata: str | None = None) -> Lookup:
    """Looks a key up among a table's columns, and else in a variant column of metadata."""

    def find(key: str, value: Any) -> Column:
        if key in df.columns:
            return df[key]
        if metadata is None:
            raise ValidationError(f"no column {key!r}")
        return F.try_variant_get(df[metadata], f"$['{key}']", kind_of(value))

    return find


def compiled(filters: Mapping[str, Any] | None, find: Lookup) -> Column:
    if not filters:
        return F.lit(True)
    parts = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValidationError(f"{key} needs a list of filters")
            inner = [compiled(f, find) for f in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif isinstance(value, Mapping):
            for op, v in value.items():
                if op not in _COMPARE:
                    raise ValidationError(f"unknown operator {op!r}")
                parts.append(_COMPARE[op](find(key, v), v))
        else:
            parts.append(_COMPARE["$eq"](find(key, value), value))
    return reduce(lambda a, b: a & b, parts)


_ZONES: dict[str, Callable[[Column, Column, Any], Column]] = {
    "$eq": lambda lo, hi, v: (lo <= v) & (hi >= v),
    "$gt": lambda lo, hi, v: hi > v,
    "$gte": lambda lo, hi, v: hi >= v,
    "$lt": lambda lo, hi, v: lo < v,
    "$lte": lambda lo, hi, v: lo <= v,
    "$in": lambda lo, hi, v: reduce(lambda a, b: a | b, [(lo <= x) & (hi >= x) for x in v], F.lit(False)),
}


def may_match(filters: Mapping[str, Any] | None, zone: Callable[[str, Any], tuple[Column, Column] | None]) -> Column:
    """Whether a file may hold a row for which ``filters`` hold; ``zone`` gives the columns of a key's least and greatest value, or None.

    Keys without a zone, ``$ne`` and ``$nin`` (which missing keys pass) rule nothing out; a file in which a key is always missing
    has null bounds and no row that passes the other operators.
    """
    parts = [F.lit(True)]
    for key, value in (filters or {}).items():
        if key in ("$and", "$or"):
            inner = [may_match(f, zone) for f in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
            continue
        for op, v in (value if isinstance(value, Mapping) else {"$eq": value}).items():
            known = zone(key, v)
            if known is not None and op in _ZONES:
                parts.append(F.coalesce(_ZONES[op](*known, v), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def filtered(df: DataFrame, filters: Mapping[str, Any] | None, metadata: str | None = None) -> DataFrame:
    return df.where(compiled(filters, columns_of(df, metadata))) if filters else df
