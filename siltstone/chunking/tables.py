"""Table HTML as lines of text in which every cell stands by its header."""

from __future__ import annotations

import re
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.chunking.markup import TAG, shown

#: Fixed value: the longest text of a cell that may be a header.
MAX_HEADER = 80

_NUMBER = re.compile(r"-?\d*\.?\d+-?")


def cells(table: str) -> pd.DataFrame:
    """(row, head, text) of a table's cells in order. A cell or a row that is not closed ends where the next one starts;
    a table in a cell is text of that cell."""
    found, row, depth, at = [], 0, 0, 0
    kind: str | None = None
    held: list[str] = []

    def close() -> None:
        nonlocal kind
        if kind is not None:
            found.append((row, kind == "th", shown("".join(held))))
        kind = None
        held.clear()

    for m in TAG.finditer(table):
        held.append(table[at : m.start()])
        at, name, end = m.end(), (m["name"] or "").lower(), bool(m["end"])
        if name == "table":
            depth = max(0, depth + (-1 if end else 1))
            if depth == 0:
                close()
            held.append(" ")
        elif depth > 1:
            held.append(" " if name in ("tr", "td", "th", "br", "p", "div", "li") else "")
        elif name in ("tr", "td", "th"):
            close()
            if not end:
                row += name == "tr"
                kind = name if name != "tr" else None
    held.append(table[at:])
    close()
    return pd.DataFrame(found, columns=["row", "head", "text"])


def linear(html: str | None) -> str:
    """The lines of a table; '' for what has no cells.

    The header is the first row with a ``th``, else a first row of texts that no number is among; rows before it
    are left out, as are rows and cells without text.
    """
    rows = [(r["head"].any(), r["text"].tolist()) for _, r in cells(html or "").groupby("row") if r["text"].any()]
    named = [i for i, (head, _) in enumerate(rows) if head]
    likely = len(rows) > 1 and all(t and len(t) <= MAX_HEADER and not _NUMBER.fullmatch(t) for t in rows[0][1])
    top = named[0] if named else 0 if likely else None
    names = [] if top is None else rows[top][1]
    label = lambda name, text: f"{name}: {text}" if name and text else text or ""
    body = [[label(n, t) for n, t in zip_longest(names, texts)] for _, texts in rows[0 if top is None else top + 1 :]]
    return "\n".join(" | ".join(filter(None, line)) for line in ([names] if names else []) + body)


def linearized(html: Column) -> Column:
    @F.pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(linear)

    return each(html)
