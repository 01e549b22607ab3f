"""Column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of two or more letters, digits or underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Sentences end at one of these and the white space after it.
SENTENCE_END = r"(?<=[.!?:\n])\s+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """The sentences of a text without blank ones; none for blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1), lambda s: F.trim(s) != "")


def word_count(text: Column) -> Column:
    """Words between white space: the default measure of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_fence(raw: Column) -> Column:
    """A model's answer without the code fence around it, if there is one."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^```(?i:json)?", ""), r"```$", ""), r"^\s+|\s+$", "")
    return F.when(t.startswith("```"), inner).otherwise(t)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def truncated_share(tokens_: Column, limit: int) -> Column:
    """Percent of the tokens beyond a limit."""
    return F.when(tokens_ > limit, 100.0 * (1 - F.lit(limit) / tokens_)).otherwise(F.lit(0.0))
