"""Chunks that a language model makes: JSON records of its answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import CompletionError, UnsupportedProvider, told
from siltstone.functions.runs import text_runs

Complete = Callable[[str, str], str]
#: Makes, once for each task, a completion.
_PROVIDERS: dict[str, Callable[[], Complete]] = {}
SYSTEM = "Do the task that follows on the text of the document. Answer with JSON alone, an array or an object in the shape that the task asks for: no other words and no code fence."


_FENCE = re.compile(r"\s*```(?:json)?(?P<inner>.*?)(?:```)?\s*", re.I | re.S)


def unfenced(answer: str) -> str:
    """An answer without white space around it and, if it begins with one, without its code fence."""
    m = _FENCE.fullmatch(answer)
    return (m["inner"] if m else answer).strip()


def records(answer: str | None) -> list[dict[str, Any]]:
    """An array's objects; of an object the first value that is an array, its objects; else the object itself."""
    try:
        got = json.loads(unfenced(answer or ""))
    except ValueError as e:
        raise CompletionError(f"not JSON: {e}") from e
    match got:
        case list():
            rows = got
        case dict():
            rows = next(filter(lambda v: isinstance(v, list), got.values()), [got])
        case _:
            raise CompletionError(f"neither an array nor an object but {type(got).__name__}")
    return [r for r in rows if isinstance(r, dict)]


def chunk_of(record: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """(text, metadata): its text and the rest, or all of it as JSON and as metadata."""
    rest = dict(record)
    text = rest.pop("text", None)
    own = text.strip() if isinstance(text, str) else ""
    return (own, rest) if own else (json.dumps(record, ensure_ascii=False), record)


def register(name: str, make: Callable[[], Complete]) -> None:
    """A language model under a name, for ``chunked``; ``make`` runs once in each task, where a client can be opened."""
    _PROVIDERS[name] = make


def provider(name: str) -> Callable[[], Complete]:
    if name not in _PROVIDERS:
        raise UnsupportedProvider(f"unknown language model {name!r}; there are {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]


_SCHEMA = "answer_index int, text string, metadata string, error string"


def _rows(answer: str | None) -> list[tuple[int | None, str | None, str | None, str | None]]:
    try:
        return [(i, t, json.dumps({f"llm_{k}": v for k, v in m.items()}, ensure_ascii=False), None) for i, (t, m) in enumerate(map(chunk_of, records(answer)))]
    except CompletionError as e:
        return [(None, None, None, str(e))]


def parsed(answers: DataFrame, id: str = "id", answer: str = "answer") -> DataFrame:
    """(id, answer_index, text, metadata, error): a row for each record, or one with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, a in zip(b[id], b[answer], strict=True) for r in _rows(a)], columns=[id, "answer_index", "text", "metadata", "error"]).astype({"answer_index": "Int32"})

    return answers.select(id, answer).mapInPandas(run, f"{id} {answers.schema[id].dataType.simpleString()}, {_SCHEMA}")


def checked(made: DataFrame, most: int = 5) -> DataFrame:
    """``made`` (rows of ``parsed`` or ``chunked``, written before) if no row of it has an error, else a CompletionError."""
    bad = made.where("error is not null")
    first = bad.select("error").orderBy("error").limit(most).collect()
    if first:
        raise CompletionError(f"{bad.count()} calls failed: " + "; ".join(r["error"] for r in first))
    return made


def chunked(docs: DataFrame, prompt: str, complete: Complete | str, max_chars: int = 300_000, id: str = "doc_id", text: str = "text", sections: DataFrame | None = None) -> DataFrame:
    """The records that ``complete(system, user)`` makes of each text: (id, part, answer_index, text, metadata, error).

    A text over ``max_chars`` goes section by section if ``sections`` (id, chunk_index, text) are given, and
    else is cut. A call that fails is a row with its error, as callers see a CompletionError. ``complete`` may be the
    name of a registered model, and a null text is not asked for.
    """
    whole = docs.where(F.col(text).isNotNull()).select(id, F.lit(0).alias("part"), F.col(text).alias("t"))
    if sections is not None:
        long = whole.where(F.char_length("t") > max_chars).select(id)
        whole = whole.where(F.char_length("t") <= max_chars).unionByName(sections.join(long, id, "left_semi").select(id, F.col("chunk_index").alias("part"), F.col("text").alias("t")))
    src = whole.withColumn("t", F.left("t", F.lit(max_chars)))
    make = provider(complete) if isinstance(complete, str) else lambda: complete

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for b in text_runs(batches, "t"):
            out = []
            for at, t in enumerate(b.column("t").to_pylist()):
                try:
                    call = call or make()
                    got = _rows(call(SYSTEM, f"{prompt}\n\nThe text:\n{t}"))
                except Exception as e:  # the service's own errors become rows
                    got = [(None, None, None, told(CompletionError(str(e))))]
                out += [(at, *r) for r in got]
            at, *columns = zip(*out, strict=True) if out else [()] * 5
            own = [b.column(c).take(pa.array(at, pa.int64())) for c in (id, "part")]
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, kinds)], names=[id, "part", "answer_index", "text", "metadata", "error"])

    return src.mapInArrow(run, f"{id} {src.schema[id].dataType.simpleString()}, part int, {_SCHEMA}")
