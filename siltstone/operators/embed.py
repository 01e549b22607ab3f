"""Embedding plug-ins, applied once to each distinct text."""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import UnsupportedProvider
from siltstone.functions.text import tokens, word_count


#: Tokens that are counted at once, about; words whose hashes a worker remembers.
RUN_TOKENS, REMEMBERED = 500_000, 200_000


@dataclass(frozen=True)
class Embedder:
    """``load`` makes, once for each task, a function of a batch of texts to their vectors; or ``column`` is one."""

    dimension: int
    load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None
    column: Callable[[Column], Column] | None = None
    max_tokens: int = 256

    def apply(self, text: Column) -> Column:
        if self.column is not None:
            return self.column(text)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            f = self.load()
            for s in batches:
                yield pd.Series(f(s.tolist()))

        return F.pandas_udf(run, "array<float>")(text)


def hashing(dimension: int = 64) -> Embedder:
    """Signed token hashing, normalised: a deterministic stand-in, not a semantic model."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}

        def hashed(word: str) -> int:
            h = known.get(word)
            if h is None:
                h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
                if len(known) < REMEMBERED:
                    known[word] = h
            return h

        def vectors(toks: pa.ListArray) -> np.ndarray:
            doc = np.repeat(np.arange(len(toks)), np.asarray(toks.value_lengths()))
            own = toks.flatten().dictionary_encode()
            h = np.fromiter(map(hashed, own.dictionary.to_pylist()), np.int64, len(own.dictionary))[np.asarray(own.indices)]
            v = np.bincount(doc * dimension + h // 2 % dimension, 1.0 - 2.0 * (h % 2), len(toks) * dimension).reshape(len(toks), dimension)
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            return (v / np.where(size > 0, size, 1.0)).astype(np.float32)

        for s in batches:
            # Runs bounded by tokens, not by rows.
            cuts = np.flatnonzero(np.diff(np.cumsum(np.asarray(s.value_lengths())) // RUN_TOKENS)) + 1
            made = [vectors(s.slice(a, b - a)) for a, b in pairwise([0, *cuts.tolist(), len(s)]) if b > a]
            flat = np.concatenate([np.empty((0, dimension), np.float32), *made]).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dimension, pa.int32()), pa.array(flat))

    each = F.arrow_udf(run, "array<float>")
    return Embedder(dimension, column=lambda c: each(tokens(c)))


_PROVIDERS: dict[str, Callable[[int], Embedder]] = {"hashing": hashing}


def register(name: str, make: Callable[[int], Embedder]) -> None:
    _PROVIDERS[name] = make


def provider(name: str, dimension: int = 64) -> Embedder:
    if name not in _PROVIDERS:
        raise UnsupportedProvider(f"unknown embedding provider {name!r}")
    return _PROVIDERS[name](dimension)


def embedded(rows: DataFrame, embedder: Embedder, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``embedding``: every distinct text is embedded once; ``known`` (text, embedding) is not embedded again.

    Texts are joined by their SHA-256; a null text has a null embedding.
    """
    digest = F.unhex(F.sha2("text", 256))
    d = rows.withColumn("__digest", digest)
    own = d.where("__digest is not null").groupBy("__digest").agg(F.any_value("text").alias("text"))
    if known is not None:
        known = known.where("text is not null").select(digest.alias("__digest"), F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["__digest"])
        own = own.join(known.select("__digest"), "__digest", "left_anti")
    fresh = own.select("__digest", embedder.apply(F.col("text")).alias("embedding"))
    return d.join(fresh if known is None else fresh.unionByName(known), "__digest", "left").drop("__digest")


def truncations(rows: DataFrame, limit: int) -> DataFrame:
    """One row: n, n_truncated: texts over the model's limit of tokens."""
    return rows.agg(F.count("*").alias("n"), F.count_if(word_count(F.col("text")) > limit).alias("n_truncated"))
