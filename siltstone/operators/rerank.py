"""Reranking of a candidate pool: pluggable scorers (query, text) -> score."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import UnsupportedProvider
from siltstone.functions.text import tokens
from siltstone.plans.joins import bounded
from siltstone.plans.scratch import written

Scorer = Callable[[Column, Column], Column]


def lexical(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def model(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer from a model that is loaded once for each task and scores pairs in batches."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for q, t in pairs:
            yield pd.Series(score(q.tolist(), t.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")


_SCORERS: dict[str, Scorer] = {"lexical": lexical}


def register(name: str, scorer: Scorer) -> None:
    _SCORERS[name] = scorer


def scorer(name: str) -> Scorer:
    if name not in _SCORERS:
        raise UnsupportedProvider(f"unknown reranker {name!r}")
    return _SCORERS[name]


def reranked(pool: DataFrame, texts: DataFrame, queries: DataFrame, candidates: int, score: Scorer = lexical) -> DataFrame:
    """``pool`` (qid, id, rank ...) cut to ``candidates``, ordered anew by score; unscored rows last, ties as they were."""
    cut = written(pool.where(F.col("rank") <= candidates))  # its ids are counted, and only their texts are shuffled
    t = texts.select("id", F.col("text").alias("__text")).join(bounded(cut.select("id").distinct()), "id", "left_semi")
    q = queries.select("qid", F.col("query").alias("__query"))
    d = cut.join(t, "id", "left").join(q, "qid").withColumn("rerank", score(F.col("__query"), F.col("__text")))
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank"), F.col("rank"))
    return d.withColumn("new_rank", F.row_number().over(w)).drop("__text", "__query", "rank").withColumnRenamed("new_rank", "rank")
