"""Dense top-k by cosine: exact, for one query or for a table of queries.

Vectors that are null, empty or hold null or non-finite components are left out, and so are those of another length than
the query's.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.functions.validate import check_top_k, check_vector
from siltstone.operators.filters import filtered
from siltstone.plans.joins import first_k, top_k

#: Queries that one pass holds on every executor, about.
MAX_QUERIES = 2048
#: Scores are rounded to so many places, so that equal rows tie however their sums were added.
DIGITS = 9
#: The most rows that a search may ask for.
MAX_K = 10_000
#: Products of a query and a row that a task holds at once, about.
MAX_PRODUCTS = 4_000_000


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and of finite components."""
    own = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & own, F.lit(False))


def search(rows: DataFrame, query: list[float], k: int = 10, filters: Mapping[str, Any] | None = None, min_score: float | None = None, id: str = "id", vector: str = "embedding", metadata: str | None = None) -> DataFrame:
    """(id, score, distance, rank) of the k rows nearest to one query; ``min_score`` applies after the cut.

    Filters apply before scoring; ties go to the smaller id.
    """
    check_top_k(k, MAX_K)
    query = check_vector(list(query))
    d = filtered(rows, filters, metadata).where(finite(F.col(vector)) & (F.size(vector) == len(query)))
    scored = d.select(F.col(id).alias("id"), F.round(V.cosine(F.col(vector), V.literal(query)), DIGITS).alias("score"))
    out = first_k(scored, k, [F.desc("score"), F.col("id")])
    out = out.select("id", "score", (1.0 - F.col("score")).alias("distance"), "rank")
    return out if min_score is None else out.where(F.col("score") >= min_score)


class Best:
    """Of each query the k best rows that a task has met; of equal scores those with the smaller ids."""

    def __init__(self, k: int, least: float = -np.inf):
        """Only scores above ``least`` count."""
        self.k, self.least = k, least
        self.held: list[pa.Table] = []  # of each query k rows or more, cut to k from time to time

    def add(self, s: np.ndarray, own: pa.Array, queries: np.ndarray | None = None) -> None:
        """Scores of queries (their numbers, else all in order) by rows, and the rows' ids."""
        k, rows = self.k, s.shape[1]
        take = s > self.least
        if rows > k:  # each query's k best of the batch
            edge = np.partition(s, rows - k, axis=1)[:, rows - k, None]
            take &= s >= edge
            crowded = np.flatnonzero(take.sum(axis=1) > k)
            order = np.asarray(own.to_pandas().rank(method="first").astype(int)) if len(crowded) else None
            for i in crowded:
                tied = np.flatnonzero(s[i] == edge[i])
                room = k - int((s[i] > edge[i]).sum())
                take[i, tied[np.argsort(order[tied])[room:]]] = False
        q_at, r_at = np.nonzero(take)
        self.held.append(pa.table({"q": pa.array(q_at if queries is None else queries[q_at]), "id": own.take(pa.array(r_at)), "score": pa.array(s[q_at, r_at])}))
        if len(self.held) >= 16:
            self.held = [self._cut()]

    def _cut(self) -> pa.Table:
        t = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        at = np.asarray(t.column("q"))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        place = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
        return t.filter(pa.array(place < self.k)).combine_chunks()

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(qid, id, score), given the queries' ids by their numbers."""
        if self.held:
            best = self._cut()
            yield from pa.table({"qid": ids.take(best.column("q").combine_chunks()), "id": best.column("id"), "score": best.column("score")}).combine_chunks().to_batches()


def search_batch(rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "id", vector: str = "embedding", qid: str = "qid", query: str = "embedding") -> DataFrame:
    """(qid, id, score, rank): the k nearest rows of every query.

    The queries go to every task as a matrix, in blocks of at most about ``MAX_QUERIES``, a pass over the rows for
    each; a task multiplies its rows with it batch by batch and passes on its k best for each query at its end, so
    that no pair of row and query is shuffled that could not be in the result.
    """
    check_top_k(k, MAX_K)
    queries = queries.where(finite(F.col(query)))
    lengths = [r[0] for r in queries.select(F.size(query)).distinct().orderBy(F.size(query)).collect()]
    if len(lengths) > 1:
        parts = [search_batch(rows, queries.where(F.size(query) == n), k, id, vector, qid, query) for n in lengths]
        return reduce(DataFrame.unionByName, parts)
    blocks = -(-queries.count() // MAX_QUERIES)
    if blocks > 1:
        of = F.pmod(F.xxhash64(qid), F.lit(blocks))
        parts = [search_batch(rows, queries.where(of == i), k, id, vector, qid, query) for i in range(blocks)]
        return reduce(DataFrame.unionByName, parts)
    held = queries.select(F.col(qid).alias("qid"), F.col(query).cast("array<double>").alias("q")).orderBy("qid").toArrow()
    q_ids = held.column("qid").combine_chunks()
    q = np.array(held.column("q").to_pylist(), np.float64).reshape(len(held), lengths[0] if lengths else 1)
    size = np.sqrt((q * q).sum(axis=1, keepdims=True))
    shared = rows.sparkSession.sparkContext.broadcast((q / np.where(size > 0, size, 1.0), q_ids))
    src = rows.where(finite(F.col(vector)) & (F.size(vector) == (lengths[0] if lengths else 0))).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids = shared.value
        best = Best(k)
        step = max(1, MAX_PRODUCTS // max(1, len(unit)))
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            if not len(unit):
                continue
            x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
            n = np.sqrt((x * x).sum(axis=1))
            best.add(np.round(unit @ (x / np.where(n > 0, n, 1.0)[:, None]).T, DIGITS), b.column("id"))
        yield from best.rows(ids)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = src.mapInArrow(run, f"qid {kind(queries, qid)}, id {kind(src, 'id')}, score double")
    return top_k(found, k, ["qid"], [F.desc("score"), F.col("id")])
