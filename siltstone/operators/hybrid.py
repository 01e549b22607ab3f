"""Hybrid search: vector and keyword legs, fused; optional rerank; a score floor that either leg may pass."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import SearchConfig
from siltstone.functions.validate import check_top_k
from siltstone.operators import bm25, dense, fusion, postings, rerank
from siltstone.operators.filters import filtered


def floor(fused: DataFrame, min_score: float) -> DataFrame:
    """Rows whose vector score, or keyword score as a share of its query's best, is at least ``min_score``."""
    best = F.max("b_score").over(Window.partitionBy("qid"))
    share = F.when(F.col("b_best") > 0, F.col("b_score") / F.col("b_best"))
    ok = F.coalesce(F.col("v_score") >= min_score, F.lit(False)) | F.coalesce(share >= min_score, F.lit(False))
    return fused.withColumn("b_best", best).where(ok).drop("b_best")


def search(docs: DataFrame, queries: DataFrame, top_k: int = 10, filters: Mapping[str, Any] | None = None, min_score: float | None = None, config: SearchConfig | None = None, scorer: rerank.Scorer | None = None, metadata: str | None = None, index: postings.Index | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, id, rank, rrf, v_rank, b_rank, v_score, b_score [, rerank]): the ``top_k`` best of every query.

    docs: (id, text, embedding ...); documents without an embedding take part in the keyword leg. queries:
    (qid, query, embedding). Filters come first, so that keyword statistics are of the filtered set; texts
    are joined only where a reranker needs them. The floor applies before the final cut. ``index``: a keyword index of
    ``docs`` that is used where there are no filters. ``vectors``: (id, embedding) where embeddings are in a table of their
    own, so that they meet the documents' ids and no texts.
    """
    cfg = config or SearchConfig()
    check_top_k(top_k, cfg.max_top_k)
    pool = cfg.candidates(top_k)
    d = filtered(docs, filters, metadata)
    rows = d if vectors is None else d.select("id").join(vectors.select("id", "embedding"), "id")
    v = dense.search_batch(rows, queries, pool, id="id", vector="embedding", qid="qid", query="embedding")
    b = index.search(queries, pool, cfg.k1, cfg.b) if index is not None and not filters else bm25.search(d, queries, pool, cfg.k1, cfg.b, id="id", text="text", qid="qid", query="query")
    out = fusion.fused(v, b, cfg.rrf_k, (cfg.vector_weight, cfg.bm25_weight))
    if scorer is not None or cfg.rerank:
        out = rerank.reranked(out, d, queries, pool, scorer or rerank.lexical)
    if min_score is not None and min_score > 0:
        out = floor(out, min_score)
    w = Window.partitionBy("qid").orderBy("rank")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def with_text(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The result with its documents' texts, joined after the cut; rows whose document is gone drop out."""
    return result.join(docs.select("id", "text"), "id")
