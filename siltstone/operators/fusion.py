"""Weighted reciprocal rank fusion of two legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fused(vector: DataFrame, keyword: DataFrame, k: int = 60, weights: tuple[float, ...] = (1.0, 1.0), top: int | None = None) -> DataFrame:
    """(qid, id, rrf, v_rank, b_rank, v_score, b_score, rank) from two rankings (qid, id, score, rank).

    The score is the sum over legs of weight / (k + rank). Ties go to the better rank of the vector leg
    (ranked rows before others), then of the keyword leg, then to the smaller id.
    """
    if len(weights) != 2:
        raise ValueError("one weight for each leg")
    v = vector.select("qid", "id", F.col("rank").alias("v_rank"), F.col("score").alias("v_score"))
    b = keyword.select("qid", "id", F.col("rank").alias("b_rank"), F.col("score").alias("b_score"))
    both = v.join(b, ["qid", "id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf", part(weights[0], "v_rank") + part(weights[1], "b_rank"))
    order = [F.desc("rrf"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank"), F.col("id")]
    out = both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return out if top is None else out.where(F.col("rank") <= top)
