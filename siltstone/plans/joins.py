"""Joins with small sides, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has at most so many rows.
BROADCAST_ROWS = 50_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows; beyond that Spark shuffles the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def one_row(df: DataFrame) -> DataFrame:
    """An aggregate without groups, which is one row by construction."""
    return F.broadcast(df)


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts each task's rows to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_k(df: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of all, with their rank: the cut comes before the numbering, so that only k rows meet."""
    cut = df.orderBy(*order).limit(k)
    return cut.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
