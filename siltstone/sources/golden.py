"""Golden questions from JSON lines, and reports of evaluations as files."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, question string, ground_truth_answer string, ground_truth_chunk_indices array<int>, metadata struct<difficulty: string>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of JSON-lines files; blank lines are no rows, lines that are not JSON raise."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def truth(golden: DataFrame) -> DataFrame:
    """(qid, item): the chunks that answer each question; null for questions that nothing answers."""
    return golden.select(F.col("id").alias("qid"), F.explode_outer("ground_truth_chunk_indices").alias("item"))


def report(scores: DataFrame, overall: DataFrame, path: str, name: str = "report") -> str:
    """Writes scores by query as JSON lines and, beside them, a Markdown table of the one row of ``overall``; returns the folder."""
    at = f"{path.rstrip('/')}/{name}-{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    scores.write.json(f"{at}/queries")
    figure = lambda c: F.format_string("| %s | %.4f |", F.lit(c), F.col(c).cast("double"))
    lines = [F.lit(f"# {name}"), F.lit(""), F.lit("| measure | value |"), F.lit("|---|---|"), *map(figure, overall.columns)]
    overall.select(F.concat_ws("\n", *lines).alias("value")).coalesce(1).write.text(f"{at}/summary")
    return at


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """``rows`` as one column of JSON objects with ISO times; null columns are kept as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias(name))
