"""A second search leg in operation: sampled questions of a stream are asked again, and the overlaps kept by window.

The main result is an input here and is never touched: what goes wrong in the second leg is a row of the table,
and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.errors import ValidationError, told
from siltstone.operators import evaluate

#: Questions (qid, query, embedding) to rankings (qid, id, rank).
Leg = Callable[[DataFrame], DataFrame]
SEED = 17
_STEPS = 1_000_000
SCHEMA = "qid string, asked timestamp, n_real int, overlap double, error string"


def sampled(served: DataFrame, share: float) -> DataFrame:
    """The same ``share`` of questions by the hash of their qid, whatever batch they come in; none has a null qid."""
    if not 0 < share <= 1:
        raise ValidationError(f"the share of questions has to be above 0 and at most 1, not {share}")
    return served.where(F.col("qid").isNotNull() & (F.pmod(F.xxhash64(F.lit(SEED), F.col("qid").cast("string")), F.lit(_STEPS)) < round(share * _STEPS)))


def compared(served: DataFrame, leg: Leg, k: int = 10) -> DataFrame:
    """(qid, asked, n_real, overlap, error) of served questions (qid, query, embedding, asked, ids), ids in the order served.

    Of a question that came more than once in these rows the last counts; null ids are an empty result; if both
    results are empty, the overlap is 1.
    """
    last = served.groupBy("qid").agg(F.max_by(F.struct("query", "embedding", "asked", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")), F.coalesce("asked", F.lit("1970-01-01").cast("timestamp"))).alias("q"))
    last = last.select("qid", "q.*")
    real = last.select("qid", F.posexplode(F.slice("ids", 1, k)).alias("rank", "id")).withColumn("rank", F.col("rank") + 1)
    both = evaluate.overlap(real, leg(last.select("qid", "query", "embedding")), k)
    out = last.join(both, "qid", "left")
    return out.select(F.col("qid").cast("string").alias("qid"), "asked", F.least(F.size("ids"), F.lit(k)).alias("n_real"), F.coalesce("overlap", F.lit(1.0)).alias("overlap"), F.lit(None).cast("string").alias("error"))


def start(served: DataFrame, leg: Leg, path: str, checkpoint: str, share: float = 0.1, k: int = 10) -> StreamingQuery:
    """Follows a stream of served questions (see ``compared``); ``table`` and ``windows`` read what it keeps under ``path``.

    A batch has a folder of its own, which is replaced if the batch is run again: no question counts twice for it. If the
    second leg fails, the batch is one row that tells why.
    """
    chosen = sampled(served, share)
    spark = served.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        to = f"{path.rstrip('/')}/batch={number}"
        try:
            compared(batch, leg, k).write.mode("overwrite").parquet(to)
        except Exception as e:  # noqa: BLE001 - the second leg must not stop what is observed
            spark.createDataFrame([(None, None, None, None, told(e)[:1000])], SCHEMA).write.mode("overwrite").parquet(to)

    return chosen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """(qid, asked, n_real, overlap, error, batch) of all batches so far."""
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(path)


def windows(kept: DataFrame, length: str = "1 hour") -> DataFrame:
    """(began, n, overlap, least, agreed): questions of each window of time, the mean and least overlap, and those that agree wholly."""
    w = F.window("asked", length)
    return kept.where("error is null and asked is not null").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("overlap").alias("overlap"), F.min("overlap").alias("least"), F.count_if(F.col("overlap") == 1).alias("agreed")).select(F.col("w.start").alias("began"), "n", "overlap", "least", "agreed")
