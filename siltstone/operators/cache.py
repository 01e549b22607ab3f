"""A table of embeddings by model and text, kept between ingestions: only texts that were never met are embedded.

Texts are told by SHA-256. A run adds what it embedded, and tells which texts it used, as files of its own; ``evict`` keeps
what the last runs used. A row that is there twice, from two runs at once, is one: equal texts have equal embeddings.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.validate import check_name
from siltstone.operators.embed import Embedder
from siltstone.plans.scratch import written
from siltstone.sources.collections import Store

_KNOWN, _USED = "digest binary, embedding array<float>", "digest binary"


@dataclass(frozen=True)
class Cache:
    """The embeddings of one model under a path; another model, or another version of it, has another name."""

    spark: SparkSession
    path: str
    model: str

    def __post_init__(self) -> None:
        check_name(self.model)

    def _table(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{self.model}/{what}/{run}" for run in self.runs(what)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def runs(self, what: str = "used") -> list[str]:
        """The runs that left something, in order."""
        fs, p = Store(self.spark, self.path).file(f"{self.path}/{self.model}/{what}")
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(done, key=lambda x: int(x.split("-")[1]))

    def count(self) -> int:
        return self._table("known", _KNOWN).select("digest").distinct().count()

    def embedded(self, rows: DataFrame, embedder: Embedder) -> DataFrame:
        """``rows`` with ``embedding`` (null for a null text): texts of this cache are not embedded again.

        What is new is written before it is used, so that a run that fails later has not embedded in vain.
        """
        number = 1 + max((int(r.split("-")[1]) for r in (*self.runs(), *self.runs("known"))), default=0)
        run = f"run-{number:06d}-{uuid.uuid4().hex[:8]}"
        d = rows.withColumn("__digest", F.unhex(F.sha2("text", 256)))
        own = written(d.where("__digest is not null").groupBy(F.col("__digest").alias("digest")).agg(F.any_value("text").alias("text")))
        fresh = own.join(self._table("known", _KNOWN).select("digest"), "digest", "left_anti")
        fresh.select("digest", embedder.apply(F.col("text")).alias("embedding")).write.parquet(f"{self.path}/{self.model}/known/{run}")
        own.select("digest").write.parquet(f"{self.path}/{self.model}/used/{run}")
        known = self._table("known", _KNOWN).join(own.select("digest"), "digest", "left_semi").groupBy(F.col("digest").alias("__digest")).agg(F.any_value("embedding").alias("embedding"))
        return d.join(known, "__digest", "left").drop("__digest")

    def evict(self, keep_runs: int) -> int:
        """Keeps the embeddings that one of the last ``keep_runs`` runs used; returns how many are left."""
        used, known = self.runs(), self.runs("known")
        kept = used[-keep_runs:] if keep_runs > 0 else []
        recent = self.spark.read.schema(_USED).parquet(*[f"{self.path}/{self.model}/used/{r}" for r in kept]).distinct() if kept else self.spark.createDataFrame([], _USED)
        number = max((int(r.split("-")[1]) for r in (*used, *known)), default=0)
        merged = f"run-{number:06d}-{uuid.uuid4().hex[:8]}"
        left = self._table("known", _KNOWN).join(recent, "digest", "left_semi").dropDuplicates(["digest"])
        left.write.parquet(f"{self.path}/{self.model}/known/{merged}")
        for what, names in (("known", known), ("used", [r for r in used if r not in kept])):
            for r in names:
                fs, p = Store(self.spark, self.path).file(f"{self.path}/{self.model}/{what}/{r}")
                fs.delete(p, True)
        return self.count()
