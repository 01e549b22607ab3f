"""Streaming ingestion into a collection: an extension of the batch way, with the same idempotency."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import embed
from siltstone.sources.collections import Store
from siltstone.sources.ingest import new_only


def start(stream: DataFrame, store: Store, name: str, embedder: embed.Embedder, checkpoint: str) -> StreamingQuery:
    """Appends the new texts of a stream (text, metadata): each content once.

    Which contents have come is the query's state, by content hash, so that a batch costs what it brings, however large the
    collection is; only the first batch is held against what the collection had before. The number of the last batch is
    in the collection's head: a batch that is run again after a failure adds nothing. Contents that other writers add
    after the first batch are not known to the state.
    """
    store.ensure(name, embedder.dimension)
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        if source not in store._head(name).get("streams", {}):
            batch = new_only(batch, store.table(name).where("content_hash is not null"))
        store.append_batch(name, embed.embedded(batch.withColumn("id", F.col("content_hash")), embedder), source, number)

    rows = stream.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["content_hash"])
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
