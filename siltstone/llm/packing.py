"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

Documents longer than a bin are cut into pieces; full pieces have a bin each, and every other piece goes
into the fullest bin that still holds it and has no conflict with it. A bin carries bitmaps: one bit a
duplicate cluster (a bin holds at most one document of a cluster) and ``source_limit`` planes of one bit
a source (plane i: more than i documents of the source are in the bin). Bins are kept in order of what
room they have left; from the tightest that fits, the search goes on to the next larger room until it
meets a bin without conflict, or opens a new one.

Bins are filled within shards of about ``shard_items`` pieces. A piece's shard comes from its place in the
written table of pieces, not from its contents, so that neither a hot source nor a large cluster of
copies makes a shard larger than the others; a shard is the most that one task holds.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, n_words, read

CAPACITY = 4096
SOURCE_LIMIT = 4
SHARD_ITEMS = 2048


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, source_limit: int) -> list[int]:
    """The bin of each item, items taken in the given order. sources and clusters number from 0."""
    room: list[tuple[int, int]] = []  # (room left, bin), in order; bins without room are not listed
    own: list[int] = []  # bitmap of clusters
    planes: list[list[int]] = []  # bitmaps of sources
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        at = bisect_left(room, (length, -1))
        while at < len(room) and (own[room[at][1]] & c or planes[room[at][1]][-1] & s):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(own)
            own.append(0)
            planes.append([0] * source_limit)
        own[b] |= c
        for i, plane in enumerate(planes[b]):
            if not plane & s:
                planes[b][i] |= s
                break
        if left > length:
            insort(room, (left - length, b))
        out.append(b)
    return out


def _clusters(text):
    """Copies up to case and white space are one cluster."""
    return F.md5(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def pieces(docs: DataFrame, capacity: int, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, piece, start, length): documents without words have none."""
    cl = docs[cluster].cast("string") if cluster else _clusters(docs["text"])
    d = docs.select("doc_id", "source", cl.alias("cluster"), n_words(docs["text"]).alias("n")).where("n > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity).cast("long")))
    d = d.select("*", at.alias("piece"))
    return d.select("doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))


def packed(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_items: int = SHARD_ITEMS, cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, position, bin_words): a row for each piece of a document.

    ``start`` and ``length`` count words; ``bin_id`` is shard * 2**24 + number. Null texts and texts
    without words have no row; null sources share one bit, null clusters (of a given ``cluster`` column)
    another; repeated rows are copies of one cluster, and so lie in different bins; very long texts are cut into pieces;
    of pieces of one length (ties) that with the earlier place goes first; an empty table gives none; other columns are
    ignored. Shards, and so bins, follow from how rows lie in the files: the same files give the same bins.
    """
    with Scratch(spark) as s:
        items = s.table(pieces(docs, capacity, cluster).withColumn("uid", F.monotonically_increasing_id()))
        shards = max(1, -(-items.count() // shard_items))
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
            source, _ = pd.factorize(pdf["source"].fillna("\0"))
            group, _ = pd.factorize(pdf["cluster"].fillna("\0"))
            pdf["bin"] = best_fit(pdf["length"].tolist(), source.tolist(), group.tolist(), capacity, source_limit)
            pdf["bin_id"] = pdf["shard"] * 2**24 + pdf["bin"]
            by = pdf.groupby("bin")
            pdf["position"] = by.cumcount()
            pdf["bin_words"] = by["length"].transform("sum")
            return pdf[["doc_id", "piece", "start", "length", "bin_id", "position", "bin_words"]]

        kind = docs.schema["doc_id"].dataType.simpleString()
        out = dealt.groupBy("shard").applyInPandas(pack, f"doc_id {kind}, piece long, start long, length long, bin_id long, position long, bin_words long")
        return s.table(out, keep=True)


def sequences(packs: DataFrame, docs: DataFrame) -> DataFrame:
    """(bin_id, text): the words of each bin's pieces, joined by one space; a bin is at most its capacity.

    Needs doc_id to be unique in ``docs``; pieces of null ids and texts are left out; other columns are ignored.
    """
    words = F.regexp_extract_all(docs["text"], F.lit(r"([^\x20\x09-\x0D]+)"))
    d = packs.join(docs.select("doc_id", words.alias("words")), "doc_id")
    piece = F.struct("position", F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ").alias("text"))
    return d.groupBy("bin_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), " ").alias("text"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents; nulls, long texts, ties and repeats as in ``packed``."""
    return packed(spark, read(spark, sf_dir, "documents"))
