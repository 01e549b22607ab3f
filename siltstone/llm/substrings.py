"""Substring dedup by seed and extend on winnowed anchors.

Seeds: of every ``window`` consecutive words (13) the least hash of the ``anchor``-word runs (4) within
them is an anchor, so that two documents with a common window have a common anchor inside it, at the same
place. Documents are joined on anchors: an anchor that occurs in one document only is dropped, and with it
most of the corpus. Extension: an anchor that is left is extended both ways to the windows that it stands
for (up to ten, those of which it is the least run); a window is matched by its words, a 64-bit hash of one
half of their BLAKE2b digests beside the 64-bit hash of its anchor by the other half, so that words which
share one do not share the other, and the smallest doc_id that has it is known after one combined aggregation. Overlapping and adjacent matched windows join to maximal repeats, all at least ``window``
words long, and these are removed.

No pair of documents is formed: a group of n occurrences costs n rows, and minima are combined before
they are shuffled. Copies of a whole text are one class with its smallest doc_id; only that one is
seeded, the others are repeats from end to end (if they are as long as a window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, Tokens, gram_hashes, map_rows, map_runs, read, texts, tokenized

WINDOW, ANCHOR = 13, 4


def anchors(t: Tokens, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash at every place, places where windows begin, place of each window's anchor): of equal runs the last counts."""
    h = t.hashes[0][t.ids]
    g, starts, width = gram_hashes(h, anchor, salt=1), t.runs_of(window), window - anchor + 1
    n = max(0, len(g) - width + 1)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = g[j : j + n]
        take = other <= least
        least = np.where(take, other, least)
        at = np.where(take, np.arange(j, j + n), at)
    return g, starts, at[starts]


def _seeds(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, doc_id, place): the anchors of each document."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenized(b.column("text"))
        g, _, at = anchors(t, window, anchor)
        at = np.unique(at)
        of = t.text[at]
        yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), b.column("doc_id").take(pa.array(of)), pa.array((at - t.starts[of]).astype(np.int32))], names=["a", "doc_id", "place"])

    return map_runs(docs.select("doc_id", "text"), run, "a long, doc_id long, place int")


def _windows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, w, doc_id, th, place): the windows of the anchors at each document's ``places``.

    A window is known by 128 bits: its anchor's hash of one half of the words' digests, its own hash of the other half.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenized(b.column("text"))
        g, starts, at = anchors(t, window, anchor)
        lens = np.asarray(b.column("places").value_lengths())
        wanted = np.zeros(len(t.ids) + 1, bool)
        wanted[np.minimum(np.asarray(b.column("places").flatten()) + np.repeat(t.starts, lens), len(t.ids))] = True
        own = wanted[at]
        starts, at = starts[own], at[own]
        w, of = gram_hashes(t.hashes[1][t.ids], window, salt=2)[starts], pa.array(t.text[starts])
        cols = [pa.array(g[at].view(np.int64)), pa.array(w.view(np.int64)), b.column("doc_id").take(of), b.column("th").take(of), pa.array((starts - t.starts[t.text[starts]]).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "w", "doc_id", "th", "place"])

    return map_runs(docs.select("doc_id", "th", "places", "text"), run, "a long, w long, doc_id long, th long, place int")


def repeats(scratch: Scratch, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, whole, starts): a written table of what each document repeats of a smaller doc_id.

    th: xxhash64 of the text, for ids that several texts have. ``whole``: a copy of the whole text has a
    smaller id. ``starts``: the places of its windows that occur in a smaller id.
    """
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    th = F.xxhash64("text").alias("th")
    rows = scratch.table(known.select("doc_id", th, F.unhex(F.md5("text")).alias("digest")))
    # Minima are written before they are joined back: with a plain shuffle on both sides, adaptive execution splits
    # the join of a hot text, anchor or window.
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    first = scratch.table(first.select("digest", "first"))
    copies = scratch.table(rows.join(first, "digest").where("doc_id > first").select("doc_id", "th").distinct())
    once = known.withColumn("th", F.xxhash64("text")).join(copies, ["doc_id", "th"], "left_anti")
    seeds = _seeds(once, window, anchor)
    shared = seeds.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("a")
    found = scratch.table(seeds.join(scratch.table(shared), "a").select("doc_id", "place"))
    places = found.groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    spread = scratch.table(_windows(once.join(places, "doc_id"), window, anchor))
    least = spread.groupBy("a", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("a", "w", "first")
    hit = scratch.table(spread.join(scratch.table(least), ["a", "w"]).where("doc_id > first").select("doc_id", "th", "place"))
    scratch.drop(spread)
    starts = hit.groupBy("doc_id", "th").agg(F.collect_set("place").alias("starts")).withColumn("whole", F.lit(False))
    every = copies.select("doc_id", "th", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    return scratch.table(starts.unionByName(every).select("doc_id", "th", "whole", "starts"), keep=True)


def kept_mask(n: int, whole: bool, starts: np.ndarray | None, window: int = WINDOW) -> np.ndarray:
    """Which of a document's n words stay."""
    if whole:
        return np.full(n, n < window)
    step = np.zeros(n + 1, np.int32)
    if starts is not None:
        np.add.at(step, starts, 1)
        np.add.at(step, np.minimum(np.asarray(starts) + window, n), -1)
    return np.cumsum(step[:-1]) == 0


def _marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, whole, starts) for each row of ``docs``; rows without an id or text are not joined."""
    src = docs.select("doc_id", "text")
    some = src.where("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    out = some.join(marks, ["doc_id", "th"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts")
    none = src.where("doc_id is null or text is null").select("doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    return out.unionByName(none)


def spans(keep: np.ndarray) -> list[tuple[int, int]]:
    """The maximal repeats, as [start, end) of words."""
    step = np.diff(np.concatenate([[1], keep.astype(np.int8), [1]]))
    return list(zip(np.flatnonzero(step == -1).tolist(), np.flatnonzero(step == 1).tolist(), strict=True))


def removed(spark: SparkSession, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats), and kept_text if asked for: a row for each row of ``docs``.

    ``repeats``: the maximal repeats, as structs of first word and word after the last. Null texts have no
    words; rows without a doc_id neither lose nor lend words; of rows that share a doc_id none is smaller
    than another; of windows that tie (the same words in several documents) the smallest doc_id keeps them; very
    long texts are taken whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    with Scratch(spark) as s:
        marks = repeats(s, docs, window, anchor)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for t, whole, starts in zip(texts(b.column("text")), b.column("whole").to_pylist(), b.column("starts"), strict=True):
            words = t.split()
            at = np.asarray(starts.values) if starts.is_valid else None
            keep = kept_mask(len(words), whole, at, window)
            left = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            text = b" ".join(left)
            rows.append((len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), [{"start": a, "end": z} for a, z in spans(keep)], text if with_text else b""))
        n, gone, sha, at, text = zip(*rows, strict=True)
        cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(at, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"]
        if with_text:
            cols, names = [*cols, pa.array([x.decode() for x in text])], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:long,end:long>>"
    return map_rows(_marked(docs, marks), run, schema + ", kept_text string" * with_text)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, long texts, ties and repeats as in ``removed``."""
    return removed(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM f WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""
