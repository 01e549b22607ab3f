"""Ingestion: files or texts to chunks to rows of a collection, idempotent by content hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.chunking.budget import Count, fit, words
from siltstone.chunking.sections import combined
from siltstone.chunking.tables import linear
from siltstone.config import CodecConfig
from siltstone.errors import ValidationError
from siltstone.functions import validate
from siltstone.functions.text import word_count
from siltstone.operators import embed, quantize
from siltstone.plans.scratch import written
from siltstone.sources import files
from siltstone.sources.collections import Store


def new_only(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose content is not there yet, each content once."""
    return incoming.join(existing.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def skipped(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    return incoming.join(existing.select("content_hash"), "content_hash", "left_semi")


def chunks(elements: DataFrame, budget: int = 256, least: int = 20, overlap: int = 32, count: Count = words, most: int = 5000, combine: int = 0) -> DataFrame:
    """(content_hash, chunk_index, total_chunks, text, tables, images) of each file's elements.

    A title starts a section; a table's lines stand in the text where it stood, its HTML beside it. With ``combine``, a
    section of fewer characters joins the one before it, if both fit in ``most`` (``sections.combined``).
    """
    cols = ["content_hash", "chunk_index", "total_chunks", "text", "tables", "images"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["kind"].notna()].sort_values(["range_no", "pos"])
        sections: list[tuple[list[str], list[str], list[str]]] = []
        for kind, text, image in zip(pdf["kind"], pdf["text"], pdf["image"], strict=True):
            if kind == "title" or not sections:
                sections.append(([], [], []))
            lines, tables, images = sections[-1]
            if kind == "table":
                tables.append(text)
                lines.append(linear(text))
            elif kind == "image":
                images.append(image)
            else:
                lines.append(text)
        whole: list[tuple[list[str], list[str], list[str]]] = []
        for group, own in zip(combined([len("\n".join(filter(None, s[0]))) for s in sections], most, combine), sections, strict=True):
            if group == len(whole):
                whole.append(own)
            else:
                for a, b in zip(whole[-1], own, strict=True):
                    a += b
        out = [c for s in whole for c in fit([("\n".join(filter(None, s[0])), s[1], s[2])], count, budget, least, overlap)]
        rows = [(pdf["content_hash"].iloc[0], i, len(out), *c) for i, c in enumerate(out)]
        return pd.DataFrame(rows, columns=cols)

    return elements.where("error is null").groupBy("content_hash").applyInPandas(one, "content_hash string, chunk_index int, total_chunks int, text string, tables array<string>, images array<string>")


def captioned(chunked: DataFrame, pictures: DataFrame) -> DataFrame:
    """(picture, chunk_index): each picture (content_hash, picture, caption) with the first chunk that holds its caption.

    chunked: (content_hash, chunk_index, refs), refs the element ids that a chunk was made of; a picture whose caption
    is in no chunk has a null chunk_index.
    """
    refs = chunked.select("content_hash", "chunk_index", F.explode("refs").alias("caption"))
    first = refs.groupBy("content_hash", "caption").agg(F.min("chunk_index").alias("chunk_index"))
    return pictures.join(first, ["content_hash", "caption"], "left").select("content_hash", "picture", "chunk_index")


def modality_counts(chunked: DataFrame) -> DataFrame:
    """One row: n_text, n_table, n_image; a chunk may count in each."""
    return chunked.agg(F.count_if(F.trim("text") != "").alias("n_text"), F.count_if(F.size("tables") > 0).alias("n_table"), F.count_if(F.size("images") > 0).alias("n_image"))


def failures(elements: DataFrame) -> DataFrame:
    """(content_hash, failed): the page ranges that could not be parsed, as text."""
    span = F.concat(F.col("first_page"), F.lit("-"), F.col("last_page"))
    bad = elements.where("error is not null").groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("range_no", span.alias("s")))).alias("f"))
    return bad.select("content_hash", F.array_join(F.transform("f", lambda x: x["s"]), ", ").alias("failed"))


def status(existing: Column, n_chunks: Column, failed: Column, force: bool = False) -> Column:
    """What became of a file: existing, its chunks already there; failed, the text of failed ranges or null."""
    bad = F.coalesce(failed, F.lit("")) != ""
    text = F.when(bad & (n_chunks == 0), F.concat(F.lit("FAILED to process: pages "), failed))
    text = text.when(bad, F.concat(F.lit("Partially processed: pages "), failed, F.lit(" failed; the document is PARTIALLY indexed")))
    text = text.when(n_chunks == 0, F.lit("Processed: no chunks")).otherwise(F.concat(F.lit("Successfully processed: "), n_chunks, F.lit(" chunks")))
    return text if force else F.when(existing > 0, F.lit("already ingested — skipped")).otherwise(text)


def rows_of(chunked: DataFrame, info: DataFrame, embedder: embed.Embedder, codec: quantize.Codec | None = None) -> DataFrame:
    """Collection rows of chunks; ids follow from content, so that a repeated run makes the same ones."""
    meta = F.to_json(F.struct("source_filename", "file_type", "total_chunks", (F.size("tables") > 0).alias("has_table"), (F.size("images") > 0).alias("has_image")))
    d = chunked.join(info.select("content_hash", "source_filename", "file_type").distinct(), "content_hash")
    d = d.select(F.sha2(F.concat_ws("/", "content_hash", "chunk_index"), 256).alias("id"), "text", F.col("content_hash").alias("document_id"), "content_hash", "chunk_index", meta.alias("metadata"))
    d = embed.embedded(d, embedder)
    return d if codec is None else d.join(quantize.encoded(d, codec), "id")


class Counts:
    """Counters that are taken while tables are written, with no pass of their own; ``values`` has those of what was written."""

    def __init__(self) -> None:
        self._taken: list[Observation] = []

    def of(self, df: DataFrame, **counters: Column) -> DataFrame:
        """``df``, observed: it has to be written once."""
        self._taken.append(Observation())
        return df.observe(self._taken[-1], *(F.coalesce(c, F.lit(0)).alias(k) for k, c in counters.items()))

    @property
    def values(self) -> dict[str, int]:
        return {k: v for o in self._taken for k, v in o.get.items()}


def ingest(store: Store, name: str, found: DataFrame, embedder: embed.Embedder, force: bool = False, budget: int = 256, codec: quantize.Codec | None = None, refused: DataFrame | None = None, counts: Counts | None = None, tasks: int | None = None, combine: int = 200) -> DataFrame:
    """Ingests files (``files.files``) into a collection; returns (source_filename, content_hash, chunks, status).

    ``counts`` has afterwards: elements, failed_ranges (ranges of pages that could not be parsed), chunks, and truncated (chunks
    over the embedder's limit of tokens), counted as they were written. ``tasks``: how many share the ranges of pages
    (``files.elements``). ``combine``: sections of fewer characters join the one before them.
    ``refused`` (``files.refused``): files that were left out, which are told of in the report. Content that is there is not parsed again, unless ``force``: then its rows are replaced in one step.
    """
    store.ensure(name, embedder.dimension)
    known = store.table(name).where("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("existing"))
    fresh = found.dropDuplicates(["content_hash"]) if force else new_only(found, known)
    counts = counts or Counts()
    failed = F.count_if(F.col("error").isNotNull())
    parsed = written(counts.of(files.elements(files.ranges(fresh), tasks), elements=F.count("kind"), failed_ranges=failed))
    made = written(counts.of(chunks(parsed, budget, combine=combine), chunks=F.count("*"), truncated=F.count_if(word_count(F.col("text")) > embedder.max_tokens)))
    # The report is written before the rows are, and is of what was there until then.
    report = found.select("source_filename", "content_hash").join(known, "content_hash", "left").join(made.groupBy("content_hash").agg(F.count("*").alias("chunks")), "content_hash", "left").join(failures(parsed), "content_hash", "left")
    n = F.coalesce("chunks", F.lit(0))
    report = report.select("source_filename", "content_hash", n.alias("chunks"), status(F.coalesce("existing", F.lit(0)), n, F.col("failed"), force).alias("status"))
    if refused is not None:
        report = report.unionByName(refused.select("source_filename", F.lit(None).cast("string").alias("content_hash"), F.lit(0).cast("long").alias("chunks"), F.concat(F.lit("Refused: "), "reason").alias("status")))
    report = written(report)
    rows = rows_of(made, found, embedder, codec)
    if force:
        store.replace(name, made.select("content_hash"), rows)
    else:
        store.append(name, rows)
    return report


def texts(store: Store, name: str, rows: DataFrame, embedder: embed.Embedder) -> int:
    """Stores inline texts (id, text, metadata); the collection is made if it is not there."""
    store.ensure(name, embedder.dimension)
    if rows.where(~validate.valid_text(F.col("text"))).limit(1).count():
        raise ValidationError("every text must have from 1 to 100000 characters that are not all white space")
    return store.guarded().append(name, embed.embedded(rows, embedder))


def content_id(text: str) -> str:
    """The content hash of a text, as rows have it."""
    return hashlib.sha256(text.encode()).hexdigest()


def with_codes(store: Store, name: str, rows: DataFrame, config: CodecConfig) -> int:
    """Appends rows (id, text, embedding ...), with codes of their vectors if the settings ask for them."""
    if not config.active:
        return store.append(name, rows)
    codec = quantize.Codec(store.info(name)["dimension"], config.bits, config.seed)
    return store.append(name, rows.join(quantize.encoded(rows, codec), "id", "left"))
