"""Title sections: elements of a document packed into chunks that never cross a title."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.chunking import markup
from siltstone.functions.runs import in_groups, text_runs


def html_elements(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, kind, text): headings, tables and runs of text of HTML pages, in order; nothing that is shown is left out.

    Scripts, styles and comments are not text; tables stay as HTML, whole with the tables in them; tags of blocks end a run of
    text; only real tags are taken away, and references are characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_runs(batches, html):
            made = [markup.elements(page) for page in b.column(html).to_pylist()]
            found = [(i, pos, kind, text) for i, own in enumerate(made) for pos, (kind, text) in enumerate(own)]
            at, *columns = zip(*found, strict=True) if found else [()] * 4
            kinds = (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(id).take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names=[id, "pos", "kind", "text"])

    return pages.select(id, html).mapInArrow(run, f"{id} {pages.schema[id].dataType.simpleString()}, pos int, kind string, text string")


def line_elements(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 8) -> DataFrame:
    """(id, pos, kind, text): the lines of plain texts as they are, without blank ones; those of at most ``most`` words are titles.

    A null text has no lines.
    """
    lines = docs.select(id, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text"))
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return lines.where(n > 0).select(id, "pos", F.when(n <= most, "title").otherwise("text").alias("kind"), "text")


def numbered(elements: DataFrame, id: str = "page_id") -> DataFrame:
    """Elements with the number of their section: every title starts one."""
    w = Window.partitionBy(id).orderBy("pos")
    return elements.withColumn("section", F.sum((F.col("kind") == "title").cast("int")).over(w))


def _packed(texts: list[str], most: int, combine: int) -> list[str]:
    out: list[str] = []
    for t in texts:
        cut = [t[i : i + most] for i in range(0, len(t), most)]
        for part in cut:
            if out and len(out[-1]) + 2 + len(part) <= most and (len(cut) == 1 or len(out[-1]) < combine):
                out[-1] += "\n\n" + part
            else:
                out.append(part)
    return out


def packed_sections(parts: list[list[str]], most: int = 5000, combine: int = 0) -> list[str]:
    """The chunks of a document's sections, given as lists of texts. With ``combine``, a section shorter than that joins the one before it, if both fit."""
    out: list[str] = []
    for texts in parts:
        chunks = _packed(texts, most, combine)
        if combine and out and len(chunks) == 1 and len(chunks[0]) < combine and len(out[-1]) + 2 + len(chunks[0]) <= most:
            out[-1] += "\n\n" + chunks[0]
        else:
            out += chunks
    return out


def combined(sizes: list[int], most: int = 5000, combine: int = 200) -> list[int]:
    """For each section of a document, given by its characters, the number of the group that it is in: a section shorter than
    ``combine`` joins the group before it, if both fit; two more characters part them."""
    groups: list[int] = []
    held = 0
    for n in sizes:
        if groups and n < combine and held + 2 + n <= most:
            groups.append(groups[-1])
            held += 2 + n
        else:
            groups.append(groups[-1] + 1 if groups else 0)
            held = n
    return groups


def sections(elements: DataFrame, most: int = 5000, combine: int = 0, id: str = "page_id") -> DataFrame:
    """(id, chunk_index, text): chunks of at most ``most`` characters.

    With ``combine``, a section shorter than that joins the one before it, if both fit.
    """

    def one(own: list[tuple]) -> list[tuple]:
        parts: list[list[str]] = [[]]  # every title starts one
        for kind, t in own:
            if kind == "title":
                parts.append([])
            parts[-1].append(t)
        return list(enumerate(packed_sections([p for p in parts if p], most, combine)))

    return in_groups(elements, [id], "pos", one, ["kind", "text"], "chunk_index int, text string")


def raw_text(elements: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, text): all elements of a document, one on a line."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return elements.groupBy(id).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
