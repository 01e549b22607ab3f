"""File sources: documents as elements, through parsers that run where the bytes are.

``binaryFile`` reads paths and contents; a parser turns one file (or a range of its pages) into elements
(kind, text, page, image). Markdown, DOCX and PPTX are built in; PDF and others are plug-ins. A range that
cannot be parsed is a row with its error, so that the rest of the file is indexed and the failure shows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ParseError, UnsupportedDocument
from siltstone.functions.text import basename, extension
from siltstone.functions.validate import EXTENSIONS, valid_file

#: (content, first page, last page) -> (kind, text, page, image as base64 or None); kinds: title, text, table, image
Parser = Callable[[bytes, int, int], list[tuple[str, str, int, str | None]]]
#: Pages of a file, for those that are split into ranges.
PageCount = Callable[[bytes], int]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _html(rows: list[list[str]]) -> str:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return "<table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def markdown(content: bytes, first: int = 1, last: int = 0) -> list[tuple[str, str, int, str | None]]:
    out: list[tuple[str, str, int, str | None]] = []
    table: list[list[str]] = []
    para: list[str] = []

    def flush() -> None:
        if para:
            out.append(("text", " ".join(para), 1, None))
            para.clear()
        if table:
            out.append(("table", _html([r for r in table if not all(re.fullmatch(r":?-+:?", c) for c in r)]), 1, None))
            table.clear()

    for line in content.decode("utf-8", "replace").splitlines():
        s = line.strip()
        if s.startswith("|") and s.count("|") > 1:
            if para:
                flush()
            table.append([c.strip() for c in s.strip("|").split("|")])
            continue
        if table or not s or s.startswith("#"):
            flush()
        if s.startswith("#"):
            out.append(("title", s.lstrip("#").strip(), 1, None))
        elif s:
            para.append(s)
    flush()
    return [e for e in out if e[1]]


def docx(content: bytes, first: int = 1, last: int = 0) -> list[tuple[str, str, int, str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
        out: list[tuple[str, str, int, str | None]] = []
        for e in body if body is not None else ():
            if e.tag == f"{_W}p" and text(e):
                style = e.find(f"{_W}pPr/{_W}pStyle")
                head = style is not None and re.match("(?i)heading|title", style.get(f"{_W}val", ""))
                out.append(("title" if head else "text", text(e), 1, None))
            elif e.tag == f"{_W}tbl":
                out.append(("table", _html([[text(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]), 1, None))
        out += [("image", "", 1, base64.b64encode(z.read(n)).decode()) for n in z.namelist() if n.startswith("word/media/")]
        return out


def pptx(content: bytes, first: int = 1, last: int = 0) -> list[tuple[str, str, int, str | None]]:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    out: list[tuple[str, str, int, str | None]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for folder in ("slides/slide", "notesSlides/notesSlide"):
            for name in sorted((n for n in z.namelist() if re.fullmatch(rf"ppt/{folder}\d+\.xml", n)), key=number):
                root = ElementTree.fromstring(z.read(name))
                text = lambda e: "".join(t.text or "" for t in e.iter(f"{_A}t")).strip()
                tables = list(root.iter(f"{_A}tbl"))
                inside = {id(p) for t in tables for p in t.iter(f"{_A}p")}
                paras = [text(p) for p in root.iter(f"{_A}p") if id(p) not in inside and text(p)]
                out += [("title" if i == 0 and folder.startswith("slides") else "text", t, number(name), None) for i, t in enumerate(paras)]
                out += [("table", _html([[text(c) for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")]), number(name), None) for t in tables]
    return sorted(out, key=lambda e: e[2])


PARSERS: dict[str, tuple[Parser, PageCount | None]] = {".md": (markdown, None), ".docx": (docx, None), ".pptx": (pptx, None)}


def register(ext: str, parser: Parser, pages: PageCount | None = None) -> None:
    """A parser for an extension; with ``pages`` its files are parsed in ranges of pages, in parallel."""
    if ext not in EXTENSIONS:
        raise UnsupportedDocument(f"{ext!r} is not one of {', '.join(EXTENSIONS)}")
    PARSERS[ext] = (parser, pages)


def files(spark: SparkSession, path: str, glob: str | None = None, max_mb: float = 20.0) -> DataFrame:
    """(path, length, content, content_hash, source_filename, file_type) of supported files of at most ``max_mb`` under a path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    d = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return d.where(valid_file(F.col("path"), F.col("length"), max_mb)).select("path", "length", "content", F.sha2("content", 256).alias("content_hash"), basename(F.col("path")).alias("source_filename"), extension(F.col("path")).alias("file_type"))


def refused(spark: SparkSession, path: str, max_mb: float = 20.0) -> DataFrame:
    """(path, source_filename, length, reason) of the files under a path that ``files`` leaves out; no contents are read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = extension(F.col("path"))
    reason = F.when(~kind.isin(*EXTENSIONS), F.concat(F.lit("its type is not one of "), F.lit(", ".join(EXTENSIONS)))).otherwise(F.concat(F.lit("it is larger than "), F.lit(f"{max_mb:g} MB")))
    return d.where(~valid_file(F.col("path"), F.col("length"), max_mb)).select("path", basename(F.col("path")).alias("source_filename"), "length", reason.alias("reason"))


def ranges(found: DataFrame, per_range: int = 25, whole_under: int = 30) -> DataFrame:
    """Files with (range_no, first_page, last_page): one range of all pages (0: unknown), or several of ``per_range``."""
    counts = {e: p for e, (_, p) in PARSERS.items() if p is not None}

    def cut(content: bytes, ext: str) -> list[dict[str, int]]:
        try:
            n = counts[ext](content) if ext in counts else 0
        except Exception:  # what cannot be counted is tried as a whole, and told of there
            n = 0
        starts = range(1, n + 1, per_range) if n >= whole_under else [1]
        return [{"range_no": i, "first_page": a, "last_page": min(a + per_range - 1, n) if n >= whole_under else n} for i, a in enumerate(starts)]

    @F.pandas_udf("array<struct<range_no:int,first_page:int,last_page:int>>")
    def each(content: pd.Series, ext: pd.Series) -> pd.Series:
        return pd.Series([cut(bytes(c), e) for c, e in zip(content, ext, strict=True)])

    # Only files that have pages to count are sent to be counted.
    whole = F.array(F.struct(F.lit(0).alias("range_no"), F.lit(1).alias("first_page"), F.lit(0).alias("last_page")))
    r = F.when(F.col("file_type").isin(*counts), each("content", "file_type")).otherwise(whole) if counts else whole
    return found.withColumn("r", F.explode(r)).select(*found.columns, "r.*")


_ELEMENTS = "content_hash string, source_filename string, file_type string, range_no int, first_page int, last_page int, pos int, kind string, text string, page int, image string, error string"


_KEYS = ["content_hash", "source_filename", "file_type", "range_no", "first_page", "last_page"]


def fetched(path: str, content_hash: str) -> bytes:
    """The bytes of a file, read where a task runs; an error if they are no longer those of the hash."""
    where, own = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    with where.open_input_stream(own) as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != content_hash:
        raise ParseError(f"{path} has changed since it was listed")
    return content


def elements(ranged: DataFrame, tasks: int | None = None) -> DataFrame:
    """(content_hash, source_filename, file_type, range_no, first_page, last_page, pos, kind, text, page, image, error)

    The ranges of a file are parsed by the task that holds it; with ``tasks``, by as many tasks as that: only names of ranges
    are dealt, and each task reads the files of its own (by the schemes that pyarrow knows), one at a time.
    """
    parsers = {e: p for e, (p, _) in PARSERS.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, bytes] = ("", b"")
        for b in batches:
            out = []
            for r in b.itertuples():
                key = tuple(getattr(r, k) for k in _KEYS)
                try:
                    if r.file_type not in parsers:
                        raise UnsupportedDocument(f"no parser for {r.file_type}")
                    if tasks and held[0] != r.path:
                        held = (r.path, fetched(r.path, r.content_hash))
                    content = held[1] if tasks else bytes(r.content)
                    got = parsers[r.file_type](content, r.first_page, r.last_page)
                    out += [(*key, i, *e, None) for i, e in enumerate(got)]
                except Exception as e:  # a range that fails is a row, not the end of the job
                    out.append((*key, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[*_KEYS, "pos", "kind", "text", "page", "image", "error"]).astype({"pos": "Int32", "page": "Int32"})

    if tasks:
        rows = ranged.select(*_KEYS, "path").repartition(tasks, "content_hash", "range_no").sortWithinPartitions("path", "range_no")
    else:
        rows = ranged.select(*_KEYS, "content")
    return rows.mapInPandas(run, _ELEMENTS)


def retried(parsed: DataFrame, ranged: DataFrame, tasks: int | None = None) -> DataFrame:
    """``parsed`` (elements, written before) with the ranges that failed in it parsed again; the others stay as they are."""
    own = ["content_hash", "range_no"]
    bad = parsed.where("error is not null").select(*own).distinct()
    again = elements(ranged.join(bad, own, "left_semi"), tasks)
    return parsed.where("error is null").unionByName(again)
