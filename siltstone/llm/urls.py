"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped, with the full strings beside it.

An entry is a host and a path prefix. It fits a url if the url's host is the entry's or a subdomain of it
and the url's path starts with the entry's. A url's candidate keys are the suffixes of its host and the
prefixes of its path whose lengths occur in the index; a batch's keys are hashed, looked up by one binary
search over the mapped array, and each hit is confirmed against the stored string, so that a collision of
digests never decides. The longest entry that fits wins.

The index is a file that Spark sends to each executor once (``addFile``) and that tasks map into memory.
It is refused beyond ``MOST_BYTES``; lists larger than that go to ``judged_sharded``, which deals
candidate keys and entries by digest and joins them, confirming full strings in the join.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows, read

#: The list of the production query: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_BYTES = 256 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """(host, path) in UTF-8; both empty for null and for a url without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return b"", b""
    raw = rest.encode()
    end = min((i for i in map(raw.find, (b"/", b"?", b"#")) if i >= 0), default=len(raw))
    tail = raw[end:]
    stop = min((i for i in map(tail.find, (b"?", b"#")) if i >= 0), default=len(tail))
    return raw[:end].translate(_LOWER), tail[:stop]


class DigestIndex:
    """Digests sorted, with offsets into the full strings and the entries' verdicts, in one mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            at = f.tell()
        n = head["n"]
        self.digests = np.memmap(path, "<u8", "r", at, (n,)) if n else np.empty(0, "<u8")
        self.ends = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        self.blocks = np.memmap(path, "u1", "r", at + 16 * n + 8, (n,)) if n else np.empty(0, "u1")
        self.strings = np.memmap(path, "u1", "r", at + 17 * n + 8, (head["bytes"],)) if head["bytes"] else np.empty(0, "u1")
        self.host_lengths, self.path_lengths = head["host_lengths"], head["path_lengths"]

    @staticmethod
    def write(path: str, entries: list[tuple[str, str, str]]) -> None:
        """entries: (verdict, host, path prefix); of repeated ones the last holds."""
        keys = {host.encode() + b" " + prefix.encode(): verdict == "block" for verdict, host, prefix in entries}
        rows = sorted((xxhash.xxh64_intdigest(k), k, b) for k, b in keys.items())
        text = b"".join(k for _, k, _ in rows)
        if len(text) + 17 * len(rows) > MOST_BYTES:
            raise ValueError("the list is too large to map on each executor; use judged_sharded")
        ends = np.cumsum([0, *(len(k) for _, k, _ in rows)]).astype("<u8")
        with open(path, "wb") as f:
            f.write(json.dumps({"n": len(rows), "bytes": len(text), "host_lengths": sorted({k.index(b" ") for k in keys}), "path_lengths": sorted({len(k) - k.index(b" ") - 1 for k in keys})}).encode() + b"\n")
            f.write(np.array([d for d, _, _ in rows], "<u8").tobytes() + ends.tobytes() + bytes(b for _, _, b in rows) + text)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry's place for each key, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        d = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, d)
        for i in np.flatnonzero(np.take(self.digests, at, mode="clip") == d):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == d[i]:  # equal digests lie side by side
                if self.key(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def key(self, j: int) -> bytes:
        return self.strings[int(self.ends[j]) : int(self.ends[j + 1])].tobytes()


def candidates(host: bytes, path: bytes, host_lengths: list[int], path_lengths: list[int]) -> list[bytes]:
    """Keys of the entries that may fit, the longest first (of equal ones that with the longer host).

    As many at most as pairs of lengths that occur in the list, however long the url is.
    """
    end = len(host)
    hosts = [host[end - n :] for n in host_lengths if 0 < n <= end and (n == end or host[end - n - 1 : end - n] == b".")]
    found = [(len(h) + n, len(h), h + b" " + path[:n]) for h in hosts for n in path_lengths if n <= len(path)]
    return [k for _, _, k in sorted(found, reverse=True)]


def send(spark: SparkSession, entries: list[tuple[str, str, str]]) -> str:
    """Writes the index and has Spark send it to every executor; returns its name there."""
    name = f"urls-{uuid.uuid4().hex}.idx"
    at = os.path.join(tempfile.mkdtemp(), name)
    DigestIndex.write(at, entries)
    spark.sparkContext.addFile(at)
    return name


def judged(spark: SparkSession, pages: DataFrame, entries: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``, in one narrow pass.

    ``rule``: the host and path of the longest entry that fits, else null with verdict ``default``.
    Null urls and urls without ``://`` have an empty host and path and fit no entry; of entries that fit and are
    equally long that with the longer host wins, of repeated entries the last; very long urls have no more keys than
    short ones; repeated rows are judged alike; an empty table gives none; other columns are ignored, whatever their
    names.
    """
    name = send(spark, entries)
    src = pages.select(pages[key].alias("page_id"), pages[url].alias("url"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(SparkFiles.get(name))
        parts = [split_url(u) for u in b.column("url").to_pylist()]
        own = [candidates(h, p, index.host_lengths, index.path_lengths) for h, p in parts]
        hits = index.find([k for ks in own for k in ks])
        rules, verdicts, at = [], [], 0
        for ks in own:
            mine = hits[at : at + len(ks)]
            at += len(ks)
            first = np.flatnonzero(mine >= 0)
            j = int(mine[first[0]]) if len(first) else -1
            rules.append(index.key(j).replace(b" ", b"", 1).decode() if j >= 0 else None)
            verdicts.append(default if j < 0 else "block" if index.blocks[j] else "allow")
        cols = [b.column("page_id"), pa.array([h.decode() for h, _ in parts]), pa.array([p.decode() for _, p in parts]), pa.array(rules, pa.string()), pa.array(verdicts)]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "path", "rule", "verdict"])

    return map_rows(src, run, f"page_id {src.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judged_sharded(pages: DataFrame, entries: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``judged`` for lists of any size: ``entries`` (verdict, host, prefix) is a table dealt out by digest.

    A url sends its distinct candidate keys to the shards of their digests; the join confirms strings. Urls are judged
    once each, however many pages have them. Of entries repeated with both verdicts block holds; else as ``judged``.
    """
    src = pages.select(pages[key].alias("page_id"), pages[url].alias("url"))
    lengths = lambda c: sorted(r[0] for r in entries.select(F.octet_length(c)).distinct().collect())
    host_lengths, path_lengths = lengths("host"), lengths("prefix")

    def keys(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(u, k.decode("utf-8", "replace")) for u in b.column("url").to_pylist() for k in candidates(*split_url(u), host_lengths, path_lengths)]
        yield pa.RecordBatch.from_pydict({"url": pa.array([r[0] for r in rows], pa.string()), "key": pa.array([r[1] for r in rows], pa.string())})

    def split(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [split_url(u) for u in b.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([h.decode() for h, _ in parts]), pa.array([p.decode() for _, p in parts])], names=["page_id", "url", "host", "path"])

    digest = lambda c: F.xxhash64(c)
    probe = map_rows(src.select("url").distinct(), keys, "url string, key string").withColumn("digest", digest(F.col("key")))
    held = entries.groupBy(F.concat_ws(" ", "host", "prefix").alias("key")).agg(F.max("verdict").alias("verdict"), F.max(F.octet_length("host")).alias("host_bytes"))
    held = held.withColumn("digest", digest(F.col("key")))
    hit = probe.join(held, ["digest", "key"]).groupBy("url").agg(F.max(F.struct(F.octet_length("key").alias("n"), "host_bytes", "key", "verdict")).alias("best"))
    rows = map_rows(src, split, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, host string, path string")
    out = rows.join(hit, "url", "left")
    return out.select("page_id", "host", "path", F.replace(F.col("best.key"), F.lit(" "), F.lit("")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judged_by_table(spark: SparkSession, pages: DataFrame, entries: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``judged`` by a table (verdict, host, prefix): mapped on each executor if its measured bytes allow, else dealt out."""
    size = entries.agg(F.sum(F.octet_length("host") + F.octet_length("prefix") + 18)).first()[0] or 0
    if size > MOST_BYTES:
        return judged_sharded(pages, entries, default, key, url)
    rows = entries.groupBy("host", "prefix").agg(F.max("verdict").alias("verdict")).collect()
    return judged(spark, pages, [(r["verdict"], r["host"], r["prefix"]) for r in rows], default, key, url)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page; nulls, long urls, ties and repeats as in ``judged``."""
    return judged(spark, read(spark, sf_dir, "pages"), list(RULES))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), cut AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
