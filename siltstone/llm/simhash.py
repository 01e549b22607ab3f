"""SimHash near-duplicates by an inverted index of byte positions with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight bytes, in
place. Lists of one positional byte would hold a 256th of everything, so the index posts a fingerprint under three
positions with their bytes at once, in each of the C(8, 3) = 56 ways: a pair that shares four positional bytes meets
in some list. In a list the positional bytes that a pair shares are tallied, pairs that reach the guaranteed minimum
of four are retained, and these are verified by their differing bits.

Fingerprints are unique in the index (copies are one row with the smallest doc_id). Lists of one fingerprint are
dropped after a combined count. A list of up to ``bucket`` fingerprints is tallied in one task, in which linked
fingerprints are joined to trees, so that a group of n gives at most n - 1 links. A longer list is posted again under
each fourth position with its byte, in which its pairs have to meet if they reach the minimum. What is still longer
than ``bucket`` shares four bytes throughout, so that the tally tells nothing more; an exact way that never pairs a
group links it: fingerprints at most four bits apart have a common neighbour at most two bits from both, so each emits
its 2,081 neighbours (itself, one and two bits changed) and links to the smallest fingerprint that emitted the same one.

``similar`` and ``deduplicated`` take texts of which 0.8 or more of the five-word shingles are common. The same index over
six words of a longer fingerprint tells which texts may be near each other; texts that hang together by it are then held
against each other by their shingles, and only pairs that truly reach the similarity are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, gram_hashes, join_small, map_rows, map_runs, mix, read, texts, tokenized
from siltstone.llm.components import components

SHINGLE, BITS, SEED = 4, 4, 42
BUCKET = 1024
#: Positional bytes that a pair shares at least, and the positions of a list.
LEAST = 8 - BITS
_LISTS = list(combinations(range(8), LEAST - 1))
#: For similar texts: words of 64 bits and those that are posted, words of a shingle, Jaccard similarity.
WORDS, POSTED, SIMILAR_SHINGLE, SIMILARITY = 16, 6, 5, 0.8
#: Rows with texts or sets of shingles go to Python a thousand at a time.
_SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of the lower-cased text's shingles, repeats counted; 0 without words."""
    words = data.lower().split()  # ASCII only, on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[: len(words) - shingle]).tolist()]
    h = xxhash.xxh64_intdigest
    grams = np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), 8192):
        part = grams[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): th, a hash of the text; fp as a signed 64-bit integer."""
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t) for t in texts(b.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])

    return map_rows(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _spread(nodes: DataFrame, rows: int = 50_000) -> DataFrame:
    """A written table of fingerprints over as many tasks as their postings need, each has dozens; small ones over all cores."""
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    return nodes.repartition(max(2, cores, -(-nodes.count() // rows)))


def _bytes_at(fp: np.ndarray, place: int) -> np.ndarray:
    return (fp >> np.uint64(8 * place)) & np.uint64(255)


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): a fingerprint under each three positions with their bytes, 56 rows."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.asarray(b.column("fp")).view(np.uint64)
        own = [_bytes_at(fp, p) for p in range(8)]
        for c, places in enumerate(_LISTS):
            key = np.full(len(fp), c, np.uint64)
            for p in places:
                key = (key << np.uint64(8)) | own[p]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("fp")], names=["key", "fp"])

    return map_rows(nodes.select("fp"), run, "key long, fp long")


def _refined(long: DataFrame) -> DataFrame:
    """(key, fp): the fingerprints of long lists (key, fp) under each position that the list does not have, too."""
    width = 8 * (LEAST - 1)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, fp = (np.asarray(b.column(c)).view(np.uint64) for c in ("key", "fp"))
        choice = key >> np.uint64(width)
        for p in range(8):
            other = np.array([p not in places for places in _LISTS])[choice]
            new = ((_bytes_at(fp, p) | np.uint64((p + 1) << 8)) << np.uint64(32)) | key
            yield pa.RecordBatch.from_arrays([pa.array(new[other].view(np.int64)), pa.array(fp[other].view(np.int64))], names=["key", "fp"])

    return map_rows(long.select("key", "fp"), run, "key long, fp long")


def matches(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """The tally: how many bytes each of ``others`` has in the same place as ``one``."""
    return ((others ^ one).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _trees(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join fingerprints at most ``bits`` apart, fewer than there are fingerprints."""
    n = len(fp)
    seen, a, b = np.zeros(n, bool), [], []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            i = front.pop()
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            rest = rest[matches(fp[i], fp[rest]) >= 8 - bits]
            near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= bits]
            seen[near] = True
            a += [i] * len(near)
            b += near.tolist()
            front += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _bucket_links(rows: DataFrame, bits: int) -> DataFrame:
    """Links within keys, from (key, fp) rows of which a key has a bounded number."""

    def runs(batches):
        """Rows of a key are consecutive; a key's rows may lie in two batches or more."""
        import pandas as pd

        held = []
        for batch in batches:
            t = batch.to_pandas()
            last = t["key"].iloc[-1] if len(t) else None
            if last is None:
                continue
            whole, tail = t[t["key"] != last], t[t["key"] == last]
            if len(whole):
                t2 = pd.concat([*held, whole]) if held else whole
                held = [tail]
                yield from links(t2)
            else:
                held.append(tail)
        if held:
            yield from links(pd.concat(held))

    def links(t):
        k, f = t["key"].to_numpy(), t["fp"].to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(k)) + 1
        a, b = [], []
        for part in np.split(f, cuts):
            if len(part) == 2:
                if int(np.bitwise_count(part.view(np.uint64)[0] ^ part.view(np.uint64)[1])) <= bits:
                    a.append(part[:1])
                    b.append(part[1:])
            else:
                x, y = _trees(part.view(np.uint64), bits)
                a.append(part[x])
                b.append(part[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(runs, "a long, b long").where("a <> b")


_FLIPS = np.array([0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i in range(64) for j in range(i))], np.uint64)


def _ball_links(hot: DataFrame) -> DataFrame:
    """Links of the fingerprints (fp) through common neighbours: each to the smallest with the same neighbour."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.asarray(b.column("fp"))
        for at in range(0, len(fp), 256):
            part = fp[at : at + 256]
            points = (part.view(np.uint64)[:, None] ^ _FLIPS[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(part, len(_FLIPS)))], names=["point", "fp"])

    spread = map_rows(hot, run, "point long, fp long")
    least = spread.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    return spread.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def _lists(s: Scratch, posts: DataFrame) -> DataFrame:
    """A written table of (key, fp, n): the lists of two or more."""
    # Counts are written, so that the join has a plain shuffle on both sides and adaptive execution splits a hot key.
    keys = s.table(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Both sides grow with the corpus: a merge join, whatever the estimates say.
    return s.table(posts.join(keys.hint("merge"), "key").select("key", "fp", "n"))


def _links(s: Scratch, nodes: DataFrame, bucket: int) -> DataFrame:
    """(a, b): a written table of links between the fingerprints of ``nodes``."""
    met = _lists(s, _postings(_spread(nodes)))
    links = _bucket_links(met.where(F.col("n") <= bucket).select("key", "fp"), BITS)
    long = _lists(s, _refined(met.where(F.col("n") > bucket)))
    links = links.union(_bucket_links(long.where(F.col("n") <= bucket).select("key", "fp"), BITS))
    return s.table(links.union(_ball_links(long.where(F.col("n") > bucket).select("fp").distinct())))


def _components(spark: SparkSession, docs: DataFrame, bucket: int) -> DataFrame:
    """(doc_id, th, fp, root, component_id): th, a hash of the text; root, a name of the component."""
    with Scratch(spark) as s:
        fps = s.table(fingerprints(docs), keep=True)
        nodes = s.table(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
        roots = s.table(components(s, _links(s, nodes, bucket)))
        first = nodes.join(roots, nodes["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("component"))
        # Fingerprints with links get the smallest id of their component, others that of their copies.
        linked = roots.join(first, "root").select(F.col("node").alias("fp"), "root", "component")
        named = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))
        named = s.table(named, keep=True)
    return fps.join(named, "fp")


def grouped(spark: SparkSession, docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other; very long texts are taken whole; a bit
    set in exactly half the hashes (a tie) is 0; a null doc_id gets the smallest known id of its component (null if
    there is none); repeated rows are copies; an empty table gives none; other columns are ignored.
    """
    out = _components(spark, docs, bucket)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similar texts: longer fingerprints of longer shingles ---------------------------------------


def differing(similarity: float, bits: int = 64 * WORDS) -> int:
    """Bits in which fingerprints of texts with this Jaccard similarity of shingles differ, and two standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(p * bits + 2 * math.sqrt(p * (1 - p) * bits))


def wide_fingerprints(docs: DataFrame, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """(doc_id, th, f0 ..., shingles): WORDS words of 64 bits of the majority of the hashes of a text's shingles, repeats
    counted; the different shingles as sorted 32-bit hashes."""
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    names = [f"f{k}" for k in range(WORDS)]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokenized(b.column("text"), lower=True)
        h, at = t.hashes[0][t.ids], t.runs_of(shingle)
        grams, of = gram_hashes(h, shingle)[at], t.text[at]
        short = np.flatnonzero((t.lens > 0) & (t.lens < shingle))  # the whole sequence
        more = [int(gram_hashes(h[t.starts[i] : t.ends[i]], int(t.lens[i]))[0]) for i in short]
        grams, of = np.concatenate([grams, np.array(more, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
        n, cols = np.bincount(of, minlength=b.num_rows), []
        for k in range(WORDS):
            ones = np.zeros((b.num_rows, 64), np.int64)
            for lo in range(0, len(grams), 1 << 19):
                own, first = np.unique(of[lo : lo + (1 << 19)], return_index=True)
                ends = [*first[1:], min(len(of) - lo, 1 << 19)]
                bits = np.unpackbits(mix(grams[lo : lo + (1 << 19)] ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[own] += np.stack([bits[a:z].sum(axis=0, dtype=np.int32) for a, z in zip(first, ends, strict=True)])
            cols.append(pa.array(np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64).ravel()))
        ends = np.cumsum(n)
        sets = [np.unique((grams[z - k : z] >> np.uint64(32)).astype("<u4")).tobytes() for z, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *cols, pa.array(sets, pa.binary())], names=["doc_id", "th", *names, "shingles"])

    return map_runs(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, th long" + "".join(f", {f} long" for f in names) + ", shingles binary")


def _wide_postings(nodes: DataFrame) -> DataFrame:
    """(key, nid): a fingerprint under each three positions, with their bytes, of each of the words that are posted."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(POSTED):
            fp = np.asarray(b.column(f"f{k}")).view(np.uint64)
            own = [_bytes_at(fp, p) for p in range(8)]
            for c, places in enumerate(_LISTS):
                key = np.full(len(fp), k * len(_LISTS) + c, np.uint64)
                for p in places:
                    key = (key << np.uint64(8)) | own[p]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("nid")], names=["key", "nid"])

    return map_rows(nodes, run, "key long, nid long")


def _wide_trees(fp: np.ndarray, least: int, most: int) -> tuple[list[int], list[int]]:
    """Trees of the rows that share ``least`` positional bytes or more and differ in at most ``most`` bits."""
    seen, a, b = np.zeros(len(fp), bool), [], []
    for root in range(len(fp)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            i = front.pop()
            rest = np.flatnonzero(~seen)
            other = fp[rest] ^ fp[i]
            met = (other.view(np.uint8).reshape(len(rest), 8 * fp.shape[1]) == 0).sum(axis=1) >= least  # the tally
            near = rest[met][np.bitwise_count(other[met]).sum(axis=1) <= most]
            seen[near] = True
            a += [i] * len(near)
            b += near.tolist()
            front += near.tolist()
    return a, b


def _parts(rows: DataFrame, keys: list[str], links, schema: str) -> DataFrame:  # noqa: ANN001
    """``links(table, cuts)`` of tables of whole parts, a part being the rows with the same ``keys``; cuts are where parts begin, and the end."""

    def starts(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            v = np.asarray(t.column(k))
            new |= v[1:] != v[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                t = t if held is None else pa.concat_tables([held, t])
                cuts = starts(t)
                held, t = t.slice(cuts[-1]), t.slice(0, cuts[-1])
                if t.num_rows:
                    yield from links(t, cuts)
        if held is not None:
            yield from links(held, [*starts(held), held.num_rows])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _wide_links(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(a, b): links within the parts of lists, from (key, i, j, nid, f0 ...)."""

    def links(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        nid, fp = np.asarray(t.column("nid")), np.stack([np.asarray(t.column(f"f{k}")).view(np.uint64) for k in range(WORDS)], axis=1)
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x, y = _wide_trees(np.ascontiguousarray(fp[lo:hi]), least, most)
            a += [lo + i for i in x]
            b += [lo + i for i in y]
        yield pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], names=["a", "b"])

    return _parts(rows, ["key", "i", "j"], links, "a long, b long").where("a <> b")


def jaccard_trees(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Trees of the sets of hashes whose Jaccard similarity is at least ``similarity``: each that is reached is held against
    all that are not yet."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    words, of = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint32), return_inverse=True)
    seen, mark, a, b = np.zeros(len(sets), bool), np.zeros(len(words) + 1, np.int64), [], []
    for root in range(len(sets)):
        front = [] if seen[root] else [root]
        seen[root] = True
        while front:
            i = front.pop()
            rest = np.flatnonzero(~seen)
            fits = (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])) & (sizes[rest] > 0)
            rest = rest[fits]
            if not len(rest):
                continue
            mark[:] = 0
            mark[of[starts[i] : starts[i] + sizes[i]]] = 1
            at = np.arange(sizes[rest].sum()) + np.repeat(starts[rest] - (np.cumsum(sizes[rest]) - sizes[rest]), sizes[rest])
            both = np.add.reduceat(mark[of[at]], np.cumsum(sizes[rest]) - sizes[rest])
            near = rest[both >= similarity * (sizes[rest] + sizes[i] - both)]
            seen[near] = True
            a += [i] * len(near)
            b += near.tolist()
            front += near.tolist()
    return a, b


def _true_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of texts that reach the similarity, within parts of groups, from (root, i, j, nid, shingles)."""

    def links(t: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        nid, raw = np.asarray(t.column("nid")), t.column("shingles")
        a, b = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x, y = jaccard_trees([np.frombuffer(v.as_py(), "<u4") for v in raw.slice(lo, hi - lo)], similarity)
            a += [lo + i for i in x]
            b += [lo + i for i in y]
        yield pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], names=["a", "b"])

    return _parts(rows, ["root", "i", "j"], links, "a long, b long").where("a <> b")


def _in_pairs(members: DataFrame, parts: str) -> DataFrame:
    """Members (nid, ``parts`` ...) once for each pair (i, j) of blocks that theirs is in, so that any two of a list meet in one part."""
    own = F.pmod(F.xxhash64("nid"), F.col(parts)).cast("int")
    d = members.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return d.withColumns({"i": F.least("__own", "__other"), "j": F.greatest("__own", "__other")}).drop("__own", "__other", parts)


def similar(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, root): groups of texts linked by pairs whose five-word shingles have this Jaccard similarity; root names a group.

    Texts may be near each other if their fingerprints share three positional bytes of one of six words and differ in no more
    bits than two standard deviations above what is expected at the similarity; nearly all pairs that reach it do. What hangs
    together so is held against each other by shingles. Lists and groups longer than ``bucket`` are dealt into blocks and
    each pair of blocks is a part of its own, so that no pair is missed: that is quadratic in the length, but no part holds
    more than two blocks. Nulls, empty and very long texts and empty tables as in ``grouped``: texts without words are one
    group.
    """
    names = [f"f{k}" for k in range(WORDS)]
    parts = lambda n: F.ceil(F.col(n) / bucket).cast("int").alias("parts")
    with Scratch(spark) as s:
        fps = s.table(wide_fingerprints(docs).withColumn("uid", F.monotonically_increasing_id()), settings=_SMALL)
        nodes = s.table(fps.groupBy(*names).agg(F.min("uid").alias("nid")))
        posts = _wide_postings(_spread(nodes, 20_000))
        keys = s.table(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))  # as in _lists
        met = s.table(posts.join(keys.hint("merge"), "key").select("key", "nid", parts("n")))
        loose = s.table(components(s, s.table(_wide_links(_in_pairs(met, "parts").join(nodes, "nid"), LEAST - 1, differing(similarity)).distinct())))
        sizes = s.table(loose.groupBy("root").agg(F.count("*").alias("n")))
        members = s.table(join_small(loose, sizes, ["root"], "inner").select("root", F.col("node").alias("nid"), parts("n")))
        sets = join_small(fps.select(F.col("uid").alias("nid"), "shingles"), members, ["nid"], "inner")
        links = s.table(_true_links(_in_pairs(sets, "parts"), similarity).distinct(), settings=_SMALL)
        roots = s.table(components(s, links))
        named = s.table(nodes.join(roots, nodes["nid"] == roots["node"], "left").select(*names, F.coalesce("root", "nid").alias("root")))
        return s.table(fps.join(named, names).select("doc_id", "th", "root"), keep=True)


def deduplicated(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``similar``: of the rows with its smallest doc_id that with the smallest hash of its text.

    Rows without an id stay; rows that share an id and are in different groups stay both; of rows repeated in full
    one stays. Nulls, empty and very long texts and empty tables as in ``similar``; columns may have any names.
    """
    id, th = "__doc_id", "__text"
    with Scratch(spark) as s:
        found = similar(spark, docs.where("doc_id is not null"), similarity)
        best = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("best"), F.count("*").alias("n")).where("n > 1")
        gone = join_small(found, s.table(best), ["root"], "inner").where((F.col("doc_id") != F.col("best.doc_id")) | (F.col("th") != F.col("best.th")))
        gone = s.table(gone.select(F.col("doc_id").alias(id), F.col("th").alias(th)).distinct(), keep=True)
    # Rows without an id are spread over all tasks and never dropped.
    some, none = docs.where("doc_id is not null"), docs.where("doc_id is null")
    left = some.withColumns({id: F.col("doc_id"), th: F.xxhash64("text")}).join(gone, [id, th], "left_anti")
    w = Window.partitionBy(id, th).orderBy(F.lit(0))
    left = left.withColumn("__row", F.row_number().over(w)).where("__row = 1").select(*docs.columns)
    return left.unionByName(none)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents; nulls, long texts, ties and repeats as in ``grouped``."""
    return grouped(spark, read(spark, sf_dir, "documents"))
