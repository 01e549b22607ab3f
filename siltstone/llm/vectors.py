"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a multiplicity. A first neighbour graph comes from blocks of nodes that
lie on the same sides of random hyperplanes, several sets of them; then each round joins every node's
neighbours and reverse neighbours with one another (neighbours of neighbours), keeping the ``k`` best of
each, until few lists change. Blocks and lists over ``block`` rows are split by hash, so that no task holds
a dense group or a hub.

Links (pairs at or above the threshold) do not go through the lists: whatever pairs a block computes, trees
of its links leave it, fewer than it has rows, so that nothing computed is lost from the components, however
full the lists are. A list holds the nearest node of each of the ``k`` nearest other components, so that a
dense group does not fill its own lists: when components merge, the places of what is now within are free
for those farther off, and rounds follow until no link between components is met and few lists change.
Components are then gone through exactly in pairs of blocks of ``block`` nodes. Links lie within components,
so the number of links is exact for the components that were found, and what is left to audit is whether the
graph has missed any link between components: sampled nodes are held against all nodes, a slice after another,
until enough of them have links, or all nodes have been sampled. There are as many sets of hyperplanes as it
takes for a pair at the threshold to meet with the target recall, a number that grows with the nodes. Below the
target, by links or by nodes, twice as many more sets and rounds follow; it is an error if the target is not
reached in the end. What was measured, and on how many links, is logged.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError
from siltstone.llm.common import Scratch, join_small, map_rows, read
from siltstone.llm.components import components

THRESHOLD = 0.9
SEED = 11
#: Low bits of a node's number, which tell vectors with one hash apart.
SLOTS = 8
_log = logging.getLogger(__name__)
#: ``g``: the component of v; ``link``: a tree edge at or above the threshold, not a place in a list.
_EDGES = "u long, v long, g long, sim double, link boolean"


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are first scaled by powers of two, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _unit(vectors) -> np.ndarray:
    return _normed(np.stack([np.asarray(v, np.float64) for v in vectors]))


def _trees(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Tree edges that join the rows that ``near`` joins, fewer than there are rows."""
    seen, a, b = ~near.any(axis=1), [], []
    for root in np.flatnonzero(~seen).tolist():
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            a += [i] * len(new)
            b += new.tolist()
            front += new.tolist()
    return a, b


def _best(nid: np.ndarray, g: np.ndarray, x: np.ndarray, k: int, threshold: float) -> list[np.ndarray]:
    """The columns of _EDGES: the k best of each row in other components, and trees of the links between components."""
    s = x @ x.T
    other = g[:, None] != g[None, :]
    near = s >= threshold
    np.fill_diagonal(near, False)
    a, b = np.array(_trees(near), np.int64) if near.any() else np.empty((2, 0), np.int64)
    new = g[a] != g[b]  # trees stay trees: what is left out is joined already
    a, b = a[new], b[new]
    s[~other] = -2.0
    k = min(k, len(nid) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(s, at, axis=1).ravel()
    fine, at = sim > -2.0, at.ravel()
    u, at, sim = np.repeat(nid, k)[fine], at[fine], sim[fine]
    link = np.repeat([False, True], [len(u), len(a)])
    return [np.concatenate(c) for c in ((u, nid[a]), (nid[at], nid[b]), (g[at], g[b]), (sim, np.ones(len(a))))] + [link]


def _joined(members: DataFrame, nodes: DataFrame, k: int, block: int, threshold: float) -> DataFrame:
    """_EDGES within groups of (key, nid): each group's members, in blocks, with their vectors and components."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("long")
    dealt = members.join(sizes, "key").select("key", "nid", F.pmod(F.xxhash64(F.lit(SEED), "nid", "key"), parts).alias("part"))

    def runs(batches):
        """Groups lie side by side; many small ones make one task's work."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            cuts = starts(t)
            held, t = t.slice(cuts[-1]), t.slice(0, cuts[-1])
            yield from each(t, cuts)
        if held is not None:
            yield from each(held, [*starts(held), held.num_rows])

    def starts(t):
        key, part = np.asarray(t.column("key")), np.asarray(t.column("part"))
        return [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]

    def each(t, cuts):
        if not t.num_rows:
            return
        nid, g, vec = np.asarray(t.column("nid")), np.asarray(t.column("g")), t.column("vec").combine_chunks()
        at, values = np.concatenate([[0], np.cumsum(np.asarray(vec.value_lengths()))]), np.asarray(vec.flatten())
        found = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a > 1:
                x = values[at[a] : at[z]].reshape(z - a, -1).astype(np.float64)
                found.append(_best(nid[a:z], g[a:z], _normed(x), k, threshold))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["u", "v", "g", "sim", "link"])

    rows = dealt.join(nodes.select("nid", "g", "vec"), "nid").select("key", "part", "nid", "g", "vec")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(runs, _EDGES)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The lists: of each u the k best components, each by its nearest node."""
    once = edges.groupBy("u", "g").agg(F.max(F.struct("sim", "v")).alias("best")).select("u", "best.v", "g", "best.sim")
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _sides(nodes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(key, nid): for each set of hyperplanes the sides that a node lies on."""

    def run(b: pa.RecordBatch):
        t = b.to_pandas()
        for dim, part in t.groupby(t["vec"].str.len()):
            planes = np.random.RandomState(seed).standard_normal((int(dim), tables * max(bits, 1)))
            up = (_unit(part["vec"]) @ planes > 0).reshape(len(part), tables, max(bits, 1))
            code = (up * (1 << np.arange(max(bits, 1)))).sum(axis=2) if bits else np.zeros((len(part), tables), np.int64)
            for j in range(tables):
                key = (np.int64(j) << np.int64(56)) | (np.int64(dim % 4096) << np.int64(44)) | code[:, j].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part["nid"].to_numpy())], names=["key", "nid"])

    return map_rows(nodes.select("nid", "vec"), run, "key long, nid long")


class Graph:
    """The lists (u, v, g, sim) of the nearest in other components, and the components (node, root) found so far."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, k: int, block: int, threshold: float):
        self.s, self.nodes, self.k, self.block, self.threshold = scratch, nodes, k, block, threshold
        spark = nodes.sparkSession
        self.lists = spark.createDataFrame([], "u long, v long, g long, sim double")
        self.roots = spark.createDataFrame([], "node long, root long")

    def grow(self, members: DataFrame, k: int) -> tuple[int, int]:
        """Joins groups of (key, nid); the number of links between components met, and of new places in lists."""
        grouped = self._of(self.nodes.select("nid", "vec"), "nid", "g")
        found = self.s.table(_joined(members, grouped, k, self.block, self.threshold))
        links = found.where("link").select(F.col("u").alias("a"), F.col("v").alias("b"))
        met = links.count()
        new = self.s.table(_top(found.where("not link").drop("link").union(self.lists), self.k))
        changed = new.join(self.lists, ["u", "v"], "left_anti").count()
        if met:
            roots = self.s.table(components(self.s, links.union(self.roots.select("node", "root"))))
            self.s.drop(self.roots)
            self.roots = roots
        self.s.drop(found)
        self.s.drop(self.lists)
        self.lists = new
        if met:  # places of what is now in the same component are free
            self.lists = self.s.table(self._of(self._of(new.drop("g"), "u", "gu"), "v", "g").where("gu <> g").select("u", "v", "g", "sim"))
            self.s.drop(new)
        return met, changed

    def _of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the component of ``node``."""
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias("__root"))
        return join_small(rows, roots, [node]).withColumn(name, F.coalesce("__root", node)).drop("__root")

    def descend(self) -> None:
        """Rounds that join neighbours and reverse neighbours of a node with one another, until no list is to grow."""
        least = 0.02 * self.nodes.count() * self.k
        while True:
            one, other = F.col("u"), F.col("v")
            both = self.lists.select(one.alias("key"), other.alias("nid")).union(self.lists.select(other.alias("key"), one.alias("nid")))
            members = both.union(self.nodes.select(F.col("nid").alias("key"), "nid")).distinct()
            met, changed = self.grow(members, max(2, self.k // 2))
            if not met and changed <= least:
                return


@dataclass(frozen=True)
class Audit:
    """What sampled nodes tell of recall: the share of their true links that lie within found components, and the mean of the
    nodes' own shares, in which a large group does not outweigh pairs; ``recall`` is the lesser (1 if there are no links)."""

    nodes: int
    linked: int
    links: int
    recall: float
    whole: bool  #: all nodes were sampled


def _audit(spark: SparkSession, nodes: DataFrame, roots: DataFrame, threshold: float, sample: int, enough: int = 200, most: int = 65_536, held_bytes: int = 32 << 20) -> Audit:
    """Sampled nodes against all: about ``sample`` of them, then four times as many and so on, until ``enough`` have links.

    That is all nodes in the end, where there are no more than ``most``; beyond that links of fewer than one node in
    some hundreds are measured on those that ``most`` nodes have. What is broadcast at once is at most about ``held_bytes``
    of vectors; nodes are sampled by hash.
    """
    named = nodes.join(roots.select(F.col("node").alias("nid"), "root"), "nid", "left").select("nid", "vec", F.coalesce("root", "nid").alias("root"))
    n, dim = nodes.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return Audit(0, 0, 0, 1.0, True)
    wanted = min(n, most)
    step = max(1, min(wanted, held_bytes // (8 * dim)))
    place = F.pmod(F.xxhash64(F.lit(SEED), "nid"), F.lit(1 << 40)) / (1 << 40)
    done, size, seen, linked, links, met, shares = 0, min(sample, step, wanted), 0, 0, 0, 0, 0.0
    while done < wanted and linked < enough:
        end = min(wanted, done + size)
        picked = named.where((place >= done / n) & (place < (end / n if end < n else 2.0))).toPandas()
        seen, done, size = seen + len(picked), end, min(4 * size, step)
        if not len(picked):
            continue
        held = spark.sparkContext.broadcast({int(d): (p["nid"].to_numpy(), p["root"].to_numpy(), _unit(p["vec"])) for d, p in picked.groupby(picked["vec"].str.len())})

        def run(b: pa.RecordBatch, held=held):  # noqa: ANN001
            t = b.to_pandas()
            for dim, part in t.groupby(t["vec"].str.len()):
                if int(dim) not in held.value:
                    continue
                ids, root, x = held.value[int(dim)]
                own, of, y = part["nid"].to_numpy(), part["root"].to_numpy(), _unit(part["vec"])
                for lo in range(0, len(ids), 512):
                    cut = slice(lo, lo + 512)
                    near = (y @ x[cut].T >= threshold) & (own[:, None] != ids[None, cut])
                    count, both = near.sum(axis=0), (near & (of[:, None] == root[None, cut])).sum(axis=0)
                    some = np.flatnonzero(count)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[cut][some]), pa.array(count[some]), pa.array(both[some])], names=["u", "n", "met"])

        each = map_rows(named, run, "u long, n long, met long").groupBy("u").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
        one = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("met"), F.lit(0)), F.coalesce(F.sum(F.col("met") / F.col("n")), F.lit(0.0))).first()
        linked, links, met, shares = linked + one[0], links + one[1], met + one[2], shares + one[3]
        held.destroy()
    return Audit(seen, linked, links, min(met / links, shares / linked) if links else 1.0, done >= n)


def _tables(bits: int, threshold: float, recall: float, least: int) -> int:
    """Sets of ``bits`` hyperplanes in one of which a pair at the threshold lies on the same sides with probability ``recall``."""
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(least, math.ceil(math.log(1 - min(recall, 0.999)) / math.log1p(-same))) if 0 < same < 1 else least


def _counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(nid, links): links within components, from (root, nid, vec, mult), in pairs of blocks."""
    sizes = members.groupBy("root").agg(F.count("*").alias("n"))
    d = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64(F.lit(SEED), "nid"), F.col("blocks")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def runs(batches):
        held = None
        for b in batches:
            t = b.to_pandas()
            t = t if held is None else pd.concat([held, t], ignore_index=True)
            end = t.iloc[-1]
            last = (t["root"] == end["root"]) & (t["i"] == end["i"]) & (t["j"] == end["j"])
            held, t = t[last], t[~last]
            yield from each(t)
        if held is not None:
            yield from each(held)

    def each(t):
        if not len(t):
            return
        key = t[["root", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(t)]
        ids, links = [], []
        for a, z in zip(cuts, cuts[1:], strict=False):
            p = t.iloc[a:z]
            x, nid, mult = _unit(p["vec"]), p["nid"].to_numpy(), p["mult"].to_numpy()
            near = x @ x.T >= threshold
            side = p["own"].to_numpy()
            if p["i"].iloc[0] != p["j"].iloc[0]:
                near &= side[:, None] != side[None, :]
            np.fill_diagonal(near, False)
            ids.append(nid)
            links.append(near @ mult)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], names=["nid", "links"])

    rows = d.select("root", "i", "j", "own", "nid", "mult", "vec").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return rows.mapInArrow(runs, "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))


def _nodes(s: Scratch, rows: DataFrame, key=lambda v: F.xxhash64(v)) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """``rows`` (vec_id, vec) with ``nid``, null where vec is, and the nodes (nid, first, mult, vec): one for each vector.

    A node's number is the hash of its vector but for the low bits, which tell those vectors apart that share a hash.
    """
    h = key(F.col("vec")).bitwiseAND(F.lit(-(1 << SLOTS)))
    rows = s.table(rows.withColumn("nid", F.when(F.col("vec").isNotNull(), h)))
    some = rows.where("nid is not null")
    nodes = s.table(some.groupBy("nid").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), F.min("vec").alias("vec"), F.max("vec").alias("other")))
    shared = s.table(nodes.where("vec <> other").select("nid"))
    if shared.limit(1).count():
        each = join_small(some, shared, ["nid"], "inner").groupBy("nid", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"))
        slot = F.row_number().over(Window.partitionBy("nid").orderBy("vec")) - 1
        fits = F.when(F.col("slot") < 1 << SLOTS, F.col("nid") + F.col("slot")).otherwise(F.raise_error(F.lit("too many vectors share a hash")).cast("long"))
        each = s.table(each.withColumn("slot", slot).select("nid", "vec", "first", "mult", fits.alias("own")))
        rows = s.table(join_small(rows, each.select("nid", "vec", "own"), ["nid", "vec"]).select("vec_id", "vec", F.coalesce("own", "nid").alias("nid")))
        nodes = nodes.where("vec = other").drop("other").unionByName(each.select(F.col("own").alias("nid"), "first", "mult", "vec"))
        return rows, s.table(nodes)
    return rows, nodes.drop("other")


def linked(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, k: int = 10, block: int = 128, tables: int = 6, rounds: int = 4, recall: float = 0.98, sample: int = 400) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id,
    link with nothing (component_id is their own vec_id); vectors of different lengths do not link; equal
    vectors link as they are (cosine 1), and a cosine that ties with the threshold links; very long vectors are taken
    whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    with Scratch(spark) as s:
        e = F.col("embedding")
        fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        rows, nodes = _nodes(s, vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), e).alias("vec")))
        n = nodes.count()
        bits = max(0, min(40, math.ceil(math.log2(max(n, 1) / (block / 2)))))
        graph = Graph(s, nodes, k, block, threshold)
        wanted, seed = _tables(bits, threshold, recall, tables), SEED
        for _ in range(rounds):
            for _ in range(0, wanted, tables):  # a few sets at a time, so that the disk holds the blocks of those only
                graph.grow(_sides(nodes, tables, bits, seed), k)
                seed += 1
            graph.descend()
            roots = graph.roots
            met = _audit(spark, nodes, roots, threshold, sample)
            _log.info("recall %.4f of %d links of %d nodes, of which %d were sampled%s", met.recall, met.links, met.linked, met.nodes, " (all)" if met.whole else "")
            if met.recall >= recall:
                break
            wanted *= 2
        else:
            raise SiltstoneError(f"near-duplicates of vectors: {met.recall:.4f} of {met.links} audited links are found after {(seed - SEED) * tables} sets of hyperplanes, below {recall}")
        members = s.table(nodes.join(roots, nodes["nid"] == roots["node"]).select("root", "nid", "first", "mult", "vec"))
        links = _counts(members, threshold, block * 2)
        first = members.groupBy("root").agg(F.min("first").alias("component"))
        own = members.select("root", "nid").join(first, "root").join(links, "nid").select("nid", "component", "links")
        found = s.table(nodes.join(own, "nid", "left").select("nid", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "first").alias("component")))
        out = rows.where("nid is not null").join(found, "nid").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
        out = out.unionByName(rows.where("nid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        return s.table(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), keep=True)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and components of all vectors; nulls, ties and repeats as in ``linked``."""
    return linked(spark, read(spark, sf_dir, "embeddings"))


OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
