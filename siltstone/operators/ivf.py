"""A vector index: cells by k-means, so that a question reads the nearest cells only, and exact scores within them.

Centroids are fitted on a bounded sample, every row is put into the cell whose centroid is nearest by cosine, and rows are
written with the cell as a partition column, so that a question's cells are directories that the scan opens and all others
are never listed as input. What is read is scored exactly, as ``dense.search`` does, so that the only loss is of neighbours
that lie in cells that were not probed. Building measures it: for a sample of rows as questions, the exact search tells in
which cells the ten nearest lie and how near those are to the question, and with that the share that any number of probes
finds; the least number that finds the wanted share is what a search probes if it is told no other.

An index belongs to one version of a collection and is built when that version is first asked for. It is built under a name
of its own and named by a small file that is created, never replaced, so that of two sessions that build at once one's
work is used by both.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import errors
from siltstone.functions import vectors as V
from siltstone.functions.validate import check_top_k, check_vector
from siltstone.operators.dense import DIGITS, MAX_QUERIES, Best, finite, search_batch
from siltstone.plans.joins import bounded, first_k, top_k
from siltstone.sources.collections import Store

#: Rows of the sample that centroids are fitted on, for each cell, and at most.
SAMPLE_PER_CELL, MAX_SAMPLE = 64, 200_000
#: Components that the sample holds at most, about.
MAX_NUMBERS = 16_000_000
#: Rows that recall is measured with when an index is built, and the share of the nearest rows that a search is to find.
QUESTIONS, RECALL = 256, 0.95
#: Most cells: centroids are held by the driver and every task.
MAX_CELLS = 65_536


def cells_for(n: int) -> int:
    """Four times the square root of the rows, of 64 rows at least, as many as the sample can place."""
    return int(max(1, min(4 * np.sqrt(n), n / 64, MAX_SAMPLE / 16, MAX_CELLS)))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell takes the row that is farthest from its own centroid."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own, best = nearest_cells(x, c, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own[:, 0], x)
        empty = np.flatnonzero(np.bincount(own[:, 0], minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best[:, 0], kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def nearest_cells(x: np.ndarray, centroids: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, cosines) of the ``probes`` nearest centroids of each row, the nearest first; blocks bound what is held.

    Only where many are asked for are all of a row's cosines sorted.
    """
    probes = min(probes, len(centroids))
    step = max(1, 4_000_000 // len(centroids))
    cells, scores = [np.empty((0, probes), np.int64)], [np.empty((0, probes))]
    for at in range(0, len(x), step):
        s = x[at : at + step] @ centroids.T
        if probes == 1:
            order = s.argmax(axis=1)[:, None]
        elif 4 * probes < s.shape[1]:
            few = np.sort(np.argpartition(-s, probes - 1, axis=1)[:, :probes], axis=1)
            order = np.take_along_axis(few, np.argsort(-np.take_along_axis(s, few, axis=1), axis=1, kind="stable"), axis=1)
        else:
            order = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        cells.append(order)
        scores.append(np.take_along_axis(s, order, axis=1))
    return np.concatenate(cells), np.concatenate(scores)


@dataclass(frozen=True)
class Index:
    """(id, embedding, columns to filter by) by cell, the centroids, and how many rows each cell has."""

    path: str
    spark: SparkSession

    @property
    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").select("centroid").collect()
        return np.array([r["centroid"] for r in rows], np.float64).reshape(len(rows), -1)

    def build(self, rows: DataFrame, id: str = "id", vector: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None, seed: int = 42) -> Index:
        """Writes the index of all rows with a finite vector of the usual length; ``keep``: columns that filters may need.

        The usual length is that of most rows. A cell that holds far more rows than others is written by several tasks, as rows
        are dealt by cell and a piece of their id's hash.
        """
        src = rows.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("embedding"), *[c for c in keep if c not in ("id", "embedding")]).where(finite(F.col(vector)))
        counts = src.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
        usual = counts.orderBy(F.desc("n"), "width").first()
        width, n = (usual["width"], usual["n"]) if usual else (1, 0)
        src = src.where(F.size("embedding") == width)
        # Rows by hashes of their ids: the same ones however they lie; their number is near the bound wanted, and at most twice it.
        want = min(MAX_SAMPLE, MAX_NUMBERS // width, SAMPLE_PER_CELL * (cells or cells_for(n)))
        key = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
        drawn = src.where(F.pmod(key, F.lit(1 << 40)) < int(min(1.0, want / max(n, 1)) * (1 << 40))).limit(2 * want).select(key.alias("key"), "embedding").toArrow()
        drawn = drawn.sort_by("key").column("embedding")
        x = np.array(drawn.to_pylist(), np.float64).reshape(-1, width)
        c = spherical_means(_unit(x), cells or cells_for(n), seed=seed) if len(x) else np.ones((1, width)) / np.sqrt(width)
        shared = self.spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.asarray(b.column("embedding").flatten()).reshape(b.num_rows, -1)
                    own, _ = nearest_cells(_unit(v), shared.value, 1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own[:, 0].astype(np.int32))], names=[*b.schema.names, "cell"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
        placed = src.mapInArrow(run, f"{fields}, cell int")
        # A cell is one file, or as many as its rows ask for: salts part the large ones.
        target = max(1, -(-n // max(1, len(c))))
        salt = F.pmod(F.xxhash64(F.col("id").cast("string")), F.greatest(F.lit(1), F.ceil(F.col("__n") / (4 * target)))).cast("int")
        placed.write.parquet(f"{self.path}/placed")
        placed = self.spark.read.parquet(f"{self.path}/placed")
        sizes = bounded(placed.groupBy("cell").agg(F.count("*").alias("__n")))
        d = placed.join(sizes, "cell").withColumn("__salt", salt)
        d.repartition("cell", "__salt").drop("__n", "__salt").write.partitionBy("cell").parquet(f"{self.path}/cells")
        fs, p = Store(self.spark, self.path).file(f"{self.path}/placed")
        fs.delete(p, True)
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.path}/centroids")
        Store(self.spark, self.path).create_only(f"{self.path}/schema.json", d.drop("__n", "__salt").schema.json())
        self._calibrate(c, self._cells())
        return self

    def _calibrate(self, c: np.ndarray, rows: DataFrame, k: int = 10) -> None:
        """Writes (probes, recall): the share of the k nearest rows of a sample of rows that so many probes find."""
        key = F.xxhash64(F.col("id").cast("string"), F.lit(1))
        # The rows of the smallest hashes: a sample of a fixed size.
        asked = rows.orderBy(key, "id").limit(QUESTIONS).select(F.col("id").alias("qid"), F.col("embedding")).toArrow()
        q = np.array(asked.column("embedding").to_pylist(), np.float64).reshape(-1, c.shape[1])
        order, _ = nearest_cells(_unit(q), c, len(c))
        place = np.argsort(order, axis=1)
        questions = self.spark.createDataFrame(list(zip(range(len(q)), q.tolist(), strict=True)), "qid int, embedding array<double>")
        exact = search_batch(rows, questions, k).join(rows.select("id", "cell"), "id").select("qid", "cell").collect()
        ranks = np.sort([place[r["qid"], r["cell"]] for r in exact]) + 1
        found = np.searchsorted(ranks, np.arange(1, len(c) + 1), "right") / max(1, len(ranks))
        self.spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(found)], "probes int, recall double").coalesce(1).write.parquet(f"{self.path}/recall")

    def probes_for(self, recall: float = RECALL) -> int:
        """The least number of probes that found this share of the sample's nearest rows."""
        r = self.spark.read.parquet(f"{self.path}/recall").where(F.col("recall") >= recall).agg(F.min("probes")).first()[0]
        return r or len(self.centroids)

    def files(self, query: list[float], probes: int | None = None) -> int:
        """How many files a question reads."""
        cells, _ = nearest_cells(_unit(np.array([query])), self.centroids, probes or self.probes_for())
        return self._cells().where(F.col("cell").isin(cells[0].tolist())).select("_metadata.file_path").distinct().count()

    def _cells(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(Store(self.spark, self.path).created(f"{self.path}/schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells")

    def search(self, query: list[float], k: int = 10, probes: int | None = None, condition=None) -> DataFrame:  # noqa: ANN001
        """(id, score, distance, rank): the k best rows of the ``probes`` nearest cells; the scan lists those cells only.

        ``condition``: a Column on what the index keeps, applied before scoring.
        """
        check_top_k(k, 10_000)
        c = self.centroids
        q = np.array([check_vector(list(query), c.shape[1])])
        cells, _ = nearest_cells(_unit(q), c, probes or self.probes_for())
        d = self._cells().where(F.col("cell").isin(cells[0].tolist()))
        d = d if condition is None else d.where(condition)
        scored = d.select("id", F.round(V.cosine(F.col("embedding"), V.literal(query)), DIGITS).alias("score"))
        return first_k(scored, k, [F.desc("score"), F.col("id")]).select("id", "score", (1.0 - F.col("score")).alias("distance"), "rank")

    def search_batch(self, queries: DataFrame, k: int = 10, probes: int | None = None, qid: str = "qid", query: str = "embedding") -> DataFrame:
        """(qid, id, score, rank): the k best rows of each query's nearest cells.

        Queries go to their cells as (cell, query) rows, ``probes`` of each; a cell's rows and its queries meet in a join by cell,
        cells that no query probes are pruned from the scan, and each task passes on its k best of a query only.
        """
        check_top_k(k, 10_000)
        own = queries.select(F.col(qid).alias("qid"), F.col(query).cast("array<double>").alias("q")).where(finite(F.col("q")))
        probes = probes or self.probes_for()
        blocks = max(1, -(-own.count() // MAX_QUERIES))
        found = None
        for i in range(blocks):
            part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
            got = self._block(part, k, probes)
            found = got if found is None else found.unionByName(got)
        return top_k(found, k, ["qid"], [F.desc("score"), F.col("id")])

    def _block(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        held, c = queries.orderBy("qid").toArrow(), self.centroids
        width = c.shape[1]
        fits = np.asarray(pc.list_value_length(held.column("q"))) == width
        held = held.filter(pa.array(fits))
        q = _unit(np.array(held.column("q").to_pylist(), np.float64).reshape(-1, width))
        cells, _ = nearest_cells(q, c, probes)
        by: dict[int, list[int]] = {}
        for i, own in enumerate(cells.tolist()):
            for cell in own:
                by.setdefault(cell, []).append(i)
        shared = self.spark.sparkContext.broadcast((q, held.column("qid").combine_chunks(), by))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, ids, probing = shared.value
            best = Best(k)  # of all cells that the task reads
            for b in batches:
                own = np.asarray(b.column("cell"))
                x = _unit(np.asarray(b.column("embedding").flatten()).reshape(b.num_rows, -1)) if b.num_rows else None
                for cell in np.unique(own):
                    rows, asked = np.flatnonzero(own == cell), np.array(probing.get(int(cell), []), np.int64)
                    for at in range(0, len(asked), max(1, 4_000_000 // max(1, len(rows)))):
                        part = asked[at : at + max(1, 4_000_000 // max(1, len(rows)))]
                        best.add(np.round(unit[part] @ x[rows].T, DIGITS), b.column("id").take(pa.array(rows)), part)
            yield from best.rows(ids)

        src = self._cells().where(F.col("cell").isin(sorted(by))).select("id", "embedding", "cell")
        kind = lambda df, name: df.schema[name].dataType.simpleString()
        found = src.mapInArrow(run, f"qid {kind(queries, 'qid')}, id {kind(src, 'id')}, score double")
        return found

    def recall(self, rows: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, id: str = "id", vector: str = "embedding", qid: str = "qid", query: str = "embedding") -> float:
        """The share of the exact search's k best of every query that this index finds with so many probes."""
        return overlap_of(search_batch(rows, queries, k, id, vector, qid, query), self.search_batch(queries, k, probes, qid, query))


def overlap_of(exact: DataFrame, found: DataFrame) -> float:
    both = exact.select("qid", "id", F.lit(1).alias("e")).join(found.select("qid", "id", F.lit(1).alias("f")), ["qid", "id"], "left")
    r = both.agg(F.count("*").alias("n"), F.count("f").alias("m")).first()
    return r["m"] / r["n"] if r["n"] else 1.0


def index_of(store: Store, name: str, cells: int | None = None, keep: tuple[str, ...] = ()) -> Index:
    """The index of a collection's current version, built when it is first asked for.

    What is built lies under a name of its own, and a file that names it is created last and never replaced: where two
    sessions build at once, the first to name its index wins and the other's is removed.
    """
    version = store.version(name)
    base = f"{store.path}/{name}/index-{version}/cells-{cells or 'auto'}"
    known = store.created(f"{base}.json")
    if known is None:
        own = f"{base}-{uuid.uuid4().hex[:8]}"
        Index(own, store.spark).build(store.table(name, version=version), keep=keep, cells=cells)
        try:
            store.create_only(f"{base}.json", json.dumps({"path": own}))
        except errors.StorageError:
            fs, p = store.file(own)
            fs.delete(p, True)
        known = store.created(f"{base}.json")
    return Index(json.loads(known)["path"], store.spark)
