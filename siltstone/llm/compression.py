"""Vectors as short codes: eight codebooks, fitted by rounds of k-means with norm-of-sum bounds.

A vector's components become whole numbers, and each of its eight parts is replaced by the nearest of sixteen
entries of that part's codebook. All distances are of whole numbers and exact, so that results do not depend on how
rows lie.

Between rounds each part keeps its entry, an upper bound of the distance to it, a lower bound of the distance to every
other entry, and for each bound the round in which it was measured (its stamp). All codebooks of all rounds are kept: a
bound of round s holds in round t after it is moved by the net displacement of entries from s to t, the norm of the sum of
their moves, which is never more than the sum of the norms that a bound carried from round to round would lose. If the
bounds settle that the entry is still the nearest, nothing is computed; if not, the distance to the own entry is measured
and the test repeated; only what is still open is held against all entries.

A round is one pass: rows with their state are written, and the last row of a task has the sums of the task's parts for
each entry, which are added up for the next codebook: the driver holds codebooks only, whose size is a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, join_small, read

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bounds are moved outwards by this share, far more than rounding takes from them.
SLACK = 1e-6
_STATE = "vec_id {vec}, label {label}, x array<int>, code binary, upper array<float>, upper_at binary, lower array<float>, lower_at binary, sums array<bigint>"


def largest(width: int) -> int:
    """The greatest absolute whole number with which squared distances of parts of ``width`` numbers fit 62 bits, and numbers 30."""
    b = 1
    while b < 2**29 and width * (4 * b) ** 2 < 2**62:
        b *= 2
    return b


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of rows of whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if x.shape[1] * (2 * top) ** 2 < 2**52:  # each sum on the way is a whole number that a double holds
        a, c = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def displaced(history: np.ndarray) -> np.ndarray:
    """(round, entry): how far each entry of a part's last codebook lies from where it was, at most; history (round, entry, width)."""
    moved = (history[-1] - history).astype(np.float64)
    return np.sqrt((moved**2).sum(axis=2)) * (1 + SLACK)


class Bounds:
    """The state of one part of many rows: entry, upper and lower bound and their stamps."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, upper_at: np.ndarray, lower: np.ndarray, lower_at: np.ndarray):
        self.code, self.upper, self.upper_at, self.lower, self.lower_at = code, upper, upper_at, lower, lower_at

    def assign(self, x: np.ndarray, history: np.ndarray) -> tuple[int, int]:
        """Moves every row to the nearest entry of the last codebook of ``history``; returns how many rows had their own
        distance measured, and how many were held against all entries."""
        now, entries = len(history) - 1, history[-1]
        if now == 0:
            rows = np.arange(len(x))
            near = 0
        else:
            moved = displaced(history)
            others = np.stack([np.delete(moved, j, axis=1).max(axis=1, initial=0) for j in range(moved.shape[1])], axis=1)
            u = self.upper + moved[self.upper_at, self.code]
            low = self.lower - others[self.lower_at, self.code]
            rows = np.flatnonzero(u * (1 + SLACK) >= low)
            near = len(rows)
            own = np.sqrt(((x[rows] - entries[self.code[rows]]) ** 2).sum(axis=1).astype(np.float64))
            self.upper[rows], self.upper_at[rows] = own * (1 + SLACK), now
            rows = rows[own * (1 + SLACK) >= low[rows]]
        d = squares(x[rows], entries)
        best = d.argmin(axis=1)  # of equal distances the lower index
        self.code[rows] = best
        self.upper[rows], self.upper_at[rows] = np.sqrt(d[np.arange(len(rows)), best].astype(np.float64)) * (1 + SLACK), now
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        self.lower[rows], self.lower_at[rows] = np.sqrt(d.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64)) * (1 - SLACK), now
        return near, len(rows)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), PARTS).copy()


def _binary(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a.astype(np.uint8)], pa.binary())


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, w = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(a.ravel(), kind))


def _assigned(b: pa.RecordBatch, history: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, list[Bounds]]:
    """The whole numbers (rows, part, width) of a batch and the bounds of its parts, assigned to the last codebook."""
    n, width = b.num_rows, history.shape[3]
    x = _numbers(b.column("x"), PARTS * width).astype(np.int64).reshape(n, PARTS, width)
    if len(history) == 1:
        code, ua, la = (np.zeros((n, PARTS), np.uint8) for _ in range(3))
        u = low = np.zeros((n, PARTS), np.float64)
    else:
        code, ua, la = (_bytes(b.column(c)) for c in ("code", "upper_at", "lower_at"))
        u, low = (_numbers(b.column(c), PARTS).astype(np.float64) for c in ("upper", "lower"))
    parts = []
    for p in range(PARTS):
        own = Bounds(code[:, p].astype(np.int64), u[:, p].copy(), ua[:, p].astype(np.int64), low[:, p].copy(), la[:, p].astype(np.int64))
        work += own.assign(x[:, p], history[:, p])
        parts.append(own)
    return x, parts


def _round(rows: DataFrame, history: np.ndarray, schema: str) -> DataFrame:
    """The rows (vec_id, label, x and, after the first round, their state) assigned to the last codebook of ``history``;
    one more row a task has in ``sums``, for each part and entry, the number of parts and the sums of their components,
    and last how many distances to own entries were measured and how many parts held against all entries."""
    shared = rows.sparkSession.sparkContext.broadcast(history)
    n_entries, width = history.shape[2], history.shape[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        sums, work = np.zeros((PARTS, n_entries, 1 + width), np.int64), np.zeros(2, np.int64)
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            x, parts = _assigned(b, h, work)
            for p, own in enumerate(parts):
                order = np.argsort(own.code, kind="stable")
                met, first = np.unique(own.code[order], return_index=True)
                sums[p, met, 0] += np.diff([*first, len(order)])
                sums[p, met, 1:] += np.add.reduceat(x[order, p], first, axis=0)
            col = lambda f, parts=parts: np.stack([f(o) for o in parts], axis=1)
            kept = [b.column("vec_id"), b.column("label"), b.column("x"), _binary(col(lambda o: o.code)), _lists(col(lambda o: o.upper * (1 + SLACK)), pa.float32()), _binary(col(lambda o: o.upper_at)), _lists(col(lambda o: o.lower * (1 - SLACK)), pa.float32()), _binary(col(lambda o: o.lower_at))]
            last = pa.RecordBatch.from_arrays([*kept, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=names)
            yield last
        if last is not None:
            none = [pa.nulls(1, last.schema.field(c).type) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([[*sums.ravel().tolist(), *work.tolist()]], pa.list_(pa.int64()))], names=names)

    names = [c.split(" ")[0] for c in ("vec_id", "label", "x", "code", "upper", "upper_at", "lower", "lower_at", "sums")]
    return rows.mapInArrow(run, schema)


def _final(rows: DataFrame, history: np.ndarray, schema: str) -> DataFrame:
    """(vec_id, label, code, error) by the last codebook."""
    shared = rows.sparkSession.sparkContext.broadcast(history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, parts = _assigned(b, h, np.zeros(2, np.int64))
            code = np.stack([o.code for o in parts], axis=1).astype(np.uint8)
            error = sum(((x[:, p] - h[-1][p][o.code]) ** 2).sum(axis=1) for p, o in enumerate(parts))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def _whole(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, x, other): whole numbers of vectors of PARTS * width components that fit; for others x is null."""
    most, size = largest(width), PARTS * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            lens = np.asarray(v.value_lengths()).astype(np.int64)
            ends = np.cumsum(lens)
            fits = lens == size
            flat = np.asarray(v.flatten(), np.float64)
            x = np.floor(np.clip(flat, -(2.0**40), 2.0**40) * SCALE)
            beyond = np.concatenate([[0], np.cumsum(np.abs(x) > most)])
            fits &= beyond[ends] == beyond[ends - lens]
            own = x[np.repeat(fits, lens)].astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(fits, size, 0))]), pa.int32(), mask=np.concatenate([~fits, [False]]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.ListArray.from_arrays(offsets, pa.array(own, pa.int32()))], names=["vec_id", "label", "x"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind('vec_id')}, label {kind('label')}, x array<int>")


def fitted(spark: SparkSession, s: Scratch, rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """The state after ``rounds`` rounds, the codebooks (round, part, entry, width) of all of them, and for each round how many
    parts had their own distance measured and how many were held against all entries. rows: (vec_id, label, x)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r["x"] for r in first], np.int64)
    history = x.reshape(len(x), PARTS, -1).transpose(1, 0, 2)[None]
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = _STATE.format(vec=kind("vec_id"), label=kind("label"))
    state, work = rows, []
    for _ in range(rounds):
        new = s.table(_round(state, history, schema))
        if state is not rows:
            s.drop(state)
        totals = new.where("sums is not null").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        got = {r["i"]: int(r["v"]) for r in totals.collect()}  # as many rows as codebooks have numbers
        shape, book = history.shape[1:], history[-1].copy()
        for at in np.ndindex(shape[:2]):
            lo = (at[0] * shape[1] + at[1]) * (1 + shape[2])
            if got[lo]:
                book[at] = [got[lo + 1 + j] // got[lo] for j in range(shape[2])]
        work.append((got[len(got) - 2], got[len(got) - 1]))
        history = np.concatenate([history, book[None]])
        state = new.where("sums is null")
    return state, history, work


def compressed(spark: SparkSession, vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each row of ``vectors`` with a vector of finite components.

    Rows whose vector is null or holds null or non-finite components are dropped. The length is that of the vector of the
    smallest vec_id (null last, then by the vector) whose length is a positive multiple of eight; vectors of other lengths
    (empty ones too), and those with components whose squared distances do not fit a long (beyond 2**17 for 64 components),
    take no part in codebooks and have a null code and error. With fewer rows than entries codebooks have as many entries
    as there are rows. Ties go to the lower entry; repeated rows count as often as they are there; a null label is a label;
    very long vectors are taken whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    src = vectors.select("vec_id", "label", "embedding").where(F.coalesce(fine, F.lit(False))).select("vec_id", "label", e.cast("array<double>").alias("v"))
    kind = lambda c: src.schema[c].dataType.simpleString()
    usual = src.where((F.size("v") > 0) & (F.size("v") % PARTS == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    with Scratch(spark) as s:
        rows = s.table(_whole(src, usual[0][0] // PARTS if usual else 1))
        coded = f"vec_id {kind('vec_id')}, label {kind('label')}, code string, error long"
        there, other = rows.where("x is not null"), rows.where("x is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        digest = F.lit(None).cast("string")
        if there.limit(1).count():
            state, history, _ = fitted(spark, s, there, entries, rounds)
            digest = F.lit(hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest())
            other = _final(state, history, coded).unionByName(other)
        found = s.table(other, keep=True)
        sums = s.table(found.groupBy("label").agg(F.sum("error").alias("label_error")), keep=True)
    return join_small(found, sums, ["label"]).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all vectors; nulls, ties and repeats as in ``compressed``."""
    return compressed(spark, read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds one after the other, each with every distance."""
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS v FROM k, (SELECT unnest(range({PARTS})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= {ENTRIES})"]
    for t in range(ROUNDS + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (SELECT r, p.part, entry, {square} AS d FROM p JOIN c{t} ON p.part = c{t}.part) GROUP BY r, part)")
        if t < ROUNDS:
            sums = f"SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT r, part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM p JOIN a{t} USING (r, part)) GROUP BY ALL"
            means = f"SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM ({sums}) GROUP BY ALL"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{t} LEFT JOIN ({means}) USING (part, entry))")
    last = ROUNDS
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{last} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


OP11_SQL = _sql()
