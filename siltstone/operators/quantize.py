"""Rotated scalar quantization of vectors, and scans of the codes.

A vector is turned by a fixed random rotation, and its components are put on 2**bits even levels from
their least to their greatest. As the rotation keeps angles, a query is rotated once and compared with
codes directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.config import CodecConfig
from siltstone.operators import dense
from siltstone.operators.dense import DIGITS
from siltstone.plans.joins import first_k


@dataclass(frozen=True)
class Codec:
    dimension: int
    bits: int = 8
    seed: int = 42

    def __post_init__(self):
        if self.dimension <= 0:
            raise ValueError("the dimension must be positive")
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be from 1 to 8")

    @cached_property
    def rotation(self) -> np.ndarray:
        """Orthogonal; from the QR decomposition of a seeded normal matrix, signs by the diagonal of R."""
        q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((self.dimension, self.dimension)))
        return q * np.sign(np.diag(r))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, least, scale) of the rows of x; a flat vector has scale 1."""
        if x.ndim != 2 or x.shape[1] != self.dimension:
            raise ValueError(f"vectors must have {self.dimension} components")
        y = x @ self.rotation.T
        low, high = y.min(axis=1), y.max(axis=1)
        scale = (high - low) / (2**self.bits - 1)
        scale = np.where(scale > 0, scale, 1.0)
        return np.rint((y - low[:, None]) / scale[:, None]).astype(np.uint8), low, scale

    def decode(self, codes: np.ndarray, low: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return (codes * scale[:, None] + low[:, None]) @ self.rotation

    def rotated(self, query: list[float]) -> np.ndarray:
        return self.rotation @ np.asarray(query, np.float64)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1)


def _codes(col: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), dimension)


def encoded(rows: DataFrame, codec: Codec, id: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, codes, vmin, scale): codes are bytes, one for each component."""
    src = rows.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, low, scale = codec.encode(_matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(low), pa.array(scale)], names=["id", "codes", "vmin", "scale"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, codes binary, vmin double, scale double")


def decoded(codes: DataFrame, codec: Codec) -> DataFrame:
    """(id, embedding)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = codec.decode(_codes(b.column("codes"), codec.dimension), np.asarray(b.column("vmin")), np.asarray(b.column("scale")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

    return codes.select("id", "codes", "vmin", "scale").mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, embedding array<double>")


def scan(codes: DataFrame, codec: Codec, query: list[float], n: int = 200) -> DataFrame:
    """(id, score, rank): the n codes nearest to a query by cosine; rows without codes are left out."""
    q = codec.rotated(query)
    size = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = _codes(b.column("codes"), codec.dimension) * np.asarray(b.column("scale"))[:, None] + np.asarray(b.column("vmin"))[:, None]
                den = np.sqrt((y * y).sum(axis=1)) * size
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.where(den > 0, (y @ q) / np.where(den > 0, den, 1.0), 0.0))], names=["id", "score"])

    src = codes.where("codes is not null").select("id", "codes", "vmin", "scale")
    scored = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumn("score", F.round("score", DIGITS))
    return first_k(scored, n, [F.desc("score"), F.col("id")])


def search(rows: DataFrame, query: list[float], k: int = 10, config: CodecConfig | None = None) -> DataFrame:
    """(id, score, distance, rank) as ``dense.search``, in two phases if the settings ask for codes.

    First the codes (id, codes, vmin, scale) are scanned for a pool of ``config.pool`` rows, which reads no vectors; then the pool's
    vectors are scored exactly. Rows without codes are scored by their vectors, so that none is missed.
    """
    cfg = config or CodecConfig()
    if not cfg.enabled:
        return dense.search(rows, query, k)
    pool = scan(rows, Codec(len(query), cfg.bits, cfg.seed), query, max(k, cfg.pool)).select("id")
    found = rows.where("codes is not null").join(F.broadcast(pool), "id", "left_semi")
    return dense.search(found.select("id", "embedding").unionByName(rows.where("codes is null").select("id", "embedding")), query, k)


def exported(codes: DataFrame) -> DataFrame:
    """Codes as base64 text, on one line each."""
    return codes.withColumn("codes", F.regexp_replace(F.base64("codes"), r"\s", ""))


def imported(codes: DataFrame) -> DataFrame:
    return codes.withColumn("codes", F.unbase64("codes"))
