"""Toxicity by cumulative-link ordinal regression on sparse text features.

``P(grade > j | x) = sigmoid(w.x - t_j)`` with ordered thresholds t_1 < t_2 < ...: one weight vector for
all grades, so that what tells the grades apart is where they lie on one scale. The output is the expected
severity, the sum over j of P(grade > j).

Features are hashed: words (lower-cased, letters only) and their prefixes of 4 to 6 characters (words that
are built from the same stem); a feature counts once in a document, and only features whose counts in the
toxic and the other part of the sample differ beyond chance (a G-test) get a weight, so that a long text's
many other words add no noise. Labels tell toxic from not, so that grades of toxic documents come from how
much of the text is toxic: the features most typical of the toxic sample are found by their log odds, and
their share in a document puts it in one of ``GRADES - 1`` equal parts. The model is fitted on a bounded sample of labelled rows, at most
``sample`` of them by hash order, all toxic ones of the sample and the others alike; everything else
is one pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows, read, texts

BITS = 20
GRADES = 4
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
_LETTERS = re.compile(r"[^\W\d_]+")
SEED = 7


def features(data: bytes, bits: int = BITS) -> np.ndarray:
    """The distinct feature numbers of a text."""
    h, mask = xxhash.xxh64_intdigest, (1 << bits) - 1
    words = _LETTERS.findall(data.decode("utf-8", "replace").lower())
    found = set()
    for w in set(words):
        found.add(h("w" + w) & mask)
        for n in (4, 5, 6):
            if len(w) > n:
                found.add(h("p" + w[:n]) & mask)
    return np.fromiter(found, np.int64, len(found))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def severity(self, found: np.ndarray) -> float:
        """Expected grade. Features are pooled by their sum, so that one strong word shows in a long text."""
        z = float(self.weights[found].sum()) if len(found) else 0.0
        return float((1 / (1 + np.exp(self.thresholds - z))).sum())


def _labelled(documents: DataFrame, labels: DataFrame, sample: int) -> list[tuple[np.ndarray, int]]:
    """At most ``sample`` (features, toxic): those with the smallest hash of their id, chosen before texts are read."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64(F.lit(SEED), "doc_id")).limit(sample)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    # Of texts that share an id the one with the smallest hash, so that reruns agree.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [features(t).astype(np.int32) for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32())), b.column("toxic")], names=["doc_id", "found", "toxic"])

    out = map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<int>, toxic {rows.schema['toxic'].dataType.simpleString()}")
    got = out.orderBy("doc_id").toArrow()
    return [(np.asarray(f.values).astype(np.int64), t) for f, t in zip(got.column("found"), got.column("toxic").to_pylist(), strict=True)]


def telling(found: list[np.ndarray], toxic: np.ndarray, least: float = 12.0) -> list[np.ndarray]:
    """The features whose counts differ between the two parts with a G statistic of ``least`` or more."""
    def counts(part: int) -> np.ndarray:
        own = [f for f, t in zip(found, toxic, strict=True) if t == part]
        return np.bincount(np.concatenate(own), minlength=1 << BITS).astype(np.float64) if own else np.zeros(1 << BITS)

    yes, no, n1, n0 = counts(1), counts(0), float(toxic.sum()), float((1 - toxic).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        all_ = yes + no
        terms = [np.nan_to_num(o * np.log(o * (n1 + n0) / (n * m))) for o, n, m in ((yes, n1, all_), (no, n0, all_), (n1 - yes, n1, n1 + n0 - all_), (n0 - no, n0, n1 + n0 - all_))]
    keep = (2 * sum(terms) >= least) & (all_ >= 3)
    return [f[keep[f]] for f in found]


def grades(found: list[np.ndarray], toxic: np.ndarray, bits: int = BITS, levels: int = GRADES) -> np.ndarray:
    """0 for documents that are not toxic, 1 ... for toxic ones by the share of typical features in them."""
    size = 1 << bits
    yes = np.bincount(np.concatenate([f for f, t in zip(found, toxic, strict=True) if t] or [np.empty(0, np.int64)]), minlength=size)
    no = np.bincount(np.concatenate([f for f, t in zip(found, toxic, strict=True) if not t] or [np.empty(0, np.int64)]), minlength=size)
    odds = np.log((yes + 0.1) / (toxic.sum() + 0.2)) - np.log((no + 0.1) / ((1 - toxic).sum() + 0.2))
    typical = np.where((odds > 2) & (yes >= 3), odds, 0.0)
    share = np.array([typical[f].sum() / np.sqrt(len(f) + 1) for f in found])
    out = np.zeros(len(found), np.int64)
    own = share[toxic == 1]
    if len(own):
        cuts = np.quantile(own, np.arange(1, levels - 1) / (levels - 1))
        out[toxic == 1] = 1 + np.searchsorted(cuts, own, side="left")
    return out


def likelihood(w: np.ndarray, raw: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(negative log-likelihood of the cumulative links, its slopes by weights and by ``raw``): t_1, then the gaps' logs."""
    n, levels, at = len(grade), len(raw) + 1, np.arange(len(grade))
    gaps = np.exp(raw[1:])
    t = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
    z = np.bincount(rows, w[cols], minlength=n)
    s = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -30, 30)))  # P(grade > j)
    p = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
    own = np.maximum(p[at, grade] - p[at, grade + 1], 1e-9)
    slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
    low, high = slope[at, grade] / own * weight / n, slope[at, grade + 1] / own * weight / n
    gt = np.bincount(grade, low, minlength=levels)[1:] - np.bincount(grade, high, minlength=levels)[:-1]
    tail = np.cumsum(gt[::-1])[::-1]
    gw = np.bincount(cols, (high - low)[rows], minlength=len(w)) + l2 * w
    return float(-(weight * np.log(own)).sum() / n + l2 * (w @ w) / 2), gw, np.concatenate([[tail[0]], tail[1:] * gaps])


def fit(found: list[np.ndarray], grade: np.ndarray, bits: int = BITS, levels: int = GRADES, rounds: int = 300, rate: float = 0.05, l2: float = 3e-4) -> Model:
    """Maximum likelihood by Adam over the whole sample, in compressed rows; thresholds stay in order."""
    size = 1 << bits
    used, cols = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_inverse=True)
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    w, raw = np.zeros(len(used)), np.concatenate([[2.0], np.zeros(levels - 2)])
    live = np.bincount(cols, minlength=len(used)) >= 3  # a feature of fewer documents says nothing about others
    weight = np.where(grade > 0, max(1.0, np.sqrt((grade == 0).sum() / max(1, (grade > 0).sum()))), 1.0)
    m = [np.zeros_like(w), np.zeros_like(raw)]
    v = [np.zeros_like(w), np.zeros_like(raw)]
    for step in range(1, rounds + 1 if len(found) else 1):
        _, gw, graw = likelihood(w, raw, rows, cols, grade, weight, l2)
        for k, (x, g) in enumerate(((w, np.where(live, gw, 0.0)), (raw, graw))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(size, np.float32)
    out[used] = np.where(live, w, 0.0)
    return Model(out, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))]), bits)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of a bounded sample; without labels (or without toxic ones) it finds nothing toxic."""
    rows = _labelled(documents, labels, sample)
    found, toxic = [f for f, _ in rows], np.array([int(x > 0) for _, x in rows], np.int64)
    if not toxic.any():
        return Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 30.0))
    found = telling(found, toxic)
    return fit(found, grades(found, toxic))


def scored(spark: SparkSession, docs: DataFrame, model: Model, toxic_from: float = 0.5) -> DataFrame:
    """(doc_id, severity, grade, toxic), a row for each row of ``docs``, in one narrow pass.

    severity: expected grade; grade: the nearest one; toxic: severity >= ``toxic_from``. Null and empty
    texts have no features and get the severity of such; very long texts are taken whole; a severity that ties with
    ``toxic_from`` is toxic; repeated rows score alike; an empty table gives none; other columns are ignored, whatever
    their names. The model is 2**20 floats, whatever the input.
    """
    held = spark.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = held.value
        s = [m.severity(features(t, m.bits)) for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "severity"])

    out = map_rows(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, severity double")
    return out.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= toxic_from).alias("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity of all documents; nulls, long texts, ties and repeats as in ``scored``."""
    docs = read(spark, sf_dir, "documents")
    return scored(spark, docs, train(docs, read(spark, sf_dir, "labels")))
