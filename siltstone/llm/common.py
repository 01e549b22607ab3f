"""What the operators of this package share: words, word hashes, scratch tables and small joins.

Words are runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``); on UTF-8 bytes that is
exactly what ``bytes.split()`` and Arrow's ``ascii_split_whitespace`` return.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError

WORD = r"[^\x20\x09-\x0D]+"
#: A side of a join is broadcast only if it has been counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 100_000
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    One of our own only where it names none and all tasks run on this machine: a cluster has to name a shared one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise SiltstoneError("spark.checkpoint.dir has to name a folder that all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs only its tasks.

    ``with Scratch(spark) as s:`` removes every table at the end but those made with ``keep=True``, which
    go when the session ends. While a table is written, Spark drops the shuffle files of that write at its
    end, so that the disk holds those of one step at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, keep: bool = False, settings: dict[str, str] | None = None, block: int | None = None) -> DataFrame:
        """``df``, written and read again. ``settings`` of the session hold while it is written; ``block``: bytes of a row group."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        settings = {_CLEAN: "true", **(settings or {})}
        before = {k: self.spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            self.spark.conf.set(k, v)
        try:
            w = df.write.option("compression", "zstd")
            (w.option("parquet.block.size", block) if block else w).parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)
        if keep:
            self._fs(path)[0].deleteOnExit(self._fs(path)[1])
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def drop(self, df: DataFrame) -> None:
        """Removes a table of this scratch before its end."""
        files = df.inputFiles()
        for path in [p for p in self.paths if any(p.split(":", 1)[-1].lstrip("/") in f for f in files)]:
            fs, p = self._fs(path)
            fs.delete(p, True)
            self.paths.remove(path)

    def __exit__(self, *_) -> None:
        for path in self.paths:
            fs, p = self._fs(path)
            fs.delete(p, True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe equi join on ``on``; ``small`` is broadcast if its counted rows are at most ``most``.

    Beyond that it is a shuffled join, of which adaptive execution splits hot keys. ``small`` has to be
    a written table, so that counting it costs nothing.
    """
    hint = small.limit(most + 1).count() <= most
    keys = {k: f"__small_{k}" for k in on}
    side = small.withColumnsRenamed(keys)
    side = F.broadcast(side) if hint else side
    cond = None
    for k, v in keys.items():
        c = big[k].eqNullSafe(side[v])
        cond = c if cond is None else cond & c
    return big.join(side, cond, how).drop(*keys.values())


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row, empty for null."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for x in column:
        v = x.as_buffer()
        yield v.to_pybytes() if v is not None else b""


# ---- tokens, a bounded run of texts at a time --------------------------------------------------

#: Text bytes that are split at once, about; a longer text is a run of its own.
RUN_BYTES = 2 << 20


@dataclass(frozen=True)
class Tokens:
    """The words of a run of texts: the distinct ones, the number of each word in order, and how many each text has."""

    words: pa.Array
    ids: np.ndarray
    lens: np.ndarray

    @cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.lens)

    @cached_property
    def starts(self) -> np.ndarray:
        return self.ends - self.lens

    @cached_property
    def text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def runs_of(self, k: int) -> np.ndarray:
        """The places where ``k`` words of one text begin."""
        at = np.arange(max(0, len(self.ids) - k + 1))
        return at[at + k <= self.ends[self.text[at]]]

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each distinct word: the halves of a BLAKE2b digest of its bytes."""
        raw = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.words.to_pylist())
        both = np.frombuffer(raw, "<u8").reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def filled(column: pa.Array) -> pa.Array:
    """The texts with nulls as empty ones."""
    return pc.fill_null(column if pa.types.is_large_string(column.type) else column.cast(pa.string()), "")


def tokenized(column: pa.Array, lower: bool = False) -> Tokens:
    column = filled(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    lens = np.asarray(lists.value_lengths()).astype(np.int64)
    flat = lists.flatten()
    flat = flat.cast(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary())
    real = np.asarray(pc.binary_length(flat)) > 0  # white space at either end of a text leaves an empty word
    of = np.repeat(np.arange(len(lens)), lens)[real]
    own = flat.filter(pa.array(real)).dictionary_encode()
    return Tokens(own.dictionary, np.asarray(own.indices).astype(np.int64), np.bincount(of, minlength=len(lens)))


def byte_runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of at most about ``most`` text bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield at, i - at
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes) - at


def map_runs(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """``map_rows``, a run of texts at a time: what a task holds is bounded by bytes, not by rows."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, n in byte_runs(b.column(text)):
            yield from f(b.slice(at, n))

    return map_rows(df, run, schema)


_RNG = np.random.RandomState(20240229)
#: Odd multipliers for runs of words.
MULTIPLIERS = _RNG.randint(0, 2**62, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(salt), np.uint64)
        for j in range(k):
            out += h[j : j + n] * MULTIPLIERS[(j + 13 * salt) % 64]
    return mix(out)
