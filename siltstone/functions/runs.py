"""What Python is given at once: runs of rows bounded by bytes, and whole groups of rows without a call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Text bytes of a run, about; a longer text is a run of its own.
RUN_BYTES = 2 << 20


def text_runs(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have at most about ``most`` bytes."""
    most = most or RUN_BYTES
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
        at = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and total + n > most:
                yield b.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < b.num_rows:
            yield b.slice(at)


def in_groups(rows: DataFrame, keys: list[str], order: str, f: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """``f`` of every group's rows (``columns``) in ``order``; what it returns comes after the keys, in the columns of ``schema``.

    Groups are sorted next to each other, so that a task reads them as a stream and holds one group and one batch.
    """
    names = [*keys, order, *columns]
    src = rows.select(*dict.fromkeys(names)).repartition(*keys).sortWithinPartitions(*keys, order)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    out = f"{kinds}, {schema}"
    made = rows.sparkSession.createDataFrame([], out).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(made)
        n = len(keys)
        of = itemgetter(*range(n)) if n > 1 else itemgetter(0)
        held: list[tuple] = []  # the group that may go on
        for b in batches:
            done: list[tuple] = []
            both = zip(*(b.column(c).to_pylist() for c in [*keys, *columns]), strict=True)
            for key, group in groupby(both, of):
                if held and of(held[0]) != key:
                    done += _of(held)
                    held = []
                held.extend(group)
            if done:
                yield batch(done, arrow)
        if held:
            yield batch(_of(held), arrow)

    def _of(group: list[tuple]) -> list[tuple]:
        key = group[0][: len(keys)]
        return [(*key, *r) for r in f([g[len(keys) :] for g in group])]

    def batch(made: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], names=arrow.names)

    return src.mapInArrow(run, out)
