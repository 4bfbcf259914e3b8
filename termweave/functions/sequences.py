"""Kernels over sequences that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

AT_ONCE = 200_000  # array elements that are Python objects at once
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: of long arrays ten thousand rows are too many for a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a row of the table as one number's bits."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def pieces(batch: pa.RecordBatch, columns: Sequence[int], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose arrays in the columns hold about ``most`` elements, so that few are Python objects at once.

    A row is never cut: one of more elements is a run of its own.
    """
    size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_common_subsequence(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs (pair_id, a, b) of token arrays as (pair_id, sizes of a and b, ``name``: the common length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, (1, 2), AT_ONCE)):
            left, right = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sizes = [pa.array([float(len(x)) for x in side]) for side in (left, right)]
            found = pa.array([float(common_subsequence(x, y)) for x, y in zip(left, right, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, found], names=["pair_id", a, b, name])

    small_batches(pairs.sparkSession)
    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", a, b).mapInArrow(run, f"pair_id {kind}, {a} double, {b} double, {name} double")
