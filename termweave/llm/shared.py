"""How texts reach numpy, and small helpers.

Intermediate results that several jobs read are written as Parquet in the folder
that the cluster shares (see ``sources.scratch``).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources import scratch
from termweave.sources.scratch import dropped

__all__ = ["bit_marks", "bounded", "dropped", "fresh", "marked", "mixed", "running_spans", "sampled", "shingles", "span_sums", "stored", "text_chunks", "Words"]

CHUNK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Makes Arrow batches small in bytes, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def _give_back() -> None:
    """Returns freed memory to the system: idle workers keep what they once used otherwise."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def stored(df: DataFrame, what: str, clean: bool = False, **options: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it: lineage ends here."""
    bounded(df.sparkSession)
    return scratch.stored(df, what, clean, **options)


def sampled(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """The rows whose key's hash is among the smallest, so many keys that there are about ``most``;
    all if there are no more.  Nothing is sorted or collected."""
    n = df.select(key).distinct().count()
    return df if n <= most else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def text_chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows holding about ``size`` bytes of text each.

    Yields the rows, their text bytes in one array and the row offsets in it.
    A null text is an empty one.  A row is never cut: one longer than ``size``
    makes a run of its own.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    _give_back()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        keep = n <= 2 * CHUNK_BYTES + 65536
        out = []
        for base in (_BASE, _UNBASE):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if not keep:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (MurmurHash3's public finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The white-space separated words of a run of texts, A-Z lower-cased.

    ``start``/``end`` are byte positions in ``raw``, ``first`` the index of each
    row's first word (one more entry at the end).
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends = solid.copy()
        if n:
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return mixed(span_sums(self.raw, self.start, self.end) + (self.end - self.start).astype(np.uint64))


def span_sums(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each raw[start:end], from running sums."""
    up, down = _powers_to(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


#: Odd multipliers of the five places of a shingle.
_PLACES = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)) for k in range(64)]


def shingles(words: Words, width: int = 5, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words, and the row of each.

    A text of fewer words, but one at least, has one shingle of all of them.
    """
    h = words.hashes() if hashes is None else hashes
    counts = np.diff(words.first)
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    total = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        total += mixed(h[k : n - width + 1 + k] * _PLACES[k]) if len(total) else 0
    full = np.flatnonzero(row[: len(total)] == row[width - 1 :]) if len(total) else np.zeros(0, int)
    out, rows = mixed(total[full]), row[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += mixed(h[words.first[short[has]] + k] * _PLACES[k])
        out, rows = np.concatenate([out, mixed(extra)]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def running_spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end] of 64-bit numbers."""
    up, down = _powers_to(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


BITS = 26  # of a bitmap that keeps unwanted rows back: 8 MB, whatever the input


def bit_marks(df: DataFrame, key) -> np.ndarray:
    """A bitmap of 2 ** BITS bits over the 64-bit numbers ``key`` of df."""
    place = key.bitwiseAND((1 << BITS) - 1)
    marks = df.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(32767).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros((1 << BITS) // 8, np.uint8)
    for r in marks.collect():
        bitmap[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit number is set: always for those that were marked."""
    at = keys & ((1 << BITS) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
