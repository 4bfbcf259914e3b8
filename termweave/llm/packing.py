"""Packing tokenised documents into sequences by the sum-of-squares rule.

Documents are tokenised once; pieces of a full sequence are closed at once.
The others are dealt evenly over shards of a bounded number of pieces.  Each
shard places its pieces, longest first, where the sum of squared counts of
open sequences per residual gap becomes smallest (Csirik et al., "On the
Sum-of-Squares Algorithm for Bin Packing").

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed as rows of their own; a null doc_id is kept; other
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.bpe import WordModel, word_model
from termweave.llm.shared import Words, stored, text_chunks

MODEL = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 1
SHARD = 60_000  # pieces packed together; a shard's last open sequences are all the waste
CHUNK = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_rows(model: WordModel, raw: np.ndarray, at: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row with the end id after them, ragged."""
    words = Words(raw, at, lower=False)  # special strings are told by their case
    _, one, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    out, ends = model.encode(words.raw, words.start[one], words.end[one])
    length = np.diff(ends)[back]
    rows = len(at) - 1
    tokens = np.concatenate([[0], np.cumsum(length)])
    per_row = tokens[words.first[1:]] - tokens[words.first[:-1]]
    first = np.concatenate([[0], np.cumsum(per_row + 1)])
    ids = np.full(first[-1], end_id, np.uint32)
    # a word's ids stand after those before it and the end ids of earlier rows
    place = tokens[:-1] + np.repeat(np.arange(rows), np.diff(words.first))
    target = np.repeat(place - tokens[:-1], length) + np.arange(tokens[-1])
    ids[target] = out[np.repeat(ends[:-1][back] - tokens[:-1], length) + np.arange(tokens[-1])]
    return ids, first


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_model(path)
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                ids, first = encoded_rows(model, raw, at, end_id)
                ids = ids.astype("<u4", copy=False)
                total = np.diff(first)
                n = -(-total // length)
                row = np.repeat(np.arange(len(total)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = k * length
                size = np.minimum(total[row] - start, length)
                lo = first[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), (lo + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size, placed in the given order.

    counts[g]: open sequences with gap g.  Moving one from gap g to g - s
    changes the sum of squares by 2 * (counts[g - s] - counts[g]) + 2 (a full one
    isn't counted).  Equal changes go to the smaller gap.  A new one is opened only
    if no open one has room, for as few sequences as possible.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0
    for i, s in enumerate(sizes.tolist()):
        room = counts[s:capacity]
        best = -1
        if capacity - s:
            here = np.flatnonzero(room)
            if len(here):
                after = counts[here]
                after[here == 0] = 0
                change = 2 * (after - room[here]) + 2
                change[here == 0] = 1 - 2 * room[0] if room[0] else 0  # it closes
                k = int(change.argmin())
                best = s + int(here[k])
        if best < 0:
            b, gap = opened, capacity
            opened += 1
        else:
            b, gap = stacks[best].pop(), best
            counts[gap] -= 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            counts[gap - s] += 1
            stacks[gap - s].append(b)
    return sequence, offset


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Every piece with its sequence_id and the offset in it."""
    made = stored(pieces(docs, path, length, end_id), "pieces")
    partial = made.filter(F.col("length") < length)
    shards = max(1, -(-partial.count() // shard))
    full = made.filter(F.col("length") == length).select("*", F.expr("-1 - monotonically_increasing_id()").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = sum_of_squares(g["length"].to_numpy(), length)
        return g.drop(columns="shard").assign(sequence_id=sequence + (int(g["shard"].iloc[0]) << 40), offset=offset)

    dealt = partial.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    rest = dealt.groupBy("shard").applyInPandas(place, PIECES + ", sequence_id long, offset long")
    return full.unionByName(rest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
