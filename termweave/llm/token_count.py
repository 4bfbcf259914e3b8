"""Token counts of whole texts, by rank-synchronous merging of ragged arrays.

Texts are cut where the model can't merge (at a space after another
character), equal parts of a batch are merged once, and the symbols that
survive are summed by text.  See ``bpe`` for the merging itself.

Defined results: a null or empty text has 0 bytes and 0 tokens; every row is
counted, repeated ids too; other columns don't matter; an empty table gives an
empty result.  No text is cut short, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.bpe import PieceModel, piece_model
from termweave.llm.shared import bounded, mixed, span_sums, text_chunks

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 2 << 20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_rows(model: PieceModel, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens of rows raw[at[i]:at[i+1]] that each begin with a space."""
    space = raw == 0x20
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[at[:-1]] = True
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(raw))
    h = mixed(span_sums(raw, start, end) + (end - start).astype(np.uint64))
    _, one, back = np.unique(h, return_index=True, return_inverse=True)
    s, length = start[one], (end - start)[one]
    first = np.concatenate([[0], np.cumsum(length)])
    flat = raw[np.repeat(s - first[:-1], length) + np.arange(first[-1])]
    codes = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    codes[codes == 0x20] = ord(model.MARK)
    per_part = model.count(codes, heads[first])
    sums = np.concatenate([[0], np.cumsum(per_part[back])])
    bounds = np.searchsorted(start, at)
    return sums[bounds[1:]] - sums[bounds[:-1]]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``."""
    path = path or model_path()
    bounded(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(text)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", text.type), pc.replace_substring(text, model.MARK, " "), pa.scalar("", text.type))
            rows = pa.RecordBatch.from_arrays([batch.column(0), size, spaced], ["doc_id", "n_bytes", "text"])
            for part, raw, at in text_chunks(rows, size=CHUNK):
                n_bytes = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.where(n_bytes > 0, count_rows(model, raw, at), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
