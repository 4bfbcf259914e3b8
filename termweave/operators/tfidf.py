"""TF-IDF keywords of each document, in long format.

``top_of_documents`` gives what ``top_terms`` of ``weights`` of ``counted_terms`` does, for whole
documents: their terms are counted in Arrow batches, a batch asks once for each of its
distinct terms, and the answers come back to the batch, so that no row a document and term is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.functions.sequences import small_batches
from termweave.sources.scratch import LARGE_ROWS, dropped, stored

BYTES = 4 << 20  # of the texts that ask together
LETTERS = "\\p{L}\\p{N}"


def term_counts(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf) from (doc_id, term) occurrences."""
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def counted_terms(documents: DataFrame, words: Column) -> DataFrame:
    """(doc_id, term, tf) of documents, a row a doc_id, whose ``words`` are an array: counted where the row lies, so that occurrences aren't shuffled.

    The words are sorted; a term's count is the distance from its first place to the next term's.
    """
    sorted_ = T.held(documents, "doc_id", w=F.sort_array(words)).filter("size(w) > 0")
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    places = T.held(sorted_, "doc_id", "w", s=first)
    each = F.transform("s", lambda i, j: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("s", j + 1), F.size("w")) - i).cast("long").alias("tf")))
    return places.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.term", "x.tf")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def _with_idf(frequencies: DataFrame, n: DataFrame, min_df: int, max_share: float) -> DataFrame:
    """Terms neither too rare nor too common, with their idf; n is one row."""
    ok = (F.col("df") >= F.least(F.lit(min_df), F.col("n"))) & (F.col("df") <= F.when(F.col("n") < 3, F.col("n")).otherwise(max_share * F.col("n")))
    return frequencies.crossJoin(F.broadcast(n)).filter(ok).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)


def weights(tf: DataFrame, documents: DataFrame, min_df: int = 2, max_share: float = 0.85) -> DataFrame:
    """(doc_id, term, tf, df, weight): smooth idf, rows of unit length.

    Terms of too few or too many documents are left out; min_df is at most the
    number of documents, and below three documents nothing is too common.
    """
    df = _with_idf(document_frequencies(tf), documents.agg(F.count("*").alias("n")), min_df, max_share)
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", "tf", "df", (F.col("w") / norm).alias("weight"))


def top_terms(weighted: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """(doc_id, rank, term, weight) of the k heaviest terms; ties go to the later term.

    Weights are rounded before ranking, so that the order of summing doesn't matter.
    """
    rounded = weighted.filter("weight > 0").select("doc_id", "term", F.round("weight", digits).alias("weight"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("term"))
    return rounded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("doc_id", "rank", "term", "weight")


def keywords(weighted: DataFrame, valid, first: int = 30, k: int = 10) -> DataFrame:
    """The first k valid terms among the ``first`` heaviest: (doc_id, rank, term, weight)."""
    return first_valid(top_terms(weighted, first), valid, k)


def first_valid(top: DataFrame, valid, k: int = 10) -> DataFrame:
    """The first k valid terms of (doc_id, rank, term, weight), ranked anew."""
    candidates = top.filter(valid(F.col("term")))
    again = Window.partitionBy("doc_id").orderBy("rank")
    return candidates.withColumn("r", F.row_number().over(again)).filter(F.col("r") <= k).select("doc_id", F.col("r").alias("rank"), "term", "weight")


def counted_batches(documents: DataFrame, text: Column, least: int = 2, most: int = BYTES, letters: str = LETTERS) -> DataFrame:
    """The words of at least so many of the letters in lower-case texts.

    A row a run of documents of about ``most`` bytes: chunk, doc_id and terms (each document's number of them),
    term and df (the run's distinct terms in order, and in how many of its documents), and of each document and term
    the term's place (code) and count (tf), as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // most
            heads = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for lo, hi in zip(heads, heads[1:], strict=False):
                split = pc.split_pattern_regex(batch.column(1).slice(lo, hi - lo), f"[^{letters}]+")
                found = split.flatten().dictionary_encode()
                order = pc.sort_indices(found.dictionary).to_numpy()
                order = order[pc.utf8_length(found.dictionary).to_numpy()[order] >= least]
                place = np.full(len(found.dictionary), -1)
                place[order] = np.arange(len(order))
                width, at = max(len(order), 1), place[found.indices.to_numpy()]
                row = np.repeat(np.arange(hi - lo), split.value_lengths().to_numpy())
                pair, tf = np.unique((row * width + at)[at >= 0], return_counts=True)
                row, code = pair // width, pair % width
                ids, terms = batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(row, minlength=hi - lo).astype(np.int32))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, terms, found.dictionary.take(pa.array(order)), pa.array(np.bincount(code, minlength=len(order)).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), *lists, *(pa.array([x.astype(np.int32).tobytes()]) for x in (code, tf))], names=["chunk", "doc_id", "terms", "term", "df", "code", "tf"])
                k += 1

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.lower(F.coalesce(text, F.lit(""))).alias("w")).mapInArrow(run, f"chunk long, doc_id array<{kind}>, terms array<int>, term array<string>, df array<int>, code binary, tf binary")


def top_of_documents(documents: DataFrame, text: Column, k: int = 10, digits: int = 9, min_df: int = 2, max_share: float = 0.85, least: int = 2, most: int = BYTES) -> DataFrame:
    """(doc_id, rank, term, weight) of the k heaviest words of at least so many letters, as ``top_terms`` ranks them.

    A row a doc_id; words are runs of letters and digits of the lower-case ``text``.
    """
    small_batches(documents.sparkSession)
    made = stored(counted_batches(documents, text, least, most), "terms", **LARGE_ROWS)
    frequencies = made.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df"))
    n = made.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).cast("long").alias("n"))
    known = _with_idf(frequencies, n, min_df, max_share).select("term", "idf")
    answers = made.select("chunk", F.posexplode("term").alias("place", "term")).join(known, "term").select(F.col("chunk").alias("asked"), "place", "idf")

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in range(left.num_rows):
            ids, terms, words = (left.column(c)[r].values for c in ("doc_id", "terms", "term"))
            code, tf = (np.frombuffer(left.column(c)[r].as_py(), np.int32) for c in ("code", "tf"))
            idf = np.zeros(len(words))
            idf[right.column("place").to_numpy()] = right.column("idf").to_numpy()
            w, row = tf * idf[code], np.repeat(np.arange(len(ids)), terms.to_numpy())
            norm = np.sqrt(np.bincount(row, w * w, len(ids)))
            some = np.flatnonzero(w > 0)
            row, code = row[some], code[some]
            weight = np.round(w[some] / norm[row], digits)
            order = np.lexsort((-code, -weight, row))
            order = order[weight[order] > 0]
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = rank < k
            order = order[kept]
            out.append(pa.table({"doc_id": ids.take(pa.array(row[kept])), "rank": pa.array((rank[kept] + 1).astype(np.int32)), "term": words.take(pa.array(code[order])), "weight": pa.array(weight[order])}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], left.schema.field("doc_id").type.value_type), "rank": pa.array([], pa.int32()), "term": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})

    kind = documents.schema["doc_id"].dataType.simpleString()
    top = made.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(ranked, f"doc_id {kind}, rank int, term string, weight double")
    out = stored(top, "top")
    dropped(made)
    return out
