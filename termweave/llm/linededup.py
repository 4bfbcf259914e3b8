"""Removal of repeated passages by hashing units of text.

Units are lines, cut further at sentence ends, since repeated passages also
stand within lines.  A unit is normalised (A-Z lower-cased, white space
squeezed) and digested (128 bits).  As passages also begin and end within
sentences, runs of ``GRAM`` words are pieces as well: of every ``SPREAD`` that
follow each other the one of smallest digest, which two texts choose alike where
they agree.  Digests are counted over the whole corpus, and a piece is a repeat
unless it stands in the document of smallest doc_id that has it, and first there.
Repeated pieces that overlap or meet make a run, and runs of at least
``min_words`` words are removed.  Only words of repeated pieces are ever removed;
what stands between two of them stays.  So at least n - 2 (SPREAD - 1) words
go of any repeated passage of n >= GRAM + SPREAD - 1 words, wherever its
sentences end.  ``min_words`` of 1 removes every later occurrence of every unit;
the default spares short sentences that texts share by chance.  Offsets are
characters of the original text.

Texts are read twice: once for the digests and the documents that keep them,
once for the places of the pieces that repeat.  A bitmap of a fixed size over the
repeated digests keeps most other pieces from being shuffled the second time;
the join decides.

Defined results: a null or empty text has no units; rows of one doc_id are one
document, whose rows don't repeat each other; a null doc_id ranks last, and rows
without one count as one document; equal rows are treated alike; a tie between
documents can't be, since the smallest doc_id keeps a piece; other columns are
kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.shared import Words, bit_marks, dropped, fresh, marked, mixed, running_spans, stored, text_chunks

MIN_WORDS = 20
GRAM, SPREAD = 30, 11  # so 31 words or more of any repeated passage of over 50 words go
LAST = 2**63 - 1
CHUNK = 1 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def units_of(raw: np.ndarray, at: np.ndarray):
    """Per unit: row, ordinal in its row, first and last word; and the words."""
    words = Words(raw, at)
    n = len(words.start)
    row = words.row
    lines = np.concatenate([[0], np.cumsum((raw == 10) | (raw == 13))])
    final = np.ones(n, bool)
    if n:
        final[:-1] = (row[1:] != row[:-1]) | (lines[words.start[1:]] > lines[words.end[:-1]]) | _ENDS[words.raw[words.end[:-1] - 1]]
    last = np.flatnonzero(final) + 1
    first = np.concatenate([[0], last[:-1]]) if len(last) else last
    unit_row = row[first] if len(first) else np.zeros(0, np.int64)
    heads = np.searchsorted(unit_row, np.arange(len(at) - 1))
    return words, unit_row, np.arange(len(first)) - heads[unit_row], first, last


def grams_of(words: Words, hashes: np.ndarray, gram: int = GRAM, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of each run of ``gram`` words that is a piece."""
    n = len(hashes) - gram - spread + 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(hashes) - gram + 1)
    digest = running_spans(hashes, at, at + gram)
    row = words.row
    whole = np.flatnonzero(row[:n] == row[gram + spread - 2 :])
    best = np.unique(whole + np.lib.stride_tricks.sliding_window_view(digest, spread)[whole].argmin(1))
    return row[best], best


def pieces_of(raw: np.ndarray, at: np.ndarray, gram: int = GRAM, spread: int = SPREAD):
    """The words, and of each piece its row, first and last word and the halves of its digest."""
    words, row, _, first, last = units_of(raw, at)
    hashes = words.hashes()
    if gram:
        more, begin = grams_of(words, hashes, gram, spread)
        row, first, last = np.concatenate([row, more]), np.concatenate([first, begin]), np.concatenate([last, begin + gram])
    return words, row, first, last, running_spans(hashes, first, last), running_spans(mixed(hashes ^ _OTHER), first, last)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("content"), "text")


def kept_by(docs: DataFrame, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """digest, other, holder: the pieces that stand more than once, and the document that keeps each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                _, row, _, _, digest, other = pieces_of(raw, at, gram, spread)
                doc = part.column(0).to_numpy()[row]
                order = np.lexsort((doc, other, digest))
                digest, other, doc = digest[order], other[order], doc[order]
                heads = np.flatnonzero(np.append(True, (digest[1:] != digest[:-1]) | (other[1:] != other[:-1]))[: len(order)])
                n = np.diff(np.append(heads, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(digest[heads].view(np.int64)), pa.array(other[heads].view(np.int64)), pa.array(doc[heads]), pa.array(n)], names=["digest", "other", "doc", "n"])

    every = _rows(docs).mapInArrow(run, "digest long, other long, doc long, n long")
    return every.groupBy("digest", "other").agg(F.min("doc").alias("holder"), F.sum("n").alias("n")).filter("n > 1").drop("n")


def repeats(docs: DataFrame, known: DataFrame, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """The pieces that go: doc, content, holder, first, last (word bounds), start, end (characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_marks(known, F.col("digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                words, row, first, last, digest, other = pieces_of(raw, at, gram, spread)
                some = np.flatnonzero(marked(shared.value, digest.view(np.int64)))
                row, first, last, digest, other = (x[some] for x in (row, first, last, digest, other))
                # whether the text has the piece before, not overlapping it
                order = np.lexsort((first, other, digest, row))
                same = [x[order[1:]] == x[order[:-1]] for x in (row, digest, other)]
                heads = np.append(True, ~(same[0] & same[1] & same[2]))[: len(order)]
                again = np.zeros(len(order), bool)
                again[order] = first[order] - first[order[np.flatnonzero(heads)]][np.cumsum(heads) - 1] >= (last - first)[order]
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                base, head = chars[at[:-1]][row], words.first[row]
                take = pa.array(row)
                small = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(digest.view(np.int64)), pa.array(other.view(np.int64)), small(first - head), small(last - head),
                     small(chars[words.start[first]] - base), small(chars[words.end[last - 1]] - base), pa.array(again)],
                    names=["doc", "content", "digest", "other", "first", "last", "start", "end", "again"])

    found = _rows(docs).mapInArrow(run, "doc long, content long, digest long, other long, first int, last int, start int, end int, again boolean")
    return found.join(known, ["digest", "other"]).filter("again or doc <> holder").drop("digest", "other", "again")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """The passages to remove: doc (LAST for null), content, start, end, words, first_doc.

    first_doc is the document that keeps the passage's first piece; content a hash of
    the text, which tells rows of one doc_id apart.  gram=0 leaves units alone as pieces.
    """
    known = stored(kept_by(docs, gram, spread), "repeats")
    gone = repeats(docs, known, gram, spread)
    w = Window.partitionBy("doc", "content").orderBy("first", "last")
    # how far the pieces before reach; equal rows give each piece more than once, which adds nothing
    gone = gone.withColumn("reached", F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    gone = gone.withColumn("words", F.greatest(F.lit(0), F.col("last") - F.greatest("first", "reached")))
    runs = gone.withColumn("run", F.sum((F.col("first") > F.col("reached")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (
        runs.groupBy("doc", "content", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("holder", F.struct("first", "last")).alias("first_doc"))
        .filter(F.col("words") >= min_words)
        .select("doc", "content", "start", "end", "words", "first_doc")
    )
    spans = stored(spans, "spans")
    dropped(known)
    return spans


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """docs with repeated passages cut out of ``text``; ``n_chars``, if any, follows."""
    doc, content, spans = fresh(docs, "_doc"), fresh(docs, "_content"), fresh(docs, "_spans")
    found = repeated_spans(docs, min_words, gram, spread).groupBy(F.col("doc").alias(doc), F.col("content").alias(content)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), content: F.xxhash64("text")}).join(found, [doc, content], "left")
    s = F.col(f"`{spans}`")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(s)),
        lambda i: F.substring(
            F.col("text"),
            F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]) + 1,
            F.when(i == F.size(s), F.length("text")).otherwise(F.get(s, i)["start"]) - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]),
        ),
    )
    cut = joined.withColumn("text", F.when(s.isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed passage: doc_id, start, end, words, first_doc_id."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return spans.select(null("doc").alias("doc_id"), "start", "end", F.col("words").cast("long").alias("words"), null("first_doc").alias("first_doc_id"))
