"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the mean of the embeddings of its character n-grams (bytes, with
word bounds), so an unseen misspelling shares most of its vector with the word
it comes from.  A window of words is the mean of its words, a linear softmax
judges each window, and a document's logit is the soft maximum over its
windows.  Embeddings and softmax are trained jointly in numpy (AdaGrad) on the
driver, on a sample by hash of about ``MAX_TRAIN`` labelled documents and
``MAX_BYTES`` of text: fixed bounds, so the driver's memory, the model and its
broadcast don't grow with the corpus.

Defined results: a null or empty text has no window and gets the score of the
bias alone; without any label every score is 0, with labels of one kind it is 0 or
(toxic ones) nearly 1; a doc_id labelled twice counts as toxic if one label says
so, null labels don't count; of several rows of one labelled doc_id the smallest
text is learned from; repeated rows are scored alike; other columns don't matter,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.shared import Words, bounded, mixed, span_sums, text_chunks

MAX_TRAIN = 6_000  # labelled documents the model is fitted on, about
MAX_BYTES = 16 << 20  # of their texts, about
LONGEST = 1 << 20  # bytes of a text it is fitted on; longer ones are scored only
BUCKETS, DIM = 1 << 17, 8
NGRAMS = (3, 4, 5, 6)
WINDOW = 8
SHARP = 16.0  # of the soft maximum, reached by doubling from epoch to epoch
EPOCHS, BATCH, RATE = 4, 16, 1.0
SCALE = 16.0  # of a window's mean under the softmax: one telling word of a window suffices
THRESHOLD = 0.3
CHUNK = 1 << 20


def word_grams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's n-grams, ragged: every word has one at least."""
    length = end - start + 2
    first = np.concatenate([[0], np.cumsum(length)])
    flat = np.zeros(first[-1], np.uint8)
    body = np.ones(first[-1], bool)
    body[first[:-1]] = False
    body[first[1:] - 1] = False
    flat[first[:-1]], flat[first[1:] - 1] = 1, 2
    flat[body] = raw[np.repeat(start - np.concatenate([[0], np.cumsum(end - start)])[:-1], end - start) + np.arange((end - start).sum())]
    word = np.repeat(np.arange(len(start)), length)
    left = first[1:][word] - np.arange(first[-1])
    grams, owners = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        grams.append((mixed(span_sums(flat, at, at + n) + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(word[at])
    grams.append((mixed(span_sums(flat, first[:-1], first[1:])) & np.uint64(BUCKETS - 1)).astype(np.int32))
    owners.append(np.arange(len(start)))
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return gram[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(start)))])


class Bags:
    """Windows of texts over their distinct words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        words = Words(raw, at)
        _, one, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.gram, self.first = word_grams(words.raw, words.start[one], words.end[one])
        row = words.row
        place = np.arange(len(row)) - words.first[:-1][row]
        head = place % WINDOW == 0
        self.window = np.cumsum(head) - 1
        self.heads = np.flatnonzero(head)
        self.size = np.diff(np.append(self.heads, len(row)))
        self.row = row[self.heads]
        self.rows = len(at) - 1
        self.doc = np.searchsorted(self.row, np.arange(self.rows + 1))

    def window_logits(self, per_gram: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.heads):
            return np.zeros(0)
        per_word = np.add.reduceat(per_gram[self.gram], self.first[:-1]) / np.diff(self.first)
        return np.add.reduceat(per_word[self.word], self.heads) / self.size + bias

    def scores(self, per_gram: np.ndarray, bias: float) -> np.ndarray:
        z = self.window_logits(per_gram, bias)
        out = np.full(self.rows, bias)
        some = np.flatnonzero(np.diff(self.doc))
        if len(some):
            counts = np.diff(self.doc)[some]
            pull = np.exp(SHARP * (z - np.repeat(np.maximum.reduceat(z, self.doc[some]), counts)))
            out[some] = np.add.reduceat(pull * z, self.doc[some]) / np.add.reduceat(pull, self.doc[some])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """A score for each n-gram bucket (its embedding under the softmax) and the bias.

    The two-class softmax depends on the difference of its rows only, so one
    row is learned.  A document's logit is that of its highest window; the
    gradient is shared over windows by the soft maximum, sharper by the epoch.
    """
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))) if len(labels) and labels.max() else -40.0
    order = rng.permutation(len(texts))
    batches = []
    for b in range(0, len(order), BATCH):
        part = order[b : b + BATCH]
        data = [texts[i].encode() for i in part]
        bags = Bags(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        batches.append((bags, labels[part].astype(float)))
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    top = rng.normal(0, 0.5, DIM).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    squares, top_squares, bias_squares = np.full(BUCKETS, 1e-4, np.float32), 1e-4, 1e-4
    for epoch in range(EPOCHS):
        sharp = SHARP / 2.0 ** max(0, EPOCHS - 2 - epoch)
        for k in rng.permutation(len(batches)):
            bags, y = batches[k]
            if not len(bags.heads):
                continue
            # half of the n-grams are left out at random, so that the others tell the word too
            weight = 2 * (rng.random(len(bags.gram)) < 0.5) / np.repeat(np.diff(bags.first), np.diff(bags.first))
            vectors = np.add.reduceat(table[bags.gram] * weight.astype(np.float32)[:, None], bags.first[:-1], axis=0)
            windows = np.add.reduceat(vectors[bags.word], bags.heads, axis=0) / bags.size[:, None]
            z = SCALE * (windows @ top) + bias
            some = np.flatnonzero(np.diff(bags.doc))
            counts = np.diff(bags.doc)[some]
            peak = np.repeat(np.maximum.reduceat(z, bags.doc[some]), counts)
            pull = np.exp(sharp * (z - peak))
            pull /= np.repeat(np.add.reduceat(pull, bags.doc[some]), counts)
            pooled = np.add.reduceat(pull * z, bags.doc[some])
            err = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y[some]) / len(some)
            gz = np.repeat(err, counts) * pull
            g_bias = gz.sum()
            gz *= SCALE
            g_top = gz @ windows
            per_word = np.bincount(bags.word, (gz / bags.size)[bags.window], len(bags.first) - 1)
            per_gram = np.repeat(per_word, np.diff(bags.first)) * weight
            # each n-gram's gradient is a multiple of ``top``
            use, back = np.unique(bags.gram, return_inverse=True)
            g = np.bincount(back, per_gram).astype(np.float32)
            squares[use] += (g * g) * float(top @ top)
            table[use] = table[use] - (RATE * g / np.sqrt(squares[use]))[:, None] * top
            top_squares += float(g_top @ g_top)
            bias_squares += float(g_bias * g_bias)
            top -= (RATE / 10 * g_top / np.sqrt(top_squares)).astype(np.float32)
            bias -= RATE / 10 * g_bias / np.sqrt(bias_squares)
    return (SCALE * (table @ top)).astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, longest: int = LONGEST) -> tuple[np.ndarray, float]:
    """Trains on labelled documents outside the held-out quarter: a sample by hash of about as
    many rows and bytes as the bounds allow, of texts up to ``longest`` bytes."""
    bounded(docs.sparkSession)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes"))  # no text is shuffled
    size = sizes.join(known, "doc_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    share = min(1.0, max_train / max(size["n"], 1), max_bytes / max(size["bytes"] or 0, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return train(rows.column("text").to_pylist(), rows.column("toxic").to_numpy().astype(int))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    per_gram, bias = fit(docs, labels, max_train)
    model = docs.sparkSession.sparkContext.broadcast(per_gram)  # BUCKETS floats: half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                score = Bags(raw, at).scores(model.value, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
