"""Language-model scores from a hashed maximum-entropy model.

A text's tokens are its words (A-Z lower-cased, cut at white space) and one
end.  The model has three factors, each of which sums to one:

* a softmax over classes of tokens, given hashed features of the context (the last
  word, the last but one as a skip feature, and both as an n-gram).  The most
  frequent words and the end are classes of their own; every other word belongs to
  a class by its last two bytes, so unseen words have a class too;
* a softmax over the ``SUB`` parts of such a class, given hashed features of the class
  with the last word and with the n-gram;
* the share of the token in its part, where one unseen word is allowed for.

Behind every context of two words the words that followed it in training are
features of their own: they get their discounted share
(absolute discounting; the discount comes from how many n-grams stand once and
twice), and what the discount leaves is dealt out by the factors above.  A training
text is scored by the n-grams of the other texts, its own are left out, so a text
that stands twice is told from one that stands once.

Texts are written once in chunks of about ``CHUNK`` bytes.  A chunk asks about its distinct words,
contexts and n-grams, in blocks: one for each of the buckets that the hashes are cut into.  A bucket
of all chunks has all there is of its hashes, counts it and answers each block, in the block's
order.  So a hash is moved once, no count is kept but the words' own, and the chunk, which finds the
same order again, joins its answers by number.  Buckets have about ``BUCKET`` bytes of text each;
they are moved in ``PASSES`` parts, each of which reads the chunks again, so that a part's
blocks are gone before the next part's are written.

The softmaxes are trained by distributed gradient updates: in each round every shard
starts from the shared weights, makes AdaGrad steps over its part of the round's
texts, and the shards' weights are averaged feature by feature, weighted by how
often they met the feature, in steps of ``FAN`` at once.  All training texts are used
once.  Shards have about ``SHARD`` tokens, however many cores there are; which texts
share a shard follows from how the files are split.  Weights have a fixed size
(about 6 MB).

Defined results: a null or empty text is the end alone; rows of a null doc_id
are training texts; repeated rows count each, and leave only themselves out;
other columns don't matter, whatever their names; an empty table gives an empty
result.  Words are told apart by 64-bit hashes, contexts by 56 bits within their bucket and the
words behind one context by 40 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.shared import Words, dropped, mixed, stored, text_chunks

SINGLE, SUFFIX, SUB = 16, 16, 16
CLASSES = SINGLE + SUFFIX
LEAVES = SINGLE + SUFFIX * SUB
TOP = 1 << 18  # words whose ranks are broadcast, at most
OWN = 2048  # words with a feature of their own; others share one by their ending
CODES, GRAMS = 4096, 16384
FEATURES = 2 * CODES + GRAMS
INNER = 1 << 15  # features of the parts of a class
SELECT = 1  # one context of two words in so many has n-grams: all; tests read it
ROUNDS, STEP, RATE = 3, 4096, 0.15
SHARD = 4_000_000
FAN = 32
BUCKET = 6 << 20
PASSES = 2  # the buckets are moved in so many parts, one after the other, as all at once fill the disks
BLOCK = 1 << 16  # weights sent together
CHUNK = 2 << 20
END = np.uint64(0x51ED270B7A3C2F15)
SMOOTH = 0.1


def tokens(raw: np.ndarray, at: np.ndarray):
    """Distinct words (hash, ending) of a run of texts, each token's index in them, row bounds.

    The last distinct word is the end, which stands after every text.
    """
    words = Words(raw, at)
    back, u = pd.factorize(words.hashes())
    one = np.zeros(len(u), np.int64)
    one[back[::-1]] = np.arange(len(back))[::-1]  # of each word the first place
    s, e = words.start[one], words.end[one]
    ending = words.raw[e - 1].astype(np.uint64) + np.where(e - s > 1, words.raw[e - 2].astype(np.uint64) * np.uint64(256), np.uint64(0)) if len(u) else np.zeros(0, np.uint64)
    rows = len(at) - 1
    first = words.first + np.arange(rows + 1)
    seq = np.full(first[-1], len(u), np.int64)
    seq[np.arange(len(back)) + words.row] = back
    return np.append(u, END), np.append(mixed(ending), np.uint64(0)), seq, first


def suffix_class(ending: np.ndarray) -> np.ndarray:
    return (SINGLE + (ending >> np.uint64(8)) % np.uint64(SUFFIX)).astype(np.int64)


def part_of(u: np.ndarray) -> np.ndarray:
    """The part of its class that a word belongs to, by its hash."""
    return ((u >> np.uint64(8)) & np.uint64(SUB - 1)).astype(np.int64)


def leaf_of(kind: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Numbers the classes of one word and the parts of the others."""
    return np.where(kind < SINGLE, kind, SINGLE + (kind - SINGLE) * SUB + part_of(u))


class Frequent:
    """The frequent words by count: rank of each hash (the end is rank 0)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order
        self.counts = counts

    def ranks(self, u: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
        return np.where(self.hashes[at] == u, self.rank[at], -1)


def classes_and_codes(rank: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word, and its number as a feature."""
    known = (rank >= 0) & (rank < SINGLE)
    own = (rank >= 0) & (rank < OWN)
    code = np.where(own, rank, OWN + ((ending >> np.uint64(24)) % np.uint64(CODES - OWN - 1)).astype(np.int64))
    return np.where(known, rank, suffix_class(ending)), code


def context(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(3, tokens): feature rows of each token's context; CODES - 1 stands before a text."""
    n = len(code)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    one, two = np.full(n, CODES - 1), np.full(n, CODES - 1)
    one[1:], two[2:] = code[:-1], code[:-2]
    one[place < 1], two[place < 2] = CODES - 1, CODES - 1
    gram = mixed((one * CODES + two).astype(np.uint64)) % np.uint64(GRAMS)
    return np.stack([one, CODES + two, 2 * CODES + gram.astype(np.int64)])


def inner(rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """(2, tokens): feature rows of the class with the last word and with the n-gram."""
    return np.stack([(mixed((rows[k] * CLASSES + kind).astype(np.uint64)) % np.uint64(INNER)).astype(np.int64) for k in (0, 2)])


def behind_two(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens behind two others of their text, these contexts and the n-grams (64-bit hashes)."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(place >= 2)
    c = mixed(hashes[at - 2] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[at - 1])
    return at, c, mixed(c * np.uint64(0xD6E8FEB86659FD93) ^ hashes[at])


def class_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    z += bias
    if len(z) and max(z.max(), -z.min()) > 60:  # else no power leaves the range of 32-bit floats
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


class Softmax:
    """Weights that one task updates."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray):
        self.weights, self.squares = weights.copy(), squares.copy()
        self.met = np.zeros(len(weights), np.float32)
        self.rate = np.float32(RATE * np.sqrt(weights.shape[1]) / 2)

    def learn(self, rows: np.ndarray, target: np.ndarray, bias: np.ndarray) -> None:
        """bias: of each outcome, or a row of them for each token."""
        for lo in range(0, rows.shape[1], STEP):
            part, y = rows[:, lo : lo + STEP], target[lo : lo + STEP]
            g = class_probabilities(self.weights, bias if bias.ndim == 1 else bias[lo : lo + STEP], part)
            g.reshape(-1)[np.arange(len(y)) * g.shape[1] + y] -= 1
            pairs = g.view(np.complex64)  # two columns at once are added faster
            for kind in part:
                order = np.argsort(kind.astype(np.uint16), kind="stable")  # a radix sort: there are fewer features
                kind = kind[order]
                heads = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
                sums, use = np.add.reduceat(pairs.take(order, axis=0), heads).view(np.float32), kind[heads]
                self.met[use] += np.diff(np.append(heads, len(kind)))
                self.squares[use] += np.einsum("ij,ij->i", sums, sums)
                self.weights[use] = self.weights.take(use, axis=0) - sums * (self.rate / np.sqrt(self.squares[use]))[:, None]


def _texts(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce(F.crc32(doc.cast("string")) % 10 == 0, F.lit(False)).alias("held_out"), "text")


def packed(n: np.ndarray) -> bytes:
    """Counts, one byte each; those from 255 on follow in whole."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def unpacked(data: bytes, length: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, length).astype(np.int64)
    n[n == 255] = np.frombuffer(data, np.int64, offset=length)
    return n


def cut_down(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each 64-bit number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def widened(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the buckets, ranges of equal width, begins in sorted hashes, and their end."""
    high = (sorted_hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(high, np.arange(buckets + 1, dtype=np.uint64))


def in_order(x: np.ndarray) -> np.ndarray:
    """The places of 64-bit hashes in their order, equal ones as they stand."""
    low = np.uint64((1 << len(x).bit_length()) - 1)
    places = (np.sort(x & ~low | np.arange(len(x), dtype=np.uint64)) & low).astype(np.int64)  # sorting values is faster
    found = x[places]
    return places if (found[1:] >= found[:-1]).all() else np.argsort(x, kind="stable")


class Asked:
    """What a chunk of texts asks about: its distinct words, contexts and n-grams, in the order of their hashes.

    Of the contexts and n-grams those of the wanted buckets, which are in the same order whichever are wanted.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, buckets: int = 1, wanted: range = range(1)):
        self.u, self.ending, self.seq, self.first = tokens(raw, at)
        self.words = in_order(self.u)
        hashes = self.u[self.seq]
        self.active, c, g = behind_two(hashes, self.first)
        if len(wanted) < buckets:
            bucket = (c >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            some = np.flatnonzero((bucket >= np.uint64(wanted.start)) & (bucket < np.uint64(wanted.stop)))
            self.active, c, g = self.active[some], c[some], g[some]
        gram, distinct = pd.factorize(g)
        one = np.zeros(len(distinct), np.int64)
        one[gram[::-1]] = np.arange(len(gram))[::-1]
        order = in_order(c[one])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        one = one[order]
        c = c[one]
        self.gram = back[gram]  # of each token behind two others
        self.tags = hashes[self.active[one]]
        self.new = np.append(True, c[1:] != c[:-1])[: len(c)]  # where the n-grams of another context begin
        self.contexts = c[self.new]
        self.context_of = np.cumsum(self.new) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Number, doc_ids, held_out, text bytes and row bounds of each chunk."""
    at = {name: batch.schema.get_field_index(name) for name in ("chunk", "doc_id", "held_out", "text")}
    for k in range(batch.num_rows):
        texts = batch.column(at["text"])[k].values
        rows = pa.RecordBatch.from_arrays([texts], names=["text"])
        for _, raw, bounds in text_chunks(rows, size=1 << 62):
            yield batch.column(at["chunk"])[k].as_py(), batch.column(at["doc_id"])[k].values, batch.column(at["held_out"])[k].values, raw, bounds


def chunked(docs: DataFrame) -> DataFrame:
    """The texts in runs of about CHUNK bytes: chunk, and doc_id, held_out and text of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, _, _ in text_chunks(batch, size=CHUNK):
                bound = pa.array([0, part.num_rows], pa.int32())
                whole = [part.column(0), part.column(1), part.column(2).fill_null("")]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), *(pa.ListArray.from_arrays(bound, c) for c in whole)], names=["chunk", "doc_id", "held_out", "text"])
                k += 1

    return _texts(docs).mapInArrow(run, "chunk long, doc_id array<long>, held_out array<boolean>, text array<string>")


ANSWER, WORD, SEEN = 0, 1, 2  # rows of counts: answers to a block; words and their counts; n-grams that stand once and twice
COUNTED = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("n", "u", "grams")), ("hash", pa.list_(pa.int64())), ("class", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])


def blocks(chunks: DataFrame, buckets: int, wanted: range) -> DataFrame:
    """Each chunk's words (bucket -1 - b), contexts and n-grams (bucket b) in blocks, of the wanted buckets b.

    hashes: words or contexts; tags: of words their class, of n-grams their last word;
    new: bits that are set where an n-gram's context isn't that of the one before; n: how often
    each word or n-gram stands in the chunk's training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, held, raw, at in _texts_of(batch):
                ask = Asked(raw, at, buckets, wanted)
                learn = ~held.to_numpy(zero_copy_only=False)[ask.row]
                n = np.bincount(ask.seq[learn], minlength=len(ask.u))[ask.words]
                hashes, ending = ask.u[ask.words], suffix_class(ask.ending[ask.words]).astype(np.uint8)
                edges = bucket_edges(hashes, buckets)
                out = []
                for b in wanted:
                    part = slice(edges[b], edges[b + 1])
                    if edges[b + 1] > edges[b]:
                        out.append((chunk, -1 - b, hashes[part].tobytes(), ending[part].tobytes(), b"", packed(n[part])))
                n = np.bincount(ask.gram[learn[ask.active]], minlength=len(ask.tags))
                edges = bucket_edges(ask.contexts, buckets)
                begin = np.append(np.flatnonzero(ask.new), len(ask.tags))[edges]
                for b in wanted:
                    part = slice(begin[b], begin[b + 1])
                    if edges[b + 1] > edges[b]:
                        out.append((chunk, b, cut_down(ask.contexts[edges[b] : edges[b + 1]], 7), cut_down(ask.tags[part], 5), np.packbits(ask.new[part]).tobytes(), packed(n[part])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["chunk", "bucket", "hashes", "tags", "new", "n"])

    return chunks.mapInArrow(run, "chunk long, bucket int, hashes binary, tags binary, new binary, n binary")


def answered(block: pa.Table) -> pa.Table:
    """Counts one bucket, of words or of n-grams, and answers each of its blocks."""
    chunk, bucket = block.column("chunk"), block.column("bucket")
    read = lambda c: [x.as_py() for x in block.column(c)]
    none = lambda k: pa.array([None] * k, pa.binary())
    lists = lambda k: [pa.nulls(k, COUNTED.field(c).type) for c in ("hash", "class", "count")]
    rows = block.num_rows
    kind = pa.array(np.full(rows, ANSWER, np.int8))
    if bucket[0].as_py() < 0:
        hashes = [np.frombuffer(x, np.uint64) for x in read("hashes")]
        n = np.concatenate([unpacked(x, len(h)) for x, h in zip(read("n"), hashes, strict=True)])
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        back, u = pd.factorize(np.concatenate(hashes))
        whole = np.bincount(back, n, len(u)).astype(np.int64)
        ending = np.zeros(len(u), np.int32)
        ending[back] = np.frombuffer(b"".join(read("tags")), np.uint8)
        met = np.flatnonzero(whole)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(met)], pa.int32()), pa.array(x[met]))
        return pa.concat_tables([
            pa.Table.from_arrays([kind, chunk, bucket, pa.array([packed(x) for x in np.split(whole[back], ends)]), none(rows), none(rows), *lists(rows)], schema=COUNTED),
            pa.Table.from_arrays([pa.array([WORD], pa.int8()), pa.nulls(1, pa.int64()), bucket[:1], none(1), none(1), none(1), one(u.view(np.int64)), one(ending), one(whole)], schema=COUNTED),
        ])
    contexts, tags = [widened(x, 7) for x in read("hashes")], [widened(x, 5) for x in read("tags")]
    n = np.concatenate([unpacked(x, len(t)) for x, t in zip(read("n"), tags, strict=True)])
    new = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(t)) for x, t in zip(read("new"), tags, strict=True)])
    ends_c, ends_g = np.cumsum([len(c) for c in contexts])[:-1], np.cumsum([len(t) for t in tags])[:-1]
    context, uc = pd.factorize(np.concatenate(contexts))
    of = context[np.cumsum(new, dtype=np.int64) - 1]
    many = np.bincount(of, n, len(uc)).astype(np.int64)
    assert len(uc) < 1 << 24, "a bucket has too many contexts for its numbers"
    gram, ug = pd.factorize(of.astype(np.uint64) << np.uint64(40) | np.concatenate(tags))
    whole = np.bincount(gram, n, len(ug)).astype(np.int64)
    kinds = np.bincount((ug[whole > 0] >> np.uint64(40)).astype(np.int64), minlength=len(uc))
    split = lambda x, ends: pa.array([packed(p) for p in np.split(x, ends)], pa.binary())
    seen = pa.array([[int((whole == 1).sum()), int((whole == 2).sum())]], pa.list_(pa.int64()))
    return pa.concat_tables([
        pa.Table.from_arrays([kind, chunk, bucket, split(many[context], ends_c), split(kinds[context], ends_c), split(whole[gram], ends_g), *lists(rows)], schema=COUNTED),
        pa.Table.from_arrays([pa.array([SEEN], pa.int8()), pa.nulls(1, pa.int64()), bucket[:1], none(1), none(1), none(1), *lists(1)[:2], seen], schema=COUNTED),
    ])


class Counts:
    """The texts in chunks, the answers to what each asks, and the words."""

    def __init__(self, docs: DataFrame):
        self.chunks = stored(chunked(docs), "chunks", compression="zstd")
        size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(1, -(-size // BUCKET))
        kinds = "kind byte, chunk long, bucket int, n binary, u binary, grams binary, hash array<long>, class array<int>, count array<long>"
        self.tables = []
        for k in range(PASSES):
            wanted = range(k * self.buckets // PASSES, (k + 1) * self.buckets // PASSES)
            if wanted:
                blocks_of = blocks(self.chunks, self.buckets, wanted).groupBy("bucket")
                self.tables.append(stored(blocks_of.applyInArrow(answered, kinds), "counts", clean=True, compression="zstd"))
        self.table = reduce(DataFrame.union, self.tables)
        self.answers = self.table.filter(F.col("kind") == ANSWER).select("chunk", "bucket", "n", "u", "grams")
        found = F.explode(F.arrays_zip("hash", "class", F.col("count").alias("n"))).alias("word")
        self.words = self.table.filter(F.col("kind") == WORD).select(found).select("word.*")
        self.seen = self.table.filter(F.col("kind") == SEEN).select(F.col("count")[0].alias("once"), F.col("count")[1].alias("twice"))

    def drop(self) -> None:
        for table in (self.chunks, *self.tables):
            dropped(table)


class Model:
    """What scoring broadcasts: frequent words, sizes and weights, of fixed size."""

    def fit(self, docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
        end = int(END.view(np.int64))
        words = counts.words
        totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.n, self.v = totals["n"] or 0, totals["v"]
        texts = words.filter(F.col("hash") == end).agg(F.sum("n")).first()[0] or 0
        top = words.filter((F.col("hash") != end) & (F.col("n") >= self._least(words))).toArrow().sort_by([("n", "descending"), ("hash", "ascending")])
        hashes, n, kind = (top.column(c).to_numpy() for c in ("hash", "n", "class"))
        self.frequent = Frequent(np.append(END, hashes.view(np.uint64)), np.append(texts, n))
        self.size, self.kinds = np.zeros(LEAVES), np.zeros(LEAVES)
        part = F.shiftrightunsigned("hash", 8).bitwiseAND(SUB - 1).alias("part")
        for r in words.filter(F.col("hash") != end).groupBy("class", part).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            leaf = SINGLE + (r["class"] - SINGLE) * SUB + r["part"]
            self.size[leaf], self.kinds[leaf] = r["n"], r["v"]
        own = leaf_of(kind[: SINGLE - 1].astype(np.int64), hashes[: SINGLE - 1].view(np.uint64))
        np.subtract.at(self.size, own, n[: SINGLE - 1])
        np.subtract.at(self.kinds, own, 1)
        alone = self.frequent.counts[:SINGLE]
        self.size[: len(alone)] = alone
        parts = self.size[SINGLE:].reshape(SUFFIX, SUB)
        whole = np.append(self.size[:SINGLE], parts.sum(1))
        self.bias = np.log((whole + 1) / (whole.sum() + CLASSES)).astype(np.float32)
        self.part_bias = np.log((parts + 1) / (parts.sum(1, keepdims=True) + SUB)).astype(np.float32)
        seen = counts.seen.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
        self.discount = seen["once"] / (seen["once"] + 2 * seen["twice"]) if seen["once"] and seen["twice"] else 0.5
        self.weights = [np.zeros((FEATURES, CLASSES), np.float32), np.zeros((INNER, SUB), np.float32)]
        squares = [np.full(len(w), 1e-2, np.float32) for w in self.weights]
        for r in range(rounds):
            self._round(docs, squares, r, rounds)
        return self

    def _least(self, words: DataFrame) -> int:
        """A count that at most TOP words reach, from the numbers of words by their count's first binary digits."""
        scale = F.floor(F.log2("n") * 8).cast("int").alias("scale")  # 8 a binary order of magnitude
        steps = words.groupBy(scale).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("scale")).collect()
        within = np.cumsum([r["v"] for r in steps]) <= TOP
        return steps[int(within.sum()) - 1]["least"] if within.any() else 1 << 62

    def _round(self, docs: DataFrame, squares: list[np.ndarray], r: int, rounds: int) -> None:
        spark = docs.sparkSession
        held = spark.sparkContext.broadcast((self.frequent, self.weights, squares, self.bias, self.part_bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, weights, squares, bias, part_bias = held.value
            tables = [Softmax(w, s) for w, s in zip(weights, squares, strict=True)]
            for batch in batches:
                for _, raw, at in text_chunks(batch, size=CHUNK):
                    u, ending, seq, first = tokens(raw, at)
                    kind, code = classes_and_codes(frequent.ranks(u), ending)
                    rows, kind = context(code[seq], first), kind[seq]
                    tables[0].learn(rows, kind, bias)
                    deep = np.flatnonzero(kind >= SINGLE)
                    tables[1].learn(inner(rows[:, deep], kind[deep]), part_of(u[seq[deep]]), part_bias[kind[deep] - SINGLE])
            shard = TaskContext.get().partitionId()
            for t, table in enumerate(tables):
                size = BLOCK // table.weights.shape[1]
                for b in range(0, len(table.weights), size):
                    met = table.met[b : b + size]
                    if met.any():
                        yield pa.RecordBatch.from_arrays([
                            pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([shard], pa.int32()), pa.array([(table.weights[b : b + size] * met[:, None]).tobytes()]),
                            pa.array([(table.squares[b : b + size] * met).tobytes()]), pa.array([met.tobytes()])], names=["table", "block", "shard", "weights", "squares", "met"])

        def merged(rows: pa.Table) -> pa.Table:
            sums = [sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in rows.column(c)) for c in ("weights", "squares", "met")]
            return pa.table({"table": rows.column("table")[:1], "block": rows.column("block")[:1], "shard": rows.column("shard")[:1], **{c: pa.array([s.astype(np.float32).tobytes()]) for c, s in zip(("weights", "squares", "met"), sums, strict=True)}})

        kind = "table int, block int, shard int, weights binary, squares binary, met binary"
        mine = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)) == r
        shards = max(1, -(-self.n // (rounds * SHARD)))
        sums = _texts(docs).filter(~F.col("held_out") & mine).select("text").coalesce(shards).mapInArrow(run, kind)
        while True:  # FAN shards at once, so that a task holds a few MB however many there are
            sums = sums.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("table", "block", "shard").applyInArrow(merged, kind)
            shards = -(-shards // FAN)
            if shards == 1:
                break
        for x in sums.collect():
            met = np.frombuffer(x["met"], np.float32)
            use = np.flatnonzero(met)
            at, weights = x["block"] + use, self.weights[x["table"]]
            weights[at] = np.frombuffer(x["weights"], np.float32).reshape(-1, weights.shape[1])[use] / met[use, None]
            squares[x["table"]][at] = np.frombuffer(x["squares"], np.float32)[use] / met[use]
        held.destroy()

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))

    def within(self, c: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log10 of a token's share in its part of a class."""
        return np.where(leaf < SINGLE, 0.0, np.log10((c + SMOOTH) / (self.size[leaf] + SMOOTH * (self.kinds[leaf] + 1))))


def _once(row: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, the pair's number at each place, and how often each pair of row and key stands."""
    back, pairs = pd.factorize(row * max(keys, 1) + key)
    one = np.zeros(len(pairs), np.int64)
    one[back[::-1]] = np.arange(len(back))[::-1]
    return one, back, np.bincount(back, minlength=len(pairs))


def gram_gains(model: Model, got: dict, held_out: np.ndarray, log: np.ndarray) -> np.ndarray:
    """What n-grams add to log10 of the probability of the tokens behind two others.

    got: row, context and n-gram of each, and the answers: n and u of the contexts, grams of the n-grams;
    log: of the model without n-grams.
    """
    row, ctx, gram = got["doc"], got["context"], got["gram"]
    if not len(row):
        return np.zeros(0)
    own = ~held_out[row]
    one_c, back_c, own_c = _once(row, ctx, len(got["n"]))
    one_g, back_g, own_g = _once(row, gram, len(got["grams"]))
    n_c, n_g = (got["n"][ctx] - np.where(own, own_c[back_c], 0)).astype(float), (got["grams"][gram] - np.where(own, own_g[back_g], 0)).astype(float)
    lonely = own[one_g] & (n_g[one_g] <= 0)  # words that only this text has behind the context
    kinds = got["u"][ctx] - np.bincount(back_c[one_g], lonely, len(one_c))[back_c]
    use = n_c > 0
    many = np.where(use, n_c, 1)
    p0 = 10.0**log
    p = np.maximum(n_g - model.discount, 0) / many + (model.discount * kinds / many) * p0
    return np.where(use, np.log10(np.where(use, p, 1)) - log, 0.0)


def score_rows(model: Model, raw: np.ndarray, at: np.ndarray, held_out: np.ndarray, buckets: int, answers: dict) -> dict:
    """Per row of a chunk: tokens, known ones, base and model score; answers: the fields of each block, by bucket."""
    ask = Asked(raw, at)
    u, seq, first, row = ask.u, ask.seq, ask.first, ask.row
    rank = model.frequent.ranks(u)
    kind, code = classes_and_codes(rank, ask.ending)
    leaf = leaf_of(kind, u)

    def joined(field: str, edges: np.ndarray, of) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(unpacked(answers[of(b)][field], edges[b + 1] - edges[b]) for b in np.flatnonzero(np.diff(edges)))])

    c = np.empty(len(u), np.int64)
    c[ask.words] = joined("n", bucket_edges(u[ask.words], buckets), lambda b: -1 - b)
    rows, target, part = context(code[seq], first), kind[seq], part_of(u)[seq]
    chosen = np.empty(len(seq))
    for lo in range(0, len(seq), STEP):
        some = slice(lo, lo + STEP)
        p = class_probabilities(model.weights[0], model.bias, rows[:, some])
        chosen[some] = p[np.arange(len(p)), target[some]]
        deep = lo + np.flatnonzero(target[some] >= SINGLE)
        p = class_probabilities(model.weights[1], model.part_bias[target[deep] - SINGLE], inner(rows[:, deep], target[deep])) if len(deep) else np.zeros((0, SUB))
        chosen[deep] *= p[np.arange(len(p)), part[deep]]
    logs = np.log10(chosen) + model.within(c, leaf)[seq]
    edges = bucket_edges(ask.contexts, buckets)
    begin = np.append(np.flatnonzero(ask.new), len(ask.tags))[edges]
    got = {"n": joined("n", edges, int), "u": joined("u", edges, int), "grams": joined("grams", begin, int)}
    ctx = ask.context_of[ask.gram]
    some = np.flatnonzero(held_out[row[ask.active]] | (got["n"][ctx] > 1))  # the others' context stands in no other text
    active = ask.active[some]
    gains = gram_gains(model, got | {"doc": row[active], "context": ctx[some], "gram": ask.gram[some]}, held_out, logs[active])
    per_row = lambda x: np.add.reduceat(x, first[:-1])
    return {
        "n_tokens": np.diff(first), "n_known": per_row((c > 0)[seq].astype(np.int64)), "train_tokens": np.full(len(first) - 1, model.n, np.int64),
        "base_score": per_row(model.base(c)[seq]), "score": per_row(logs) + np.bincount(row[active], gains, len(first) - 1),
    }


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    counts = Counts(docs)
    out = stored(scored(docs, counts, Model().fit(docs, counts, rounds)), "scores")
    counts.drop()
    return out


def scored(docs: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """The scores of every row by a fitted model."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(model), counts.buckets

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = {b: {c: right.column(c)[k].as_py() for c in ("n", "u", "grams")} for k, b in enumerate(right.column("bucket").to_pylist())}
        out = []
        for batch in left.to_batches():
            for _, doc_id, held, raw, at in _texts_of(batch):
                got = score_rows(shared.value, raw, at, held.to_numpy(zero_copy_only=False), buckets, answers)
                out.append(pa.table({"doc_id": doc_id, "held_out": held, **got}))
        return pa.concat_tables(out) if out else RESULT.empty_table()

    return counts.chunks.groupBy("chunk").cogroup(counts.answers.groupBy("chunk")).applyInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
