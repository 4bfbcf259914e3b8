"""Finding benchmark items in documents by latent semantic retrieval.

Items and documents are cut into overlapping passages of words (lower case, without
ASCII punctuation around them), weighted by
TF-IDF over the words that items have (document frequencies come from all
documents).  A randomised subspace iteration, run over the executors, finds the
right singular vectors of the item passages; document passages that lie
close enough to an item passage in that latent space are candidates: by their
cosine, or by the share of the item passage's weight that they hold.  Document
passages are longer than item passages by their stride, so each item passage
stands whole in one of them; a short item loses nothing by the text around it,
and words that no item has need no weight, so results don't depend on them or
on how many documents there are.
The rank follows the passages: only directions that hold less than ``LOSS`` of
any passage's squared norm are left out, and both sides of the cosine are
normalised in the latent space, so a verbatim copy of a passage has a cosine of 1.
A candidate counts if the longest common subsequence of the item's words and
the text around the passage covers enough of the item, and enough of the item's
answer (its last sentence) stands there too, so reworded copies are found.

A common subsequence long enough needs a number of the item's rarer words
(``KEYS`` of its words) near each other; passages without as many of any item
are left out before projection, which changes no result.

Document frequencies of all the benchmark's words come from one pass over the
documents.  The benchmark is read in blocks of ``BLOCK`` items, or fewer if they are
long, and these are searched in groups of ``PASSAGES`` passages, one after the
other: a group's space is broadcast, its hits are written, and it is let go, so
what the driver and the executors hold is bounded whatever the benchmark's size.

Defined results: a null or empty text or item matches nothing; every row is
judged, repeated rows alike; the query gives one row for each pair of doc_id and
item_id, with the best evidence (of equal ones the first place); an item that
stands twice, or two texts of one item_id, count as one item; other columns don't
matter, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions.sequences import common_subsequence
from termweave.llm.shared import Words, bit_marks, bounded, dropped, fresh, marked, mixed, span_sums, stored, text_chunks

WINDOW, STRIDE = 32, 16
SPAN = WINDOW + STRIDE  # words of a document passage: any WINDOW of them stand whole in one
EXTRA, ROUNDS = 16, 4
LOSS = 1e-4  # share of a passage's squared norm that the latent space may lack
COSINE, LCS, ANSWER = 0.4, 0.6, 0.5
KEYS = 0.5  # share of an item's words, the rarest, that are looked up first
BLOCK, BLOCK_BYTES = 4_000, 16 << 20  # benchmark items, and their bytes, that the driver reads at once
FLUSH = 1 << 20  # words whose frequencies a task holds
PASSAGES = 512  # item passages in one latent space, which bounds its rank
BATCH = 512  # document passages projected at once
SLICES = 8  # partial sums of the subspace iteration
CHUNK = 1 << 20

_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words without ASCII punctuation around them, their row bounds, and
    whether a sentence ends at each."""
    words = Words(raw, at)
    start, end = words.start.copy(), words.end.copy()
    last = words.raw[end - 1] if len(end) else np.zeros(0, np.uint8)
    stop = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    for side in (0, 1):
        live = np.arange(len(start))
        while len(live):
            live = live[start[live] < end[live]]
            live = live[_MARK[words.raw[start[live] if side == 0 else end[live] - 1]]]
            if side == 0:
                start[live] += 1
            else:
                end[live] -= 1
    some = np.flatnonzero(end > start)
    h = mixed(span_sums(words.raw, start[some], end[some]) + (end - start)[some].astype(np.uint64))
    return h, np.searchsorted(some, words.first), stop[some]


def windows(n: int) -> list[int]:
    """Starts of the passages of n words; the last one ends at the end."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


class Items:
    """The items of a block or group: vocabulary, words, answers, and later the latent space.

    ``parts``, if given, are the bounds of the passages taken of each item.
    """

    def __init__(self, ids: list[int], texts: list[str], parts: list[tuple[int, int]] | None = None):
        data = [t.encode() for t in texts]
        h, first, stop = plain_words(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
        self.vocab, code = np.unique(h, return_inverse=True)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.vocab >> np.uint64(44)).astype(np.int64)] = True
        self.ids, self.texts, self.words, self.answers, self.owner, self.passages = [], [], [], [], [], []
        for k, i in enumerate(ids):
            w = code[first[k] : first[k + 1]]
            if not len(w):
                continue
            ends = np.flatnonzero(stop[first[k] : first[k + 1]][:-1])
            answer = w[ends[-1] + 1 :] if len(ends) else w
            for s in windows(len(w)) if parts is None else windows(len(w))[slice(*parts[k])]:
                self.owner.append(len(self.ids))
                self.passages.append(w[s : s + WINDOW])
            self.ids.append(i)
            self.texts.append(texts[k])
            self.words.append(w.tolist())
            self.answers.append(set((answer if len(answer) >= 3 else w).tolist()))
        self.owner = np.array(self.owner, np.int64)
        self.reach = np.array([len(w) if len(w) > WINDOW else len(w) // 2 + STRIDE for w in self.words], np.int64)  # words looked at beside a passage
        self.sets, self.bags = [set(w) for w in self.words], [Counter(w) for w in self.words]

    def groups(self, most: int = PASSAGES) -> Iterator[Items]:
        """The same passages in groups of at most so many; a long item may be in several."""
        for lo in range(0, len(self.owner), most):
            owner = self.owner[lo : lo + most]
            own, first, n = np.unique(owner, return_index=True, return_counts=True)
            start = lo + first - np.searchsorted(self.owner, own)  # of the first passage taken, in its item
            yield Items([self.ids[k] for k in own], [self.texts[k] for k in own], [(int(a), int(a + m)) for a, m in zip(start, n, strict=True)])

    def codes(self, h: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 outside it."""
        out = np.full(len(h), -1, np.int32)
        if len(self.vocab):
            maybe = np.flatnonzero(self.gate[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocab, h[maybe]), len(self.vocab) - 1)
            hit = self.vocab[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        keys, holders, self.need = [], [], np.zeros(len(self.words), np.int64)
        for k, w in enumerate(self.words):
            u, tf = np.unique(w, return_counts=True)
            order = np.argsort(-self.idf[u], kind="stable")
            held = np.cumsum(tf[order])
            last = int(np.searchsorted(held, np.ceil(KEYS * len(w) - 1e-9)))
            keys.append(u[order[: last + 1]])
            holders.append(np.full(last + 1, k))
            # words that a long enough subsequence has must be keys where the others run out
            self.need[k] = np.ceil(LCS * len(w) - 1e-9) - (len(w) - held[last])
        keys, holders = np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(holders) if holders else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.holders = holders[order]
        self.held = np.searchsorted(keys[order], np.arange(len(self.vocab) + 1))

    def promising(self, code: np.ndarray, first: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The passages (by their starts) near which enough keys of an item stand."""
        at = np.flatnonzero(code >= 0)
        n = self.held[code[at] + 1] - self.held[code[at]]
        token = np.repeat(at, n)
        item = self.holders[np.repeat(self.held[code[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item * (len(code) + 1) + token)
        token, item = token[order], item[order]
        head = np.arange(len(token))
        tail = head + self.need[item] - 1
        ok = tail < len(token)
        head, tail = head[ok], tail[ok]
        row = np.searchsorted(first, token, "right") - 1
        ok = (item[head] == item[tail]) & (row[head] == row[tail]) & (token[tail] - token[head] < SPAN + 2 * self.reach[item[head]])
        head, tail = head[ok], tail[ok]
        reach = self.reach[item[head]]
        lo = np.searchsorted(start, np.maximum(token[tail] - reach - SPAN, first[row[head]]))
        hi = np.searchsorted(start, np.minimum(token[head] + reach, first[row[head] + 1] - 1), "right")
        ok = hi > lo
        marks = np.bincount(lo[ok], minlength=len(start) + 1) - np.bincount(hi[ok], minlength=len(start) + 1)
        return np.flatnonzero(np.cumsum(marks)[: len(start)] > 0)

    def rows(self, part: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """TF-IDF of passages, unit length: passage number, vocabulary number, weight."""
        part = range(len(self.passages)) if part is None else part
        row, col, val = [], [], []
        for r, p in enumerate(part):
            c, tf = np.unique(self.passages[p], return_counts=True)
            w = np.sqrt(tf) * self.idf[c]
            row.append(np.full(len(c), r))
            col.append(c)
            val.append(w / np.sqrt((w * w).sum()))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0)
        return cat(row).astype(np.int64), cat(col).astype(np.int64), cat(val).astype(np.float32)

    def project(self, basis: np.ndarray) -> None:
        self.basis = basis.astype(np.float32)
        row, col, val = self.rows()
        z = np.zeros((len(self.passages), basis.shape[1]), np.float32)
        np.add.at(z, row, self.basis[col] * val[:, None])
        self.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        counts = [np.unique(p, return_counts=True) for p in self.passages]
        self.size = np.sqrt([(tf * self.idf[c] ** 2).sum() for c, tf in counts]).astype(np.float32)  # before unit length


def latent_basis(spark: SparkSession, items: Items, rank: int | None = None, seed: int = 3) -> np.ndarray:
    """Right singular vectors of the item passages, by subspace iteration; without a
    rank all that the passages need up to ``LOSS``.

    Each executor holds some passages A_i and returns A_i'(A_i Q); the driver
    adds the SLICES sums and makes them orthonormal.
    """
    n = len(items.vocab)
    most = len(items.passages) if rank is None else rank
    width = min(n, most + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0].astype(np.float32)
    shared = spark.sparkContext.broadcast(items)
    slices = spark.range(0, SLICES, 1, SLICES)

    def image(q: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    part = list(range(k, len(shared.value.passages), SLICES))
                    if part:
                        row, col, val = shared.value.rows(part)
                        z = np.zeros((len(part), held.value.shape[1]), np.float32)
                        np.add.at(z, row, held.value[col] * val[:, None])
                        use, back = np.unique(col, return_inverse=True)
                        y = np.zeros((len(use), z.shape[1]), np.float32)
                        np.add.at(y, back, z[row] * val[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array([use.astype(np.int64).tobytes()]), pa.array([y.tobytes()])], names=["use", "sums"])

        total = np.zeros((n, q.shape[1]), np.float32)
        for r in slices.mapInArrow(run, "use binary, sums binary").toLocalIterator():
            use = np.frombuffer(r["use"], np.int64)
            total[use] += np.frombuffer(r["sums"], np.float32).reshape(len(use), -1)
        held.destroy()
        return total

    for _ in range(ROUNDS):
        q = np.linalg.qr(image(q))[0].astype(np.float32)
    small = (q.T @ image(q)).astype(np.float64)
    shared.destroy()
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:most]
    if rank is None:  # a unit passage's part in a direction is at most the singular value
        order = order[: max(1, int((np.cumsum(np.maximum(values[order], 0)[::-1])[::-1] > LOSS).sum()))]
    return q @ turn[:, order].astype(np.float32)


def word_frequencies(docs: DataFrame, words: DataFrame) -> DataFrame:
    """hash, df: how many documents have each of the words (hash); those that none has are left out,
    a few others may come with them."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_marks(words, F.col("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            u, back = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return u, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        row = lambda h, n: pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "df"])
        for batch in batches:
            for _, raw, at in text_chunks(batch, size=CHUNK):
                h, first, _ = plain_words(raw, at)
                some = np.flatnonzero(marked(shared.value, h.view(np.int64)))
                u, back = np.unique(h[some], return_inverse=True)
                if not len(u):
                    continue
                pair = np.unique((np.searchsorted(first, some, "right") - 1) * len(u) + back)
                held.append((u, np.bincount(pair % len(u))))
                size += len(u)
                if size > 4 * FLUSH:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield row(*held[0])
                        held, size = [], 0
        if held:
            yield row(*summed())

    return docs.select(F.lower("text").alias("text")).mapInArrow(run, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df"))


def matches(items: Items, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
    """(row, item, cosine, share of the item in the common subsequence, of its answer, word) of each hit."""
    h, first, _ = plain_words(raw, at)
    if not len(h) or not len(items.ids):
        return []
    code = items.codes(h)
    inside = code >= 0
    own = np.concatenate([[0], np.cumsum(inside)])
    n = np.diff(first)
    # passages start at every STRIDE-th word; the last of a row ends with it
    count = np.where(n > SPAN, -(-(n - SPAN) // STRIDE) + 1, (n > 0).astype(int))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + np.minimum(k * STRIDE, np.maximum(n[row] - SPAN, 0))
    end = np.minimum(start + SPAN, first[row + 1])
    many = items.promising(code, first, start)
    many = many[own[end[many]] > own[start[many]]]
    found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for lo in range(0, len(many), BATCH):
        w = many[lo : lo + BATCH]
        length = end[w] - start[w]
        token = np.repeat(start[w] - np.cumsum(length) + length, length) + np.arange(length.sum())
        owner = np.repeat(np.arange(len(w)), length)
        ok = inside[token]
        token, owner = token[ok], owner[ok]
        pair, tf = np.unique(owner * len(items.vocab) + code[token], return_counts=True)
        owner, c = pair // len(items.vocab), pair % len(items.vocab)
        x = (np.sqrt(tf) * items.idf[c]).astype(np.float32)
        heads = np.searchsorted(owner, np.arange(len(w)))
        z = np.add.reduceat(items.basis[c] * x[:, None], heads, axis=0)
        size = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        near = z @ items.latent.T
        for i, p in zip(*(a.tolist() for a in np.nonzero(near >= COSINE * np.minimum(size, items.size))), strict=True):
            j, item = int(w[i]), int(items.owner[p])
            words = items.words[item]
            reach = int(items.reach[item])
            lo_word, hi_word = max(int(first[row[j]]), int(start[j]) - reach), min(int(first[row[j] + 1]), int(end[j]) + reach)
            own_words = items.sets[item]
            region = [c for c in code[lo_word:hi_word].tolist() if c in own_words]
            bag = items.bags[item]
            # no common subsequence has more of a word than either side
            if sum(min(n, bag[c]) for c, n in Counter(region).items()) / len(words) < LCS:
                continue
            share = common_subsequence(words, region) / len(words)
            if share < LCS:
                continue
            answer = items.answers[item]
            told = len(answer & set(region)) / len(answer)
            if told < ANSWER:
                continue
            new = (float(near[i, p] / size[i, 0]), share, told, lo_word - int(first[row[j]]))
            key = (int(row[j]), item)
            if key not in found or (share, new[0]) > (found[key][1], found[key][0]):
                found[key] = new
    return [(r, items.ids[i], *v) for (r, i), v in found.items()]


def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash) of the words of items (block, text)."""
    for batch in batches:
        for part, raw, at in text_chunks(batch, size=CHUNK):
            h, first, _ = plain_words(raw, at)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first)))), pa.array(h.view(np.int64))], names=["block", "hash"])


def prepared(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, passages: int = PASSAGES) -> Iterator[Items]:
    """The benchmark's groups, ready to be matched, one at a time."""
    spark = bounded(docs.sparkSession)
    usable = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).distinct()
    size = usable.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["n"]:
        return
    blocks = max(-(-size["n"] // block), -(-size["bytes"] // BLOCK_BYTES), 1)
    usable = stored(usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")), "items")
    words = stored(usable.select("block", "text").mapInArrow(item_words, "block int, hash long").distinct(), "words")
    counts = stored(words.join(word_frequencies(docs, words), "hash"), "counts")
    dropped(words)
    n = docs.count()
    for b in range(blocks):
        rows = usable.filter(F.col("block") == b).orderBy("item_id", "text").collect()
        whole = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        got = counts.filter(F.col("block") == b).select("hash", "df").toArrow()
        df = np.zeros(len(whole.vocab), np.int64)
        df[np.searchsorted(whole.vocab, got.column("hash").to_numpy().view(np.uint64))] = got.column("df").to_numpy()
        for items in whole.groups(passages):
            items.weigh(df[np.searchsorted(whole.vocab, items.vocab)], n)
            items.project(latent_basis(spark, items))
            yield items
    dropped(usable)
    dropped(counts)


HIT = "doc_id long, content long, item_id long, cosine double, lcs double, answer double, word long"


def hits(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """The evidence of each group, written: HIT; content is a hash of the row's text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.lower("text").alias("text"))
    out = spark.createDataFrame([], HIT)
    for items in prepared(docs, benchmark, **bounds):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, at in text_chunks(batch, size=CHUNK):
                    found = matches(shared.value, raw, at)
                    if found:
                        cols = list(zip(*found, strict=True))
                        take = pa.array(cols[0], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())], names=["doc_id", "content", "item_id", "cosine", "lcs", "answer", "word"])

        out = out.union(stored(rows.mapInArrow(run, HIT), "hits"))
        shared.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, word (where the matched text begins) of each hit."""
    best = F.max(F.struct("lcs", "cosine", "answer", (-F.col("word")).alias("back"))).alias("best")
    return hits(docs, benchmark, **bounds).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.cosine", "best.lcs", "best.answer", (-F.col("best.back")).alias("word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **bounds: int) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item."""
    doc, content = fresh(docs, "_doc"), fresh(docs, "_content")
    dirty = hits(docs, benchmark, **bounds).select(F.col("doc_id").alias(doc), F.col("content").alias(content)).distinct()
    marked_rows = docs.withColumns({doc: F.col("doc_id").cast("long"), content: F.xxhash64("text")}).alias("l")
    same = F.col(f"l.{content}").eqNullSafe(F.col(f"r.{content}")) & F.col(f"l.{doc}").eqNullSafe(F.col(f"r.{doc}"))
    return marked_rows.join(dirty.alias("r"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
