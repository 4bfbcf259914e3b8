"""Near-duplicate classes by DartMinHash signatures, banding and verification.

A text is the weighted set of its five-word shingles (A-Z lower-cased, cut at white
space; a shorter text is one shingle), each as heavy as it stands often.  Every
shingle is a region of weight by rank into which darts are thrown by a hash, at
Poisson arrivals; a text keeps, for each coordinate, the earliest dart that falls
below its weight.  Texts that agree on all coordinates of some band become
candidates, and each candidate pair that is linked has been verified: weighted
Jaccard similarity (sum of the smaller weights over that of the larger) >= 0.8.
Without repeated shingles, or with ``weighted=False``, that is the Jaccard
similarity of the sets.

Equal texts are one node.  In each band bucket the node that meets most others is
compared with all members, and components are found by contraction: work in the
number of texts.  Where a bucket still holds several components, the nodes outside
its largest one are compared with all its nodes of other components in blocks of a
fixed size, so every pair of different components that shares a bucket has been
compared; that part grows with the product of the two, spread over tasks, and no
pair becomes a row unless it is a link.

Defined results: one row per input row, with repeated rows in one class; the
class id is the smallest doc_id of the class (null ids don't count); a null,
empty or blank text is alike to nothing and stays alone, with its own doc_id
as class; other columns don't matter, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.shared import Words, bit_marks, dropped, fresh, marked, mixed, shingles, stored, text_chunks

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK = 1024  # nodes of a bucket that meet as many others in one task
LAST = 2**63 - 1  # stands for a null doc_id
CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def dart_signatures(items: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A (rows, k) array: the earliest dart of each coordinate of each weighted set.

    Row i has items[first[i]:first[i+1]] with positive weights.  A dart is the
    same number for all sets that it hits.  Sets without items get zeros.
    """
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    best = np.full(rows * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    total = np.bincount(row, weights, rows)
    depth = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = np.ones(rows, bool)
    while True:
        use = np.flatnonzero(todo[row])
        if not len(use):
            break
        _throw(items[use], weights[use], row[use], depth, best, k)
        missing = (best.reshape(rows, k) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        todo = missing & (total > 0)
        depth = np.where(todo, depth * 2, depth)
    out = best.reshape(rows, k)
    out[total <= 0] = 0
    return out


def _throw(items, weights, row, depth, best, k):
    """Lets darts fall in each region of weight (0,1], (1,2], (2,4], ... down to its row's depth."""
    low, width, cell = 0.0, 1.0, 0
    while True:
        inside = np.flatnonzero(weights > low) if low else np.arange(len(items))
        if not len(inside):
            return
        seed, w, r = mixed(items[inside] + np.uint64(cell * int(_STEP) & (2**64 - 1))), weights[inside], row[inside]
        rank, done = np.zeros(len(seed)), 0
        while len(seed):
            m = 1 if len(seed) * 2 > 100_000 or done < 2 else 32
            u = mixed(seed[:, None] + np.arange(done + 1, done + m + 1, dtype=np.uint64) * _STEP)
            gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            at = rank[:, None] + (np.cumsum(gap, 1) if m > 1 else gap)
            fell = at <= depth[r][:, None]
            i, j = np.nonzero(fell)
            dart = mixed(u[i, j] ^ np.uint64(0xA0761D6478BD642F))
            height = low + width * ((dart >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            hit = height < w[i]
            i, j, dart = i[hit], j[hit], dart[hit]
            place = r[i] * k + (dart % np.uint64(k)).astype(np.int64)
            early = at[i, j].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(best, place, (early << np.uint64(32)) | (dart >> np.uint64(32)))
            on = np.flatnonzero(fell[:, -1])
            seed, w, r, rank = seed[on], w[on], r[on], at[on, -1]
            done += m
        low, width, cell = low + width, low + width, cell + 1


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """Sorted distinct shingles of each row, their counts and row bounds."""
    words = Words(raw, at)
    h = words.hashes()
    s, row = shingles(words, width, h)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(s)))
    return s[heads], counts, np.searchsorted(row[heads], np.arange(len(at))), words, h


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """Per row: doc_id, content (64-bit hash of the text), node (digest of its words), bands.

    ``weighted`` counts a repeated shingle as often as it stands; otherwise
    each has weight 1.  node and bands are null where there are no words.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                s, counts, first, words, h = shingle_sets(raw, at)
                sig = dart_signatures(s, counts.astype(float) if weighted else np.ones(len(s)), first, bands * rows)
                key = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    key = mixed(key * _STEP + sig.reshape(-1, bands, rows)[:, :, r])
                key = mixed(key + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)
                some = np.diff(words.first) > 0
                digest = [xxhash.xxh3_128_digest(h[a:b]) if b > a else None for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(key[some].ravel()))
                lists = pa.ListArray.from_buffers(lists.type, len(lists), [pa.array(some).buffers()[1], lists.buffers()[1]], children=[lists.values])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(run, "doc_id long, content long, node binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """node and its sorted shingle hashes (32 bits each) for the wanted (node, doc_id, content).

    A shingle that stands n times is n different items, so that the Jaccard similarity
    of the items is the weighted one of the shingles.  A bitmap over the wanted
    contents keeps most other texts from being read by Python and shuffled; the join
    decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_marks(wanted, F.col("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(marked(shared.value, batch.column(1).to_numpy()))
            for part, raw, at in text_chunks(batch.take(pa.array(some)), size=CHUNK):
                s, counts, first, _, _ = shingle_sets(raw, at)
                if weighted:
                    ends = np.cumsum(counts)
                    again = np.arange(len(counts) and ends[-1]) - np.repeat(ends - counts, counts)
                    s = np.repeat(s, counts)
                    s[again > 0] = mixed(s[again > 0] + again[again > 0].astype(np.uint64) * _STEP)
                    first = np.concatenate([[0], ends])[first]
                small = (s >> np.uint64(32)).astype(np.uint32)
                out = [np.unique(small[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc", "content", "set"])

    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")
    found = docs.select(doc, F.xxhash64("text").alias("content"), "text").mapInArrow(run, "doc long, content long, set binary")
    return found.join(wanted.select("node", doc, "content"), ["doc", "content"]).select("node", "set").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) those whose sets have that Jaccard similarity at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if len(x) > len(y):
                    x, y = y, x
                if len(x) < least * len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for all nodes of edges (a, b).

    Contraction: every node joins its smallest neighbour, chains are halved,
    edges are renamed, until none is left.  Nothing is collected.
    """
    edges = stored(edges.select("a", "b").filter("a <> b"), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("low")), "low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        down = stored(low.join(jump, "low").select("node", F.col("lower").alias("down")), "down")
        new = labels.join(down.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("down", "label").alias("label"))
        renamed = (
            edges.join(down.select(F.col("node").alias("a"), F.col("down").alias("x")), "a")
            .join(down.select(F.col("node").alias("b"), F.col("down").alias("y")), "b")
            .filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        )
        new, renamed = stored(new, "labels"), stored(renamed, "edges")
        for old in (edges, labels, low, down):
            dropped(old)
        edges, labels = renamed, new
    dropped(edges)
    return labels


def _block_links(waiting: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different components of each bucket of (key, node, label).

    All nodes outside a bucket's largest component meet all nodes of the bucket
    in other components, in blocks of BLOCK by BLOCK nodes: a block's items are
    indexed, and a node's common items with all nodes of the block are counted
    at once, so no pair becomes a row unless it is a link.
    """
    sizes = waiting.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select("key", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("few"))
    largest = stored(largest, "largest")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = waiting.join(largest, "key").join(sets, "node").withColumn("spread", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    asking = rows.filter("label <> main").select("key", F.pmod("spread", blocks("few")).alias("p"), every("all").alias("q"), "node", "label", "set")
    own = [F.col(c).alias(c + "2") for c in ("key", "node", "label", "set")]
    asked = rows.select(*own, every("few").alias("p2"), F.pmod("spread", blocks("all")).alias("q2"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_buffer(), np.uint32) for x in right.column("set2").combine_chunks()] if right.num_rows else []
        items = np.concatenate(held) if held else np.zeros(0, np.uint32)
        size = np.array([len(x) for x in held], np.int64)
        order = np.argsort(items, kind="stable")
        owner, items = np.repeat(np.arange(len(held)), size)[order], items[order]
        labels, nodes = np.array(right.column("label2").to_pylist(), object), right.column("node2").to_pylist()
        a, b = [], []
        for node, label, x in zip(left.column("node").to_pylist(), left.column("label").to_pylist(), left.column("set"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint32)
            lo, hi = np.searchsorted(items, x, "left"), np.searchsorted(items, x, "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(held))
            for k in np.flatnonzero((both >= least * (len(x) + size - both) - 1e-9) & (labels != label)).tolist():
                a.append(min(node, nodes[k]))
                b.append(max(node, nodes[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return asking.groupBy("key", "p", "q").cogroup(asked.groupBy("key2", "p2", "q2")).applyInArrow(meet, "a binary, b binary").distinct()


def _torn(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component.

    The buckets are written first: a join of its own can be split where one is large.
    """
    torn = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return rows.join(stored(torn, "torn"), "key")


def links_of(docs: DataFrame, signed: DataFrame, least: float = SIMILARITY, weighted: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """(labels of the linked nodes, tables of verified links); see the module's text."""
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("one"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = stored(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")  # written, so that the join can be split where a bucket is large
    met = stored(banded.join(shared, "key"), "met")
    dropped(shared)
    popular = met.groupBy("node").agg(F.sum("n").alias("popular"))
    members = stored(met.join(popular, "node").select("key", "node", "popular"), "members")
    dropped(met)
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "one.doc_id", "one.content")
    sets = stored(_sets(docs, wanted, weighted), "sets")
    leaders = stored(members.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("top")).select("key", F.col("top.node").alias("leader")), "leaders")
    pairs = members.join(leaders, "key").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    links = stored(_verified(pairs, sets, least), "links")
    labels = components(links)
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    placed = stored(placed.join(leaders.withColumnRenamed("leader", "node"), ["key", "node"], "left_anti"), "placed")
    waiting = stored(_torn(placed), "waiting")
    more = stored(_block_links(waiting, sets, least), "links")
    if not more.isEmpty():
        dropped(labels)
        labels = components(links.union(more))
    for old in (members, leaders, placed, waiting, sets, nodes):
        dropped(old)
    return labels, [links, more]


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """doc_id, content, class_id, class_size, keep of every row; keep marks one (doc_id, content) of each class."""
    signed = stored(signatures(docs, bands, rows, weighted), "signed")
    labels, links = links_of(docs, signed, least, weighted)
    placed = stored(signed.join(labels, "node", "left").select("doc_id", "content", F.coalesce("label", "node").alias("class")), "placed")
    for old in (signed, labels, *links):
        dropped(old)
    own = F.coalesce(F.col("doc_id"), F.lit(LAST))  # a row without doc_id stands for a class only if no other can
    # written, so that the join below is one of its own, whose large classes Spark can split
    classes = stored(placed.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(own.alias("id"), "content")).alias("one")), "classes")
    out = placed.filter("class is not null").join(classes, "class").select(
        "doc_id", "content", "class_id", "class_size", ((own == F.col("one.id")) & (F.col("content") == F.col("one.content"))).alias("keep"))
    return out.union(placed.filter("class is null").select("doc_id", "content", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their class.

    A row without words stays; of rows with equal doc_id and text one stays.
    """
    doc, content = fresh(docs, "_doc"), fresh(docs, "_content")
    id_of = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    keep = near_duplicates(docs).filter("keep").select(id_of.alias(doc), F.col("content").alias(content)).distinct()
    named = docs.withColumns({doc: id_of, content: F.xxhash64("text")})
    return named.join(keep, [doc, content]).dropDuplicates([doc, content]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size, keep."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("content")
