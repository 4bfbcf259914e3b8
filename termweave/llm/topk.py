"""Exact top-k inner products by term-at-a-time accumulation.

Components become integers floor(64 x).  Candidates are packed into blocks with
a posting list for every component (which vectors have it, and its weight);
each query of a block adds, component by component, its weighted postings to a
dense array of scores.  The best k of each block are selected by partition, and
a window merges the blocks.  Blocks are numbered; each block of candidates is
dealt to ``PARTS`` slots, each block of queries to one slot of every candidate
block, and the slots are tasks of even size, as many as the table needs.  A task
holds one block of candidates and one of queries at a time.

Defined results: a vector that is null or holds a null or non-finite component,
or has a null vec_id, takes no part; a shorter vector has zeros at its end;
rows with the query's vec_id are its own and no candidates; repeated candidate
rows count each; every query row is answered, so a vec_id queried by several rows has
the ranks 1 to k once for each of them; scores beyond a long are clipped; other columns don't matter,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.shared import bounded, stored

SCALE, K, EVERY = 64, 20, 20
BLOCK, QUERY_BLOCK, PARTS = 8192, 256, 4
TILE = 4096  # candidates whose scores are accumulated at once


def integers(vectors: pa.Array) -> np.ndarray:
    """floor(64 x) of each row, zeros behind shorter ones; Python ints where a long is too small."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(vectors.offsets.to_numpy().astype(np.int64)) if vectors.null_count == 0 else None
    if length is None:
        raise ValueError("null vectors are filtered before")
    out = np.zeros((len(length), int(length.max(initial=0))))
    row = np.repeat(np.arange(len(length)), length)
    first = np.concatenate([[0], np.cumsum(length)])[:-1]
    out[row, np.arange(len(values)) - first[row]] = np.floor(values * SCALE)
    if np.abs(out).max(initial=0) < 2.0**62:
        return out.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else int(np.sign(v)) << 1100 for v in r] for r in out], object)


def best_of_block(query_ids, queries, ids, vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query; ids ascend."""
    dims = min(queries.shape[1], vectors.shape[1])
    high = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(dims, 1)
    kind = np.int32 if high < 2**31 else np.int64 if high < 2**62 else object
    # a term's weights, of queries and of candidates, lie side by side
    queries, postings = (np.ascontiguousarray(x[:, :dims].T.astype(kind)) for x in (queries, vectors))
    scores = np.zeros((queries.shape[1], len(vectors)), kind)
    for lo in range(0, len(vectors), TILE):
        tile = scores[:, lo : lo + TILE]
        for term in range(dims):
            weights = postings[term, lo : lo + TILE]
            posting = np.flatnonzero(weights)
            asking = np.flatnonzero(queries[term])
            if not len(posting) or not len(asking):
                continue
            if 2 * len(posting) >= len(weights):  # few zeros: adding them is cheaper than leaving them out
                for q in asking.tolist():
                    tile[q] += queries[term, q] * weights
            else:
                weights = weights[posting]
                for q in asking.tolist():
                    tile[q, posting] += queries[term, q] * weights
    rows, places = [], []
    for q in range(len(scores)):
        s = scores[q].copy()
        others = np.flatnonzero(ids != query_ids[q])
        s = s[others]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k] if kind is not object else sorted(s.tolist())[-k]
            above = np.flatnonzero(s > least)
            others = others[np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])]
        rows.append(np.full(len(others), q))
        places.append(others)
    row, place = np.concatenate(rows), np.concatenate(places)
    found = scores[row, place]
    if kind is object:
        found = np.array([max(-(2**63), min(2**63 - 1, v)) for v in found], np.int64)
    return row, place, found.astype(np.int64)


def packed(vectors: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """Blocks of at most so many (ids, vectors), ids ascending, as lists, numbered from 0; how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.sort_by("vec_id").combine_chunks()
            bound = pa.array([0, rows.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(bound, rows.column(c).chunk(0)) for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), *lists], names=["task", "k", "ids", "vectors"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                held, n, k = rows.slice(size).to_batches(), n - size, k + 1
        if n:
            yield block(pa.Table.from_batches(held))

    blocks = stored(vectors.select("vec_id", "embedding").mapInArrow(run, "task int, k int, ids array<long>, vectors array<array<double>>"), "blocks")
    # a row a task of the scan: the number of its first block
    counts = sorted((r["task"], r["n"]) for r in blocks.groupBy("task").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([n for _, n in counts], dtype=np.int64).tolist()
    firsts = blocks.sparkSession.createDataFrame([(t, end - n) for (t, n), end in zip(counts, ends, strict=True)], "task int, first long")
    return blocks.join(F.broadcast(firsts), "task").select((F.col("first") + F.col("k")).alias("block"), "ids", "vectors"), ends[-1] if ends else 0


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best candidates; both have vec_id and embedding."""
    bounded(candidates.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))

    blocks, n = packed(valid(candidates), block)
    asking, _ = packed(valid(queries), query_block)
    mine = blocks.select(F.explode(F.sequence(F.col("block") * PARTS, F.col("block") * PARTS + PARTS - 1)).alias("slot"), F.lit(0).alias("asks"), F.col("block"), "ids", "vectors")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")))
    theirs = asking.select(every.alias("to"), F.col("block"), "ids", "vectors").select((F.col("to") * PARTS + F.col("block") % PARTS).alias("slot"), F.lit(1).alias("asks"), "block", "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, vectors = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(3)[i].values.to_numpy()
                rows = integers(_dense(batch.column(4)[i].values))
                if not batch.column(1)[i].as_py():
                    slot, ids, vectors = batch.column(0)[i].as_py(), own, rows
                elif batch.column(0)[i].as_py() == slot:  # where there are no candidates, none are found
                    row, place, score = best_of_block(own, rows, ids, vectors, k)
                    number = batch.column(2)[i].as_py() * query_block + row
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(own[row]), pa.array(ids[place]), pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])

    dealt = mine.union(theirs).repartitionByRange(max(n, 1) * PARTS, "slot").sortWithinPartitions("slot", "asks")
    partial = dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dense(a: pa.Array) -> pa.Array:
    """The same list array with offsets from 0."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(a.offsets.to_numpy()))]).astype(np.int32)), a.flatten())


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


OP5_SQL = """
with v as (
  select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.row_no as row_no, q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select query_id, vec_id, score, row_number() over (partition by row_no order by score desc, vec_id) as rank from scored)
where rank <= 20
"""
