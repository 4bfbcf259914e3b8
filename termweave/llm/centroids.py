"""Centroid clustering of integer vectors with block-norm screening.

Components become integers floor(64 x).  A vector is cut into segments, and the
norms of its segments, computed once, are its compressed form.  By Cauchy and
Schwarz the squared distance to a centroid is at least the sum over segments of
the squared differences of the norms.  A vector first meets the centroid of the
smallest such bound, and then exactly those whose bound doesn't exceed the best
distance found so far.  All distances are exact integers.

Every round is one pass over a written table of vectors in numpy batches.  A task
keeps one row of sums a centroid, and the sums of all tasks meet by centroid and
component.  What the driver holds are the centroids alone: ``k`` vectors.

Defined results: a vector that is null, has another number of components than asked
for, or holds a null or non-finite component takes no part; repeated rows count each;
rows without vec_id are clustered like others, but start a centroid only where too
few have one; of equal hashes the smaller vector comes first; if there are fewer
vectors than centroids, each starts one; ties of distance go to the smaller number; an
empty centroid stays where it is; sums and distances are exact for all finite
components, and those beyond a long are returned as the largest long; other columns
don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.shared import bounded, dropped, stored

SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEGMENT = 64, 64, 16, 3, 8
ROWS = 4096  # that meet the centroids at once
MARGIN = 1e-12  # of the norms, for the rounding of a bound
LIMB = 10**18  # sums leave a task as high * LIMB + low
LONGEST = 2**63 - 1


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list array whose rows have one length, as doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def segment_norms(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The Euclidean norm of each run of ``segment`` components; a shorter run may end."""
    return np.sqrt(np.add.reduceat(vectors.astype(np.float64) ** 2, np.arange(0, vectors.shape[1], segment), axis=1))


def integers(vectors: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers where squared distances fit in them, as Python's integers else."""
    small = 2.0 ** ((61 - math.ceil(math.log2(max(vectors.shape[1], 1)))) / 2 - 1)
    if np.abs(vectors).max(initial=0) < small:
        return vectors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


def squared_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return (gap * gap).sum(axis=1)


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid's number and squared distance of each row, and how many distances were computed.

    ``vectors`` and ``centroids`` are integers of one kind, ``norms`` the rows' segment norms.
    """
    theirs = segment_norms(centroids, segment)
    bound = sum((norms[:, s, None] - theirs[None, :, s]) ** 2 for s in range(norms.shape[1]))
    bound -= MARGIN * ((norms**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1)[None])
    first = bound.argmin(axis=1)
    number, best, done = first.copy(), np.zeros(len(vectors), vectors.dtype), len(vectors)
    for c in np.unique(first):
        rows = np.flatnonzero(first == c)
        best[rows] = squared_distances(vectors[rows], centroids[c])
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if len(rows):
            found = squared_distances(vectors[rows], centroids[c])
            better = (found < best[rows]) | ((found == best[rows]) & (c < number[rows]))
            number[rows[better]], best[rows[better]] = c, found[better]
            done += len(rows)
    return number, best, done


def compressed(vectors: DataFrame, dimensions: int = DIMENSIONS, segment: int = SEGMENT) -> DataFrame:
    """vec_id, whole (the integers, in doubles, which hold them exactly) and norms of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.floor(matrix(batch.column(1)) * SCALE)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (whole, segment_norms(whole, segment))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["vec_id", "whole", "norms"])

    part = vectors.filter((F.size(e) == dimensions) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    return part.mapInArrow(run, "vec_id long, whole array<double>, norms array<double>")


def first_centroids(table: DataFrame, k: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes."""
    rank = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [[int(x) for x in r["whole"]] for r in table.select(rank.alias("rank"), "whole").orderBy(F.asc_nulls_last("rank"), "whole").limit(k).collect()]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], segment: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with their integers, numbers and distances."""
    wide = integers(np.array(centroids, np.float64)).dtype == object
    exact = np.array(centroids, object) if wide else np.array(centroids, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            vectors = integers(matrix(rows.column(1)))
            if wide or vectors.dtype == object:
                vectors = vectors.astype(object)
            number, distance, _ = nearest(vectors, matrix(rows.column(2)), exact.astype(vectors.dtype), segment)
            yield rows, vectors, number, distance


def moved(table: DataFrame, centroids: list[list[int]], segment: int = SEGMENT) -> list[list[int]]:
    """The centroids after one round."""
    k, dimensions = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for _, vectors, number, _ in _assigned(batches, centroids, segment):
            for c in np.unique(number):
                rows = vectors[number == c]
                n[c] += len(rows)
                sums[c] += rows.sum(axis=0).astype(object)
        cells = [(c, d, int(n[c]), *divmod(int(sums[c, d]), LIMB)) for c in range(k) if n[c] for d in range(dimensions)]
        if cells:
            of = lambda i, kind: pa.array([x[i] for x in cells], kind)
            big = lambda i: pa.array([Decimal(x[i]) for x in cells], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([of(0, pa.int32()), of(1, pa.int32()), of(2, pa.int64()), big(3), big(4)], names=["c", "d", "n", "high", "low"])

    sums = table.mapInArrow(run, "c int, d int, n long, high decimal(38,0), low decimal(38,0)").groupBy("c", "d").agg(*[F.sum(x).alias(x) for x in ("n", "high", "low")])
    out = [list(c) for c in centroids]
    for r in sums.collect():  # k x dimensions rows
        out[r["c"]][r["d"]] = (int(r["high"]) * LIMB + int(r["low"])) // r["n"]
    return out


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, segment: int = SEGMENT) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = bounded(vectors.sparkSession)
    table = stored(compressed(vectors, dimensions, segment), "vectors")
    centroids = first_centroids(table, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(table, centroids, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, number, distance in _assigned(batches, centroids, segment) if centroids else ():
            far = distance if distance.dtype != object else [min(x, LONGEST) for x in distance]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(number.astype(np.int32)), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = stored(table.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    dropped(table)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    about = [(c, min(s, LONGEST), min(sum(sums.values()), LONGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    return found.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ASSIGN = """a{n} as (select i, vec_id, e, k.k as k, k.d as d from (select i, any_value(vec_id) as vec_id, any_value(e) as e, min({{'d': list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c), 'k': k}}) as k
  from v, c{n} group by i))"""
_MOVE = """m{n} as (select k, p, floor(sum(x) / count(*)) as x from (select k, unnest(e) as x, generate_subscripts(e, 1) as p from a{n}) group by k, p),
c{next} as (select c{n}.k as k, coalesce(m.c, c{n}.c) as c from c{n} left join (select k, list(x order by p) as c from m{n} group by k) m on m.k = c{n}.k)"""

OP13_SQL = (
    """with v as (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by h nulls last, e) - 1 as k, e as c from (select sha256('1:' || vec_id) as h, e from v order by h nulls last, e limit 16)),
"""
    + ",\n".join([part.format(n=n, next=n + 1) for n in range(ROUNDS) for part in (_ASSIGN, _MOVE)] + [_ASSIGN.format(n=ROUNDS)])
    + f"""
select vec_id, a.k::int as cluster, d::bigint as distance, (sum(d) over (partition by a.k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.c, lambda x: x::bigint), ',')) as centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c on c.k = a.k"""
)
