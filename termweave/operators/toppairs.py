"""The pairs of documents that share most, without joining all pairs that share something.

What a document can share with any other is bounded by its keywords' largest weights
elsewhere.  Documents come in bands of falling bound.  The first bands, a few thousand
documents, are joined alone and give a k-th best score; from then on only documents whose
bound reaches it, and of these only the prefixes that reach it, meet in the next, larger
head of the bands, until the head holds all that are left.  Equal documents are one
class, so copies are joined once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.operators import setjoin
from termweave.sources.scratch import stored

HEAD, GROWTH, STEPS = 2048, 8, 4  # documents of the first head, its growth, bands a doubling of the bound


def _kth(scores: list[tuple[int, int]], k: int, least: int) -> int:
    """The k-th best of (score, how many pairs have it), or least if there are fewer."""
    seen = 0
    for score, n in sorted(scores, reverse=True):
        seen += n
        if seen >= k:
            return max(least, score)
    return least


def _best_classes(found: DataFrame, k: int) -> DataFrame:
    """The k best links by score and smallest ids."""
    return found.orderBy(F.desc("score"), "class1", "class2").limit(k)


def top_pairs(edges: DataFrame, least: int = 2, k: int = 10, weighted: bool = True, head: int = HEAD) -> DataFrame:
    """(d1, d2, score) of the k best pairs, d1 < d2, by falling score, then ids.

    The score is the number of common keywords or, ``weighted``, of pairs of parallel edges to them; pairs
    below ``least`` don't count.
    """
    s = setjoin.classes(edges, weighted)
    # copies of one document: a class's first pair, and how many there are
    second = s.members.filter("pub_id > class_id").groupBy("class_id").agg(F.min("pub_id").alias("second"))
    copies = s.about.filter((F.col("class_size") > 1) & (F.col("square") >= least)).join(second, "class_id")
    own = copies.select(F.col("square").alias("score"), F.col("class_id").alias("class1"), F.col("second").alias("class2"), F.lit(True).alias("copies"))
    first = copies.orderBy(F.desc("square")).limit(k).collect()  # k rows
    mine = [(r["square"], r["class_size"] * (r["class_size"] - 1) // 2) for r in first]
    floor = _kth(mine, k, least)

    bound = F.aggregate(F.arrays_zip("weights", "tops"), F.lit(0).cast("long"), lambda a, x: a + x["weights"] * x["tops"]) if weighted else F.size("tokens").cast("long")
    sets = s.sets.withColumn("bound", bound).withColumn("band", F.floor(F.log2(F.greatest("bound", F.lit(1))) * STEPS))
    # a row a band, of which there are at most STEPS a bit of a long
    bands = sorted(((r["band"], r["n"]) for r in sets.groupBy("band").agg(F.count("*").alias("n")).collect()), reverse=True)
    while True:
        left = [(b, n) for b, n in bands if b >= math.floor(math.log2(max(floor, 1)) * STEPS)]
        taken, lowest = 0, None
        for b, n in left:
            if lowest is not None and taken + n > head:
                break
            taken, lowest = taken + n, b
        last = not left or lowest == left[-1][0]
        chosen = sets.filter(F.col("bound") >= floor) if last else sets.filter((F.col("band") >= lowest) & (F.col("bound") >= floor))
        links = setjoin.linked_classes(chosen.drop("bound", "band"), setjoin.Shared(floor, weighted))
        found = stored(links.select(F.col("shared").alias("score"), "class1", "class2", F.lit(False).alias("copies")), "links")
        if last:
            break
        sizes = lambda n: s.about.select(F.col("class_id").alias(f"class{n}"), F.col("class_size").alias(f"size{n}"))
        best = _best_classes(found, k).join(sizes(1), "class1").join(sizes(2), "class2").collect()  # k rows
        floor = _kth(mine + [(r["score"], r["size1"] * r["size2"]) for r in best], k, least)
        head *= GROWTH
    best = stored(_best_classes(found.unionByName(own), k).withColumn("link", F.monotonically_increasing_id()), "best")
    # of a class no more than its k + 1 smallest documents can be in the k best pairs
    asked = best.select(F.col("class1").alias("class_id")).union(best.filter("not copies").select("class2")).distinct()
    some = s.members.join(F.broadcast(asked), "class_id").withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("pub_id"))).filter(F.col("place") <= k + 1)
    side = lambda c, d: some.select(F.col("class_id").alias(c), F.col("pub_id").alias(d))
    target = best.withColumn("other", F.when(F.col("copies"), F.col("class1")).otherwise(F.col("class2")))
    pairs = target.join(side("class1", "x"), "class1").join(side("other", "y"), "other").filter("(copies and x < y) or (not copies and x <> y)")
    return pairs.select(F.least("x", "y").alias("d1"), F.greatest("x", "y").alias("d2"), "score").orderBy(F.desc("score"), "d1", "d2").limit(k)
