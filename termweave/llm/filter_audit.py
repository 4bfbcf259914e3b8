"""How much each of several filters removes, in every order of applying them.

Every document gets one failure flag a filter.  The documents are summed by
flags and part first, so that SQL's CUBE over the flags and the part runs over at
most 32 rows a part.  A grouping-set row that keeps the flags of a subset of the
filters, all of them false, counts the documents that survive that subset, in
whatever order it is applied.  A step of an order goes from one subset to the next
larger one, so each step is a join with a pair of subset rows.

Copies are found by the digest of the text.  What meets in one key is summed
before: a text that a third of all documents share is a few rows a task.

Defined results: a null text is an empty one, of no words, that fails A alone of A to
D, and E if a smaller doc_id is empty too; a null lang is the part ``''``; repeated
rows count each, and rows of one doc_id are no copies of each other; a row without
doc_id is no copy of anything, nothing is a copy of it, and it has no labels; of
several labels of a doc_id one that says 1 is enough; texts are read whole; other
columns don't matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.shared import stored

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, SIGNS = 100, 80, 10, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Filter letter -> whether a text fails it, for the filters that look at one text alone."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_SHARE * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > UPPER_SHARE * F.length(text),
        "D": text.rlike(SIGNS),
    }


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a flag a filter (A to E), and the counts n, good and toxic: documents summed by part and flags."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = text_failures(text)
    judged = documents.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), *[c.alias(f) for f, c in own.items()])
    said = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    kinds = ["digest", "part", *own]
    one = judged.join(said, "doc_id", "left").groupBy("doc_id", *kinds).agg(F.count("*").alias("n"), *[F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("good", "toxic")])
    # by digest, part and labels: how many rows, and how many of them have the smallest doc_id or none
    alike = one.groupBy(*kinds, "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")
    )
    first = alike.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    fine = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.explode(F.array(F.struct(F.lit(False).alias("E"), fine.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - fine).alias("n"))))
    parts = first.select("part", *own, "good", "toxic", both.alias("copy")).select("part", *own, "copy.E", "copy.n", "good", "toxic").filter("n > 0")
    return parts.groupBy("part", *own, "E").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def survivors(counted: DataFrame, letters: str) -> DataFrame:
    """part, subset (its letters in order), n, good, toxic: the documents that fail no filter of the subset.

    Subsets that nothing survives have no row.
    """
    cube = counted.cube(*letters, "part").agg(F.grouping("part").alias("all_parts"), *[F.grouping(f).alias("any_" + f) for f in letters], *[F.sum(c).alias(c) for c in COUNTS])
    fine = reduce(and_, [(F.col("any_" + f) == 1) | ~F.col(f) for f in letters])
    subset = F.concat(*[F.when(F.col("any_" + f) == 0, F.lit(f)).otherwise("") for f in letters])
    return cube.filter("all_parts = 0").filter(fine).select("part", subset.alias("subset"), *COUNTS)


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters.

    kept and removed: after this step and by it; redundant: fails the step's filter and
    was removed before; unique_fails: fails that filter alone; good_lost, toxic_lost: of
    the removed; shapley: what the filter removes, summed over all orders.
    """
    subsets = stored(survivors(counted, letters), "subsets")  # at most 32 rows a part, read once for each side of the joins
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    sorted_letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    head = lambda n: F.substring(F.col("filter_order"), F.lit(1), n)
    step = F.col("step")
    steps = (
        subsets.filter("subset = ''").select("part").withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("filter", F.substring(F.col("filter_order"), step, F.lit(1)))
        .withColumn("before", F.when(step == 1, "").otherwise(sorted_letters(head(step - 1)))).withColumn("after", sorted_letters(head(step)))
        .withColumn("others", F.replace(F.lit(letters), F.col("filter"), F.lit(""))).withColumn("none", F.lit("")).withColumn("all", F.lit(letters))
    )
    for role in ("before", "after", "filter", "others", "none", "all"):
        side = subsets.select("part", F.col("subset").alias(role), *[F.col(c).alias(f"{role}_{c}") for c in COUNTS])
        steps = steps.join(side, ["part", role], "left")
    n = lambda role, c="n": F.coalesce(F.col(f"{role}_{c}"), F.lit(0)).cast("long")
    counts = steps.select(
        "part", "filter_order", "step", "filter", n("after").alias("kept"), (n("before") - n("after")).alias("removed"),
        (n("none") - n("filter") - n("before") + n("after")).alias("redundant"), (n("others") - n("all")).alias("unique_fails"),
        (n("before", "good") - n("after", "good")).alias("good_lost"), (n("before", "toxic") - n("after", "toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(flagged(documents, labels), "ABCDE")


OP12_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  min(doc_id) over (partition by text) as first from d),
f as (select part, len(words) < 100 as A, 100 * len(list_distinct(words)) < 80 * len(words) as B,
  100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) as C,
  regexp_matches(text, '[#$%&*|]') as D, coalesce(doc_id > first, false) as E,
  coalesce((select max(quality = 1) from labels l where l.doc_id = w.doc_id), false) as good,
  coalesce((select max(toxic = 1) from labels l where l.doc_id = w.doc_id), false) as toxic from w),
fails as (select part, concat(case when A then 'A' else '' end, case when B then 'B' else '' end, case when C then 'C' else '' end,
  case when D then 'D' else '' end, case when E then 'E' else '' end) as failed, count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic from f group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, s, substr(o, s, 1) as x from orders, (select unnest([1, 2, 3, 4, 5]) as s)),
hit as (select part, failed, n, good, toxic, o, s, x, contains(failed, x) as fails,
  regexp_matches(failed, '[' || o[1:s] || ']') as gone, s > 1 and regexp_matches(failed, '[' || o[1:greatest(s - 1, 1)] || ']') as gone_before from fails, steps),
r as (select part, o as filter_order, s::int as step, x,
  sum(case when not gone then n else 0 end)::bigint as kept, sum(case when fails and not gone_before then n else 0 end)::bigint as removed,
  sum(case when fails and gone_before then n else 0 end)::bigint as redundant, sum(case when failed = x then n else 0 end)::bigint as unique_fails,
  sum(case when fails and not gone_before then good else 0 end)::bigint as good_lost,
  sum(case when fails and not gone_before then toxic else 0 end)::bigint as toxic_lost from hit group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley from r
"""
