"""Lemmas and parts of speech of words no lexicon has, by rules learned from one.

A lexicon row says what to cut from a word's end and what to put there instead.  It is
counted under every ending of the word, from what is cut up to ``LONGEST`` letters, and of each
ending the commonest rule stays.  A word is judged by its longest ending that has a
rule.  Both steps are joins and aggregations over distinct words and endings.

Defined results: words and lemmas are compared as they are written; rows of the lexicon
with a null token or lemma teach nothing; of several rows of one word all teach, and the smallest (lemma, pos) is
its entry; of equally common rules the one that cuts least wins, then the smaller replacement,
then the smaller part of speech, none last; at least ``stem`` letters of a word stay; a
word without a rule is its own lemma, of no part of speech.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.sources.scratch import stored

LONGEST, STEM, LEAST = 5, 2, 2  # letters of an ending, letters that stay, rows that make a rule
FEW = 50_000  # rules of endings of one length that are broadcast at most


def _ending(word: Column, n: Column) -> Column:
    return F.when(n > 0, F.substring(word, F.length(word) - n + 1, n)).otherwise("")


def rules(lexicon: DataFrame, longest: int = LONGEST, stem: int = STEM, least: int = LEAST) -> DataFrame:
    """(ending, cut, put, pos, n): the commonest rule of each ending that ``least`` rows have; cut letters go, put comes."""
    rows = lexicon.filter("token is not null and lemma is not null").select("token", "lemma", "pos").distinct()
    both = F.least(F.length("token"), F.length("lemma"))
    alike = F.filter(F.sequence(F.lit(0), both), lambda n: F.substring(F.col("token"), F.lit(1), n) == F.substring(F.col("lemma"), F.lit(1), n))
    known = rows.withColumn("same", F.array_max(alike)).filter(F.col("same") >= stem)
    ways = known.select("token", "pos", (F.length("token") - F.col("same")).alias("cut"), F.expr("substring(lemma, same + 1)").alias("put"))
    most = F.least(F.length("token") - stem, F.lit(longest))
    ends = ways.filter(F.col("cut") <= most).withColumn("n", F.explode(F.sequence(F.col("cut"), most))).withColumn("ending", _ending(F.col("token"), F.col("n")))
    counted = ends.groupBy("ending", "cut", "put", "pos").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = counted.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("few"), "cut", "put", F.col("pos").isNull().alias("none"), "pos")).alias("best"))
    return best.select("ending", "best.cut", "best.put", "best.pos", (-F.col("best.few")).alias("n"))


def _ruled(rows: DataFrame, learned: DataFrame, longest: int, stem: int) -> tuple[DataFrame, Column]:
    """The rows, each with a token, and the rule of its longest ending that has one.

    Each length of endings is a join that keeps every row where it is, unless it has too many rules to be
    broadcast; so tokens are neither multiplied nor gathered again.
    """
    most = F.greatest(F.least(F.length("token") - stem, F.lit(longest)), F.lit(0))
    sizes = {r["n"]: r["rules"] for r in learned.groupBy(F.length("ending").alias("n")).agg(F.count("*").alias("rules")).collect()}  # a row a length
    lengths = [n for n in range(longest, -1, -1) if n in sizes]
    for n in lengths:
        some = learned.filter(F.length("ending") == n).select(F.col("ending").alias(f"_end{n}"), F.struct("cut", "put", "pos").alias(f"_rule{n}"))
        on = F.when(most >= n, _ending(F.col("token"), F.lit(n))) == F.col(f"_end{n}")
        rows = rows.join(F.broadcast(some) if sizes[n] <= FEW else some, on, "left").drop(f"_end{n}")
    return rows, F.coalesce(*[F.col(f"_rule{n}") for n in lengths]) if lengths else F.lit(None).cast("struct<cut: int, put: string, pos: string>")


def _by_rule(rule: Column) -> tuple[Column, Column]:
    """Lemma and part of speech of the token by its rule."""
    lemma = F.concat(F.substring(F.col("token"), F.lit(1), F.length("token") - rule["cut"]), rule["put"])
    return F.coalesce(lemma, "token"), rule["pos"]


def guessed(words: DataFrame, learned: DataFrame, longest: int = LONGEST, stem: int = STEM) -> DataFrame:
    """(token, lemma, pos) of the distinct tokens by their longest ending that has a rule."""
    rows, rule = _ruled(words.filter("token is not null").select("token").distinct(), learned, longest, stem)
    lemma, pos = _by_rule(rule)
    return rows.select("token", lemma.alias("lemma"), pos.alias("pos"))


def completed(words: DataFrame, lexicon: DataFrame, longest: int = LONGEST, stem: int = STEM, least: int = LEAST) -> DataFrame:
    """(token, lemma, pos) of the distinct tokens: the lexicon's entry, or else what its rules say."""
    entries = lexicon.filter("token is not null and lemma is not null").groupBy("token").agg(F.min(F.struct("lemma", F.col("pos").isNull().alias("none"), "pos")).alias("own"))
    distinct = words.filter("token is not null").select("token").distinct()
    rows, rule = _ruled(distinct.join(entries, "token", "left"), stored(rules(lexicon, longest, stem, least), "rules"), longest, stem)
    lemma, pos = _by_rule(rule)
    return rows.select("token", F.coalesce("own.lemma", lemma).alias("lemma"), F.when(F.col("own").isNotNull(), F.col("own.pos")).otherwise(pos).alias("pos"))
