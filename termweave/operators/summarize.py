"""Extractive summaries by keyword weight and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.functions.sequences import small_batches


def sentence_scores(sentence_words: Column, keywords: Column) -> Column:
    """Raw score of each sentence: for each keyword its weight (10, 9, ...) times the share
    of its words that the sentence has, over the root of the sentence's length."""

    def score(words: Column, split: Column) -> Column:
        hits = lambda k: F.size(F.filter(k, lambda w: F.array_contains(words, w)))
        parts = F.transform(split, lambda k, i: F.when(F.size(k) > 0, (10 - F.least(i, F.lit(9))) * hits(k) / F.size(k)).otherwise(F.lit(0.0)))
        total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(words) > 0, total / F.sqrt(F.greatest(F.size(words), F.lit(1)).cast("double"))).otherwise(F.lit(0.0))

    split = F.transform(F.slice(keywords, 1, 10), lambda k: F.array_distinct(T.blank_separated(k)))
    return T.bound(split, lambda s: F.transform(sentence_words, lambda w: score(w, s)))


def normalised(scores: Column) -> Column:
    """The scores as shares of the highest; 0 if that is 0."""
    return T.bound(scores, lambda s: T.bound(F.array_max(s), lambda top: F.transform(s, lambda x: T.share(x, top))))


def chosen_sentences(words: list[set[str]], scores: list[float], count: int = 4, balance: float = 0.6) -> list[int]:
    """Places of the sentences that maximal marginal relevance picks, in order of choice.

    Of c candidates min(count, ceil(c / 2)) are picked; ties go to the earliest.
    """
    top = max(scores, default=0.0)
    base = [x / top if top > 0 else 0.0 for x in scores]
    near, left, picked = [0.0] * len(base), list(range(len(base))), []
    for _ in range(min(count, -(-len(base) // 2))):
        best = max(left, key=lambda i: (round(balance * base[i] - (1 - balance) * near[i], 12), -i))
        picked.append(best)
        left.remove(best)
        for i in left:
            either = len(words[i] | words[best])
            near[i] = max(near[i], len(words[i] & words[best]) / either if words[i] and words[best] else 0.0)
    return picked


def summaries(docs: DataFrame, count: int = 4, balance: float = 0.6) -> DataFrame:
    """(doc_id, summary) from (doc_id, text, keywords): the picked sentences in document order.

    Sentences and scores are built-in expressions; the greedy choice, which needs
    the choices before it, runs over Arrow batches.
    """
    small_batches(docs.sparkSession)
    step = docs.select("doc_id", "keywords", T.numbered_sentences(T.sentences(F.col("text"))).alias("s"))
    step = step.withColumn("w", F.transform("s", lambda x: T.words(x["text"])))
    inputs = step.select("doc_id", F.transform("s", lambda x: x["text"]).alias("text"), "w", sentence_scores(F.col("w"), F.col("keywords")).alias("score"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, words, score in zip(part["text"], part["w"], part["score"], strict=True):
                picked = chosen_sentences([set(w) for w in words], list(score), count, balance)
                out.append(" ".join(text[i] for i in sorted(picked)))
            yield pd.DataFrame({"doc_id": part["doc_id"], "summary": out})

    return inputs.mapInPandas(run, "doc_id long, summary string")
