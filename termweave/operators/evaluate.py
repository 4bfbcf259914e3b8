"""Keyword and summary scores against references, and their macro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.functions.sequences import with_common_subsequence


def keyword_metrics(pairs: DataFrame, cuts: tuple[int, ...] = (5, 10), matches: tuple[str, ...] = ("exact", "soft")) -> DataFrame:
    """(doc_id, method, match, k, precision, recall, f1) from (doc_id, method, found, wanted) of normalised phrases."""
    by = {"exact": T.exact_metrics, "soft": T.soft_metrics}
    cases = [(m, k, by[m](F.col("found"), F.col("wanted"), k)) for k in cuts for m in matches]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("match"), F.lit(k).alias("k"), x.alias("m")) for m, k, x in cases])).alias("x")
    return pairs.select("doc_id", "method", each).select("doc_id", "method", "x.match", "x.k", "x.m.precision", "x.m.recall", "x.m.f1")


def keyword_averages(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("method", "match", "k").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(pair_id, precision, recall, f1) from (pair_id, cand, ref) token arrays, by n-gram counts."""
    side = lambda c: pairs.select("pair_id", F.explode(T.ngrams(F.col(c), n)).alias("gram")).groupBy("pair_id", "gram").agg(F.count("*").alias(c))
    both = side("cand").join(side("ref"), ["pair_id", "gram"]).groupBy("pair_id").agg(F.sum(F.least("cand", "ref")).alias("hits"))
    size = lambda c: F.greatest(F.size(c) - n + 1, F.lit(0)).cast("double")
    joined = pairs.select("pair_id", size("cand").alias("c"), size("ref").alias("r")).join(both, "pair_id", "left")
    return _prf(joined, F.coalesce("hits", F.lit(0)).cast("double"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """The same by the longest common subsequence, in Arrow batches: each step needs the row before."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    found = with_common_subsequence(pairs.select("pair_id", some("cand"), some("ref")), "cand", "ref", "hits")
    return _prf(found.withColumnsRenamed({"cand": "c", "ref": "r"}), F.col("hits"))


def _prf(df: DataFrame, hits: Column) -> DataFrame:
    p, r = T.share(hits, F.col("c")), T.share(hits, F.col("r"))
    return df.select("pair_id", p.alias("precision"), r.alias("recall")).withColumn("f1", T.f1(F.col("precision"), F.col("recall")))


def rouge_averages(scores: DataFrame, *by: str) -> DataFrame:
    """Macro averages; 0 where there is nothing to average."""
    return scores.groupBy(*by).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def summary_scores(pairs: DataFrame, lemma_of: DataFrame | None = None) -> DataFrame:
    """(pair_id, mode, metric, precision, recall, f1) of (pair_id, cand, ref) texts.

    Modes: raw words, and lemmas by the (token, lemma) table; metrics: rouge1,
    rouge2, rougeL.
    """
    raw = T.held(pairs, "pair_id", cand=T.words(F.col("cand")), ref=T.words(F.col("ref")))
    modes = [("raw", raw), ("lemmatized", raw if lemma_of is None else _lemmatized(raw, lemma_of))]
    out = None
    for mode, df in modes:
        for metric, scored in (("rouge1", rouge_n(df, 1)), ("rouge2", rouge_n(df, 2)), ("rougeL", rouge_l(df))):
            one = scored.select("pair_id", F.lit(mode).alias("mode"), F.lit(metric).alias("metric"), "precision", "recall", "f1")
            out = one if out is None else out.unionByName(one)
    return out


def _lemmatized(pairs: DataFrame, lemma_of: DataFrame) -> DataFrame:
    """Token arrays with each token replaced by its lemma, in order."""

    def side(c: str) -> DataFrame:
        each = pairs.select("pair_id", F.posexplode(c).alias("i", "token")).join(lemma_of.select("token", "lemma"), "token", "left")
        words = F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "token").alias("w"))))
        return each.groupBy("pair_id").agg(F.transform(words, lambda x: x["w"]).alias(c))

    none = F.array().cast("array<string>")
    both = pairs.select("pair_id").join(side("cand"), "pair_id", "left").join(side("ref"), "pair_id", "left")
    return both.select("pair_id", F.coalesce("cand", none).alias("cand"), F.coalesce("ref", none).alias("ref"))
