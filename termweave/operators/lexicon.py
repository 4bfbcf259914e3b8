"""Lemmas and parts of speech through a table of distinct words.

A lexicon is a table (token, lemma, pos).  It is made once over the distinct
words by a pluggable analyser, so no analyser runs per occurrence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import profiles as P
from termweave.functions import text as T

Analyser = Callable[[str], tuple[str, str | None]]


def lexicon_of(tokens: DataFrame, analyser: Analyser | None = None) -> DataFrame:
    """(token, lemma, pos) of the distinct tokens; without an analyser a word is its own lemma."""
    words = tokens.select("token").distinct()
    if analyser is None:
        return words.select("token", F.col("token").alias("lemma"), F.lit(None).cast("string").alias("pos"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [analyser(w) for w in part["token"]]
            yield part.assign(lemma=[x[0] for x in found], pos=[x[1] for x in found])

    return words.mapInPandas(run, "token string, lemma string, pos string")


def lemmas(docs: DataFrame, text: Column, lexicon: DataFrame | None = None, profile: P.TextProfile = P.UNICODE) -> DataFrame:
    """(doc_id, pos_in_text, lemma): words of three letters or more, no function words or stopwords.

    Short lemmas need a vowel.
    """
    kept = F.regexp_replace(F.lower(T.some(text)), f"[^{profile.lemma_letters}]", " ")
    base = docs.select("doc_id", F.posexplode(T.blank_separated(kept)).alias("pos_in_text", "raw"))
    words = base.filter(F.length("raw") >= 3).withColumn("token", F.btrim("raw", F.lit("-"))).filter("token <> ''")
    if lexicon is None:
        words = words.withColumn("lemma", F.col("token"))
    else:
        words = words.join(lexicon, "token", "left").filter(F.col("pos").isNull() | ~F.col("pos").isin(*P.FUNCTION_POS)).withColumn("lemma", F.coalesce("lemma", "token"))
    vowel = (F.length("lemma") > 3) | F.col("lemma").rlike("[аоуыэяеёюиaeiouy]") | F.col("lemma").rlike("[^а-яёa-z]")
    return words.filter(~F.col("lemma").isin(*profile.stopwords)).filter(vowel).select("doc_id", "pos_in_text", "lemma")


def is_valid_keyword(phrase: Column, profile: P.TextProfile = P.UNICODE) -> Column:
    """Words of three letters or more, none of them a stopword."""
    words = T.blank_separated(phrase)
    stop = F.array(*[F.lit(w) for w in profile.stopwords])
    return (F.size(words) > 0) & F.forall(words, lambda w: (F.length(w) >= 3) & F.lower(w).rlike(f"^[{profile.letters}\\-]+$") & ~F.array_contains(stop, F.lower(w)))


def valid_keywords(phrases: DataFrame, lexicon: DataFrame | None = None, profile: P.TextProfile = P.UNICODE) -> DataFrame:
    """The rows whose ``phrase`` is valid, by parts of speech too if there is a lexicon."""
    good = phrases.filter(is_valid_keyword(F.col("phrase"), profile))
    if lexicon is None:
        return good
    distinct = good.select("phrase").distinct().withColumn("words", T.blank_separated(F.lower("phrase")))
    parts = distinct.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("i", "token")).join(lexicon.select("token", "pos"), "token", "left")
    wrong = parts.filter(F.col("pos").isin(*P.NOT_KEYWORD_POS) | ((F.col("n") > 1) & (F.col("i") == F.col("n") - 1) & F.col("pos").isin(*P.NOT_LAST_POS)))
    return good.join(wrong.select("phrase").distinct(), "phrase", "left_anti")


def phrase_ids(phrases: DataFrame, lexicon: DataFrame, keep_digits: bool = True, letters: str = "а-яёa-z") -> DataFrame:
    """phrases with phrase_id: the lemmas of ``phrase`` in alphabetical order ('' if it has no word).

    Lemmas are looked up once for each distinct phrase.
    """
    distinct = phrases.select("phrase").distinct()
    parts = distinct.select("phrase", F.explode(T.words(F.col("phrase"), letters + ("0-9" if keep_digits else ""))).alias("token"))
    named = parts.join(lexicon.select("token", "lemma"), "token", "left").withColumn("lemma", F.coalesce("lemma", "token"))
    ids = named.groupBy("phrase").agg(F.array_join(F.array_sort(F.collect_list("lemma")), " ").alias("phrase_id"))
    return phrases.join(ids, "phrase", "left").withColumn("phrase_id", F.coalesce("phrase_id", F.lit("")))
