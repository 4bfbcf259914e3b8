"""Embedding keywords: candidates, vectors, diversity selection, redundancy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import profiles as P
from termweave.functions import text as T
from termweave.functions.sequences import pieces, small_batches

Embedder = Callable[[list[str]], np.ndarray]
AT_ONCE = 20_000  # phrases embedded together


def model_embedder(path: str, inputs: Callable[[list[str]], dict[str, np.ndarray]], output: int = 0) -> Embedder:
    """Unit vectors of an ONNX model at ``path``: ``inputs`` makes its arrays of texts (a tokenizer),
    its token vectors are averaged over the attention mask.  The model is loaded once a worker."""
    held: dict = {}

    def embed(texts: list[str]) -> np.ndarray:
        import onnxruntime

        if "model" not in held:
            held["model"] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        if not texts:
            return np.zeros((0, 1))
        fed = inputs(texts)
        out = held["model"].run(None, fed)[output]
        if out.ndim == 3:
            mask = fed["attention_mask"][:, :, None] if "attention_mask" in fed else np.ones(out.shape[:2])[:, :, None]
            out = (out * mask).sum(1) / np.maximum(mask.sum(1), 1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def hashed_ngram_embedder(dims: int = 128, n: int = 3) -> Embedder:
    """Vectors of hashed n-grams of bytes; deterministic, no model needed."""
    def embed(texts: list[str]) -> np.ndarray:
        data = [f" {t.lower()} ".encode() for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(data)), size)
        at = np.flatnonzero(np.arange(len(raw)) + n <= np.cumsum(size)[row]) if len(raw) else np.zeros(0, int)
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = (h ^ raw[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        place = row[at] * dims + (h % np.uint64(dims)).astype(np.int64)
        out = np.bincount(place, np.where(h >> np.uint64(63), 1.0, -1.0), len(data) * dims).reshape(len(data), dims)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def candidates(docs: DataFrame, profile: P.TextProfile = P.UNICODE, most: int = 5000) -> DataFrame:
    """(doc_id, text, phrases): distinct one- and two-word phrases of the text's start, without stopwords.

    The words are a column of their own, so that they are found once a text.
    """
    stop = F.array(*[F.lit(w) for w in profile.stopwords])
    start = F.substring(T.some(F.col("text")), 1, most)
    kept = F.filter(T.words(start), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    words = docs.select("doc_id", start.alias("text"), kept.alias("kept"))
    pairs = F.zip_with("kept", F.slice("kept", F.lit(2), F.greatest(F.size("kept") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    return words.select("doc_id", "text", F.array_distinct(F.concat("kept", F.array_compact(pairs))).alias("phrases"))


def diverse(doc: np.ndarray, phrases: np.ndarray, k: int, diversity: float) -> list[int]:
    """Maximal marginal relevance: first the likest, then likeness less the highest likeness to those chosen."""
    likeness = phrases @ doc
    chosen: list[int] = []
    worst = np.full(len(phrases), -np.inf)
    for _ in range(min(k, len(phrases))):
        score = likeness if not chosen else (1 - diversity) * likeness - diversity * worst
        score = score.copy()
        score[chosen] = -np.inf
        best = int(np.argmax(score))
        chosen.append(best)
        worst = np.maximum(worst, phrases @ phrases[best])
    return chosen


def ranked_phrases(docs: DataFrame, embed: Embedder | None = None, k: int = 25, diversity: float = 0.55, profile: P.TextProfile = P.UNICODE, most: int = 5000) -> DataFrame:
    """(doc_id, phrases): at most k phrases of each document, in order of choice."""
    embed = embed or hashed_ngram_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in pieces(whole, (2,), AT_ONCE)):
            lists = [p or [] for p in part.column(2).to_pylist()]
            docs, vectors = embed(part.column(1).to_pylist()), embed([p for some in lists for p in some])
            found, lo = [], 0
            for doc, phrases in zip(docs, lists, strict=True):
                picked = diverse(doc, vectors[lo : lo + len(phrases)], k, diversity) if phrases else []
                found.append([phrases[i] for i in picked])
                lo += len(phrases)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "phrases"])

    small_batches(docs.sparkSession)
    return candidates(docs, profile, most).mapInArrow(run, "doc_id long, phrases array<string>")


def without_redundant(phrases: Column, most: int = 10) -> Column:
    """Keeps a phrase unless it holds, or is held by, one kept before; at most so many."""
    none = F.array().cast("array<string>")
    clash = lambda kept, x: F.exists(kept, lambda e: F.contains(e, x) | F.contains(x, e))
    return F.aggregate(phrases, none, lambda kept, x: F.when((F.size(kept) >= most) | clash(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def semantic_keywords(docs: DataFrame, valid, embed: Embedder | None = None, k: int = 10, profile: P.TextProfile = P.UNICODE) -> DataFrame:
    """(doc_id, rank, phrase)."""
    ranked = ranked_phrases(docs, embed, profile=profile)
    kept = ranked.select("doc_id", without_redundant(F.filter("phrases", lambda p: valid(p)), k).alias("kept"))
    return kept.select("doc_id", F.posexplode("kept").alias("i", "phrase")).select("doc_id", (F.col("i") + 1).alias("rank"), "phrase")


def diverse_rows(vectors: DataFrame, anchor: DataFrame, k: int = 10, diversity: float = 0.55, candidates: int = 256) -> DataFrame:
    """(rank, vec_id): maximal marginal relevance over (vec_id, embedding) to one anchor (embedding).

    The ``candidates`` rows nearest to the anchor by cosine, ties to the smaller id, are
    what is chosen from: a feature of the search, so that the greedy choice, which
    needs the choices before it, works on a fixed number of rows.
    """
    one = anchor.select(F.col("embedding").alias("_anchor")).limit(1)
    near = vectors.crossJoin(F.broadcast(one)).select("vec_id", "embedding", F.round(cosine(F.col("embedding"), F.col("_anchor")), 12).alias("like"))
    best = near.orderBy(F.desc("like"), "vec_id").limit(candidates)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["like", "vec_id"], ascending=[False, True])
        x = np.stack([np.asarray(v, float) for v in part["embedding"]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        ids, like = part["vec_id"].to_numpy(), part["like"].to_numpy()
        chosen, worst = [], np.full(len(ids), -np.inf)
        for _ in range(min(k, len(ids))):
            score = like.copy() if not chosen else np.round((1 - diversity) * like - diversity * worst, 10)
            score[chosen] = -np.inf
            at = np.flatnonzero(score == score.max())
            i = int(at[np.argmin(ids[at])])
            chosen.append(i)
            worst = np.maximum(worst, x @ x[i])
        return pd.DataFrame({"rank": np.arange(1, len(chosen) + 1, dtype=np.int32), "vec_id": ids[chosen]})

    return best.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, "rank int, vec_id long")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
