"""Document quality by co-training a text view and a metadata view.

The text view sees statistics of the text and the shares of hashed groups of its
words, the metadata view language, source and length.  Both are logistic models,
fitted on labelled documents first.  In each round each view gives the other the
unlabelled documents it is surest of (calibrated probability of ``SURE``) as
pseudo-labels, and both make Newton steps; then they are calibrated on labelled
documents set aside, and their evidence is added.  All documents are scored.

The labelled documents are a sample of ``MAX_LABELLED`` of them, by hash (each is
taken with that chance, so about as many); their feature rows are on the driver.
All unlabelled documents take part in every round: executors keep their feature
rows, written once, and return the sums of a Newton step, whose number doesn't
depend on the corpus.  The pseudo-labels of a class weigh as much as its labels at
most, so that they don't drown them however large the corpus is.

Defined results: a null or empty text has statistics of zero and is scored by
them; null metadata is a value of its own; without labels of both kinds every
score is the share of good labels (1 without any), so all is kept; a doc_id
labelled twice is good only if all its labels say so; of several rows of one
labelled doc_id the smallest is learned from; repeated rows are scored alike;
other columns don't matter, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.shared import Words, bounded, dropped, fresh, sampled, stored, text_chunks

MAX_LABELLED = 20_000
ROUNDS, STEPS, SURE = 3, 3, 0.98
SET_ASIDE = 4  # one labelled document of so many calibrates
KEEP = 0.5
LANGS, SOURCES = 32, 128  # hash buckets
CHUNK = 1 << 20
GROUPS = 32  # of words, by hash
FAN = 32  # tasks whose sums are added at once
FEATURES = 30 + GROUPS

_KIND = np.zeros(256, np.int8)  # 1 lower 2 upper 3 digit 4 space 5 sentence mark 6 symbol
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[[ord(c) for c in "!#$%&*+/<=>@[]^_`{|}~\\"]] = 6
_KIND[128:] = 1


def text_features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, FEATURES): shares of character kinds and word and line statistics."""
    rows = len(at) - 1
    kind = _KIND[raw]
    if len(raw):  # capitals of the Latin-1 letters
        kind[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F)] = 2
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    per = lambda x: (lambda s: (s[at[1:]] - s[at[:-1]]).astype(float))(sums(x))
    size = np.maximum(np.diff(at), 1)
    letters = np.maximum(per(kind == 1) + per(kind == 2), 1)
    words = Words(raw, at)
    n = np.diff(words.first).astype(float)
    many = np.maximum(n, 1)
    h = words.hashes()
    row = words.row
    per_word = lambda x: np.bincount(row, x, rows) if len(row) else np.zeros(rows)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][first], minlength=rows) if len(row) else np.zeros(rows)
    length = (words.end - words.start).astype(float)
    lead, tail = kind[words.start], kind[words.end - 1]
    base = np.stack([
        per(kind == 2) / letters, per(kind == 3) / size, per(kind == 4) / size, per(kind == 5) / size, per(kind == 6) / size,
        per(raw == ord("|")) / many, per(raw == ord("!")) / many, per(raw == 10) / many,
        per_word(length) / many / 10, per_word(same) / many, distinct / many,
        per_word(lead == 2) / many, per_word(tail == 6) / many, per_word(tail == 5) / many, np.log1p(n) / 10,
    ], 1)
    groups = np.bincount(row * GROUPS + (h >> np.uint64(59)).astype(np.int64), minlength=rows * GROUPS).reshape(rows, GROUPS) / many[:, None]
    return np.concatenate([base, np.sqrt(base), groups], 1)


def meta_features(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """One-hot hashed language and source, and length."""
    out = np.zeros((len(lang), LANGS + SOURCES + 3))
    for k, (a, b) in enumerate(zip(lang, source, strict=True)):
        out[k, _bucket(a, LANGS)] = 1
        out[k, LANGS + _bucket(b, SOURCES)] = 1
    x = np.log1p(np.maximum(n_chars, 0)) / 10
    out[:, -3], out[:, -2], out[:, -1] = x, x * x, n_chars == 0
    return out


@lru_cache(1 << 14)
def _bucket(value, n: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(str(value).encode()) % (n - 1)


class Logistic:
    """Logistic regression with a ridge, by Newton steps; the first ``plain`` columns are taken as they are."""

    def __init__(self, ridge: float = 1.0, plain: int = 0):
        self.ridge, self.plain = ridge, plain

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, spread = x.mean(0), x.std(0)
        self.scale = np.where(spread < 1e-6, 1.0, spread)
        self.mean[: self.plain], self.scale[: self.plain] = 0, 1
        self.beta = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.step(*self.sums(x, y)[1:]) < 1e-6:
                break
        return self

    def sums(self, x: np.ndarray, y: np.ndarray | float) -> tuple[float, np.ndarray, np.ndarray]:
        """Rows, gradient and curvature of a Newton step; those of several tables may be added."""
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)
        p = sigmoid(z @ self.beta)
        return float(len(x)), z.T @ (y - p), (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z

    def step(self, gradient: np.ndarray, curvature: np.ndarray) -> float:
        """Makes the step; its largest change."""
        keep = np.full(len(self.beta), self.ridge)
        keep[-1] = 1e-3
        step = np.linalg.solve(curvature + np.diag(keep), gradient - keep * self.beta)
        self.beta = self.beta + np.clip(step, -5, 5)
        return float(np.abs(step).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1], -30, 30)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CoTrained:
    """Two views trained on each other's confident labels, then calibrated."""

    def learn(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool=None) -> CoTrained:
        """pool(self): the added-up ``pool_sums`` of all unlabelled documents."""
        self.prior = float(y.mean()) if len(y) else 1.0
        self.views = None
        if len(np.unique(y)) < 2:
            return self
        aside = np.arange(len(y)) % SET_ASIDE == SET_ASIDE - 1
        if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
            aside[:] = False
        learn = np.flatnonzero(~aside)
        check = np.flatnonzero(aside) if aside.any() else learn
        x = (text, meta)
        self.views = [Logistic().fit(text[learn], y[learn]), Logistic(plain=LANGS + SOURCES if meta.shape[1] > LANGS + SOURCES else 0).fit(meta[learn], y[learn])]
        own = [float((y[learn] == c).sum()) for c in (0, 1)]
        for r in range(ROUNDS + 1):
            self.scale = [Logistic(1e-2).fit(m.logit(x[v][check])[:, None], y[check]) for v, m in enumerate(self.views)]
            if r == ROUNDS or pool is None:
                break
            self.teachers = list(zip(copy.deepcopy(self.views), self.scale, strict=True))
            for _ in range(STEPS):
                given = pool(self)
                for v, m in enumerate(self.views):
                    _, gradient, curvature = m.sums(x[v][learn], y[learn])
                    for c in (0, 1):
                        n, more, curve = given[v][c]
                        weight = min(1.0, own[c] / n) if n else 0.0
                        gradient, curvature = gradient + weight * more, curvature + weight * curve
                    m.step(gradient, curvature)
        self.teachers = None
        return self

    def fit(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> CoTrained:
        """The same with the unlabelled documents' features at hand."""
        return self.learn(text, meta, y, (lambda model: model.pool_sums(pool_text, pool_meta)) if len(pool_text) else None)

    def pool_sums(self, text: np.ndarray, meta: np.ndarray) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
        """For each view and class the sums over the documents that the other view is sure of."""
        x, out = (text, meta), []
        for v, m in enumerate(self.views):
            teacher, scale = self.teachers[1 - v]
            p = sigmoid(scale.logit(teacher.logit(x[1 - v])[:, None]))
            out.append([m.sums(x[v][sure], float(c)) for c, sure in ((0, p <= 1 - SURE), (1, p >= SURE))])
        return out

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both together."""
        if self.views is None:
            one = np.full(len(text), self.prior)
            return one, one, one
        z = [s.logit(m.logit(x)[:, None]) for s, m, x in zip(self.scale, self.views, (text, meta), strict=True)]
        base = np.log(self.prior / (1 - self.prior))
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(z[0] + z[1] - base)


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars, text; what a table lacks is null, n_chars the text's length."""
    col = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), col("lang", "string").alias("lang"), col("source", "string").alias("source"), F.coalesce(col("n_chars", "double"), F.length(text).cast("double")).alias("n_chars"), text.alias("text"))


def _rows(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return text_features(raw, at), meta_features(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_chars and the text's statistics (32-bit floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                x = text_features(raw, at).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "source", "n_chars", "stats"])

    return _inputs(docs).mapInArrow(run, "doc_id long, lang string, source string, n_chars double, stats binary")


def _features(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """What feature_rows made, as numbers: text view, metadata view."""
    stats = np.frombuffer(b"".join(table.column("stats").to_pylist()), np.float32).reshape(-1, FEATURES).astype(float)
    return stats, meta_features(table.column("lang").to_pylist(), table.column("source").to_pylist(), table.column("n_chars").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("n_chars").to_numpy())


def _flat(sums: list) -> np.ndarray:
    """The sums of both views and classes in one row; of a curvature the upper triangle."""
    return np.concatenate([np.concatenate([[n], g, h[np.triu_indices(len(g))]]) for view in sums for n, g, h in view])


def _unflat(row: np.ndarray, sizes: tuple[int, int]) -> list:
    out, at = [], 0
    for d in sizes:
        view = []
        for _ in (0, 1):
            upper = np.triu_indices(d)
            h = np.zeros((d, d))
            h[upper] = row[at + 1 + d : at + 1 + d + len(upper[0])]
            view.append((float(row[at]), row[at + 1 : at + 1 + d], h + np.triu(h, 1).T))
            at += 1 + d + len(upper[0])
        out.append(view)
    return out


PACKED = "task int, place binary, x binary"  # a row a task, however many sums it has


def _packed(task: int, total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([some.astype(np.int32).tobytes()], pa.binary()), pa.array([total[some].tobytes()], pa.binary())], names=["task", "place", "x"])


def _total(rows: pa.Table, size: int) -> np.ndarray:
    total = np.zeros(size)
    for place, x in sorted(zip(*(rows.column(c).to_pylist() for c in ("place", "x")), strict=True)):  # in one order, as sums of floats depend on it
        total[np.frombuffer(place, np.int32)] += np.frombuffer(x)
    return total


def _added(rows: pa.Table, size: int) -> pa.Table:
    return pa.Table.from_batches([_packed(rows.column("task")[0].as_py(), _total(rows, size))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    spark = bounded(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    rows = stored(feature_rows(docs).join(known, "doc_id", "left"), "features")
    chosen = sampled(rows.filter("quality is not null"), max_labelled)
    columns = ("lang", "source", "n_chars", "stats")
    got = chosen.groupBy("doc_id", "quality").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "quality", *[f"r.{c}" for c in columns]).toArrow().sort_by("doc_id")
    order = np.random.default_rng(5).permutation(got.num_rows)
    text, meta = (x[order] for x in _features(got))
    sizes = (text.shape[1] + 1, meta.shape[1] + 1)
    size = sum(2 * (1 + d + d * (d + 1) // 2) for d in sizes)
    unlabelled = rows.filter("quality is null").select(*columns)

    def pool(model: CoTrained) -> list:
        held = spark.sparkContext.broadcast(model)  # a few hundred numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + _flat(held.value.pool_sums(*_features(batch)))
            if np.ndim(total):
                yield _packed(TaskContext.get().partitionId(), total)

        def added(rows: pa.Table) -> pa.Table:
            return _added(rows, size)

        sums = unlabelled.mapInArrow(run, PACKED)
        for _ in range(2):  # FAN tasks at once, so that few sums reach the driver
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("task").applyInArrow(added, PACKED)
        row = _total(sums.toArrow(), size)
        held.destroy()
        return _unflat(row, sizes)

    model = CoTrained().learn(text, meta, got.column("quality").to_numpy().astype(float)[order], pool)
    dropped(rows)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text_score, meta_score, score (that the document is good), keep of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in text_chunks(batch, size=CHUNK):
                a, b, both = model.value.scores(*_rows(part, raw, at))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= keep)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return _inputs(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))
    order = _inputs(docs).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            names = batch.schema.names
            text = pc.fill_null(batch.column(names.index("text")), "")
            null = pa.nulls(batch.num_rows, pa.string())
            pick = lambda c: batch.column(names.index(c)).cast(pa.string()) if c in names else null
            size = pc.utf8_length(text).cast(pa.float64())
            n_chars = pc.coalesce(batch.column(names.index("n_chars")).cast(pa.float64()), size) if "n_chars" in names else size
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), pick("lang"), pick("source"), n_chars, text], order)
            good = [model.value.scores(*_rows(part, raw, at))[2] >= keep for part, raw, at in text_chunks(rows, size=CHUNK)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
