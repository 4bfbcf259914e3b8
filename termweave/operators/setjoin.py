"""Joins of sets by what they share, by prefixes instead of by every common element.

The elements of all sets are ordered, the rarest first.  Two sets that share enough to
be linked have their first common element near the head of both, so only the head of a
set, its prefix, is dealt out by element; a frequent element stands at the end and brings
nothing together by itself.  What meets in one element is compared in numpy, at
most ``BLOCK`` by ``BLOCK`` sets at a time, and a link counts where its first common
element is, so every link is found once.  Equal sets are one class and are compared once.

``weighted`` sets count how often an element stands; what two sets share is then the sum
over common elements of the product of both counts.

Defined results: rows with a null id or element don't count; repeated rows are one element,
or add to its weight; documents without elements have no class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.ranges import placed
from termweave.sources.scratch import dropped, stored

BLOCK = 512  # sets of one element that meet as many others in one task
DENSE = 32  # sets of one element from which a product of matrices is used
WIDTH = 4096  # columns of such a matrix
PAIRS, TOKENS = 1 << 18, 1 << 21  # compared at once


@dataclass
class Sets:
    """Classes of equal sets: members (pub_id, class_id, class_size), about (class_id, class_size, n, square)
    and sets (class_id, n, class_size, tokens, weights, tops).

    tokens are ranks of the elements that two classes at least have, rarest first; tops are the largest
    weights that any set has for them; n counts all elements, square sums their squared weights.
    """

    members: DataFrame
    about: DataFrame
    sets: DataFrame


def classes(edges: DataFrame, weighted: bool = False) -> Sets:
    """Sets of (pub_id, keyword_id); a class is named by its smallest pub_id.  Only ``weighted`` sets have weights and tops."""
    known = edges.filter("pub_id is not null and keyword_id is not null").select("pub_id", F.col("keyword_id").alias("k"))
    if weighted:
        whole = known.groupBy("pub_id", "k").agg(F.count("*").alias("w")).groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("items"))
    else:
        whole = known.groupBy("pub_id").agg(F.array_sort(F.collect_set(F.struct("k"))).alias("items"))
    extra = ["w"] if weighted else []
    sets = stored(whole.withColumn("set_key", F.unhex(F.sha2(F.to_json("items"), 256))), "sets")
    named = sets.groupBy("set_key").agg(F.min("pub_id").alias("class_id"), F.count("*").alias("class_size"))
    members = stored(sets.select("pub_id", "set_key").join(named, "set_key").drop("set_key"), "members")
    first = members.filter("pub_id = class_id").select("pub_id", "class_size")
    own = stored(sets.drop("set_key").join(first, "pub_id").withColumnRenamed("pub_id", "class_id"), "classes")
    dropped(sets)
    elements = own.select("class_id", F.explode("items").alias("x")).select("class_id", "x.*")
    found = elements.groupBy("k").agg(F.count("*").alias("df"), *[F.max(w).alias("top") for w in extra]).filter("df > 1")
    ranks = placed(found, [F.col("df"), F.col("k")], "token")
    kind = "int" if ranks.count() < 2**31 else "long"  # tokens travel with every set, so they are as narrow as they can be
    values = [F.col("token").cast(kind).alias("token"), *(["w", "top"] if weighted else [])]
    shared = elements.join(ranks, "k").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct(*values))).alias("x"))
    columns = [F.col(f"x.{c}").alias(to) for c, to in (("token", "tokens"), *((("w", "weights"), ("top", "tops")) if weighted else ()))]
    size = F.size("items").cast("long")
    square = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["w"] * x["w"]) if weighted else size
    about = stored(own.select("class_id", "class_size", size.alias("n"), square.alias("square")), "about")
    ready = stored(about.drop("square").join(shared, "class_id").select("class_id", "n", "class_size", *columns), "ranked")
    for table in (own, ranks):
        dropped(table)
    return Sets(members, about, ready)


@dataclass(frozen=True)
class Alike:
    """Jaccard similarity of at least ``least``."""

    least: float

    def prefix(self) -> Column:
        """How many of its tokens a set is dealt out by."""
        return F.size("tokens") - F.ceil(F.lit(self.least) * F.col("n") - 1e-9) + 1

    def may(self, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.minimum(n1, n2) >= self.least * np.maximum(n1, n2) - 1e-9

    def linked(self, shared: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return shared / (n1 + n2 - shared) >= self.least


@dataclass(frozen=True)
class Shared:
    """What is shared (elements, or products of weights) is at least ``least``."""

    least: int
    weighted: bool = False

    def prefix(self) -> Column:
        if not self.weighted:
            return F.size("tokens") - self.least + 1
        most = lambda x: x["weights"] * x["tops"]  # noqa: E731  what a token can add, whatever the other set
        seen = F.aggregate(F.reverse(F.arrays_zip("weights", "tops")), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + most(x)).alias("sum"), (a["n"] + F.when(a["sum"] + most(x) >= self.least, 1).otherwise(0)).alias("n")))
        return seen["n"]

    def may(self, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.ones(np.broadcast(n1, n2).shape, bool)

    def linked(self, shared: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return shared >= self.least


class Rows:
    """Some dealt rows in numpy: their sets' tokens lie one after another in ``flat``."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).combine_chunks()
        number = lambda c: column(c).to_numpy(zero_copy_only=False)
        self.ids, self.token, self.part, self.n, self.size = column("class_id"), number("token"), number("part"), number("n"), number("class_size")
        tokens = column("tokens")
        self.flat = tokens.flatten().to_numpy().astype(np.int64)
        self.weights = column("weights").flatten().to_numpy() if "weights" in table.column_names else np.ones(len(self.flat), np.int64)
        self.at = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())]).astype(np.int64)
        i, j = number("i"), number("j")
        self.cross = i != j
        new = np.flatnonzero((self.token[1:] != self.token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        self.cells = np.concatenate([[0], new, [len(self.token)]])
        self.copies: bool | None = None

    def meant(self, a: np.ndarray, b: np.ndarray):
        """Whether pairs of rows are sought: all, or those with or without a class of several documents."""
        return True if self.copies is None else ((self.size[a] > 1) | (self.size[b] > 1)) == self.copies


def _few(rows: Rows, first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within small cells."""
    for size in np.unique(sizes[sizes > 1]):
        a, b = np.triu_indices(int(size), 1)
        starts = first[sizes == size]
        step = max(1, PAIRS // len(a))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            yield (at + a).ravel(), (at + b).ravel()


def _compared(rows: Rows, a: np.ndarray, b: np.ndarray, rule, keys: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs of rows of one cell, the linked ones whose first common token is the cell's, and what they share."""
    fine = rule.may(rows.n[a], rows.n[b]) & rows.meant(a, b) & ~(rows.cross[a] & (rows.part[a] == rows.part[b]))
    a, b = a[fine], b[fine]
    length = np.diff(rows.at)
    swap = length[a] > length[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    chunk = np.cumsum(length[a]) // TOKENS
    for these in np.split(np.arange(len(a)), np.flatnonzero(np.diff(chunk)) + 1):
        if not len(these):
            continue
        x, y = a[these], b[these]
        starts = np.concatenate([[0], np.cumsum(length[x])])
        pair = np.repeat(np.arange(len(x)), length[x])
        own = np.arange(starts[-1]) - starts[pair] + rows.at[x][pair]
        wanted = y[pair] * width + rows.flat[own]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[place] == wanted
        shared = np.add.reduceat(np.where(hit, rows.weights[own] * rows.weights[place], 0), starts[:-1])
        first = np.minimum.reduceat(np.where(hit, rows.flat[own], width), starts[:-1])
        good = (first == rows.token[x]) & rule.linked(shared, rows.n[x], rows.n[y])
        yield x[good], y[good], shared[good]


def _many(rows: Rows, lo: int, hi: int, rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for one large cell, by products of matrices."""
    left = right = np.arange(lo, hi)
    if rows.cross[lo]:
        parts = rows.part[lo:hi]
        left, right = left[parts == parts[0]], right[parts != parts[0]]
    flat, weights = rows.flat[rows.at[lo] : rows.at[hi]], rows.weights[rows.at[lo] : rows.at[hi]]
    row = np.repeat(np.arange(hi - lo), np.diff(rows.at[lo : hi + 1]))
    tokens, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    kept = often > 1
    column, tokens = np.where(kept, np.cumsum(kept) - 1, -1)[column], tokens[kept]
    shared, before = (np.zeros((len(left), len(right))) for _ in "ab")
    head = int(np.searchsorted(tokens, rows.token[lo]))  # columns of tokens before the cell's
    order = np.argsort(column, kind="stable")
    bounds = sorted({*range(0, len(tokens), WIDTH), head, len(tokens)})
    for start, end in zip(bounds, bounds[1:], strict=False):
        these = order[np.searchsorted(column[order], start) : np.searchsorted(column[order], end)]
        matrix = np.zeros((hi - lo, end - start))
        matrix[row[these], column[these] - start] = weights[these]
        product = matrix[left - lo] @ matrix[right - lo].T
        shared += product
        if end <= head:
            before += product
    n1, n2 = rows.n[left][:, None], rows.n[right][None]
    fine = (before == 0) & (shared > 0) & rule.may(n1, n2) & rows.meant(left[:, None], right[None])
    if not rows.cross[lo]:
        fine &= np.triu(np.ones(fine.shape, bool), 1)
    x, y = np.nonzero(fine)
    found = shared[x, y].astype(np.int64)
    good = rule.linked(found, rows.n[left[x]], rows.n[right[y]])
    return left[x[good]], right[y[good]], found[good]


def links_of(rows: Rows, rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, shared) of the links that whole cells of rows hold."""
    sizes = np.diff(rows.cells)
    width = int(rows.flat.max(initial=0)) + 1
    keys = np.repeat(np.arange(len(rows.at) - 1), np.diff(rows.at)) * width + rows.flat
    small = sizes < DENSE
    for a, b in _few(rows, rows.cells[:-1][small], sizes[small]):
        yield from _compared(rows, a, b, rule, keys, width)
    for k in np.flatnonzero(~small):
        yield _many(rows, int(rows.cells[k]), int(rows.cells[k + 1]), rule)


def dealt(sets: DataFrame, rule, block: int = BLOCK) -> DataFrame:
    """The sets at the cells (token, i, j) of their prefixes: parts i and j of the sets dealt out by one token."""
    light = sets.select("class_id", F.explode(F.slice("tokens", 1, F.greatest(rule.prefix(), F.lit(0)).cast("int"))).alias("token"))
    sizes = light.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    own = light.join(sizes, "token").withColumn("part", F.pmod(F.xxhash64("class_id", "token"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = own.withColumn("other", other).select("class_id", "token", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return cells.join(sets.drop("tops"), "class_id")


def _run(rule, answer: Callable[[Rows], Iterator[pa.RecordBatch]]):
    """A function over sorted batches that hands whole cells on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ends = batch.num_rows - 1
            last = [batch.column(batch.schema.get_field_index(c))[ends].as_py() for c in ("token", "i", "j")] if batch.num_rows else None
            held.append(batch)
            table = pa.Table.from_batches(held)
            if last is None or table.num_rows < 2 * BLOCK:
                continue
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(("token", "i", "j"), last, strict=True)])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from answer(Rows(table.slice(0, cut)))
                held = table.slice(cut).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held):
            yield from answer(Rows(pa.Table.from_batches(held)))

    return run


def _sorted(sets: DataFrame, rule, block: int) -> DataFrame:
    return dealt(sets, rule, block).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


def linked_classes(sets: DataFrame, rule, block: int = BLOCK, copies: bool | None = None) -> DataFrame:
    """(class1, class2, shared, n1, n2) of the links between classes, class1 < class2.

    ``copies`` tells the links of which a class has several documents from those of two single ones.
    """

    def answer(rows: Rows) -> Iterator[pa.RecordBatch]:
        rows.copies = copies
        for a, b, shared in links_of(rows, rule):
            if len(a):
                yield pa.RecordBatch.from_arrays([rows.ids.take(pa.array(a)), rows.ids.take(pa.array(b)), pa.array(shared), pa.array(rows.n[a]), pa.array(rows.n[b])], names=["a", "b", "shared", "na", "nb"])

    kind = sets.schema["class_id"].dataType.simpleString()
    found = _sorted(sets, rule, block).mapInArrow(_run(rule, answer), f"a {kind}, b {kind}, shared long, na long, nb long")
    up = F.col("a") < F.col("b")
    return found.select(F.least("a", "b").alias("class1"), F.greatest("a", "b").alias("class2"), "shared", F.when(up, F.col("na")).otherwise(F.col("nb")).alias("n1"), F.when(up, F.col("nb")).otherwise(F.col("na")).alias("n2"))


def link_counts(sets: DataFrame, rule, block: int = BLOCK) -> DataFrame:
    """(class_id, links, linked): how many classes a class is linked to, and how many documents they are.  Pairs aren't made rows of."""

    def answer(rows: Rows) -> Iterator[pa.RecordBatch]:
        links, documents = np.zeros(len(rows.n), np.int64), np.zeros(len(rows.n), np.int64)
        for a, b, _ in links_of(rows, rule):
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, 1)
                np.add.at(documents, x, rows.size[y])
        some = np.flatnonzero(links)
        if len(some):
            yield pa.RecordBatch.from_arrays([rows.ids.take(pa.array(some)), pa.array(links[some]), pa.array(documents[some])], names=["class_id", "links", "linked"])

    kind = sets.schema["class_id"].dataType.simpleString()
    found = _sorted(sets, rule, block).mapInArrow(_run(rule, answer), f"class_id {kind}, links long, linked long")
    return found.groupBy("class_id").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))

