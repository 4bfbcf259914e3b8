"""Reply trees, filter audit and centroid clustering against plain loops, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import SF, same_as_sql
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import centroids, chat, filter_audit, queries

NAMES = ["op11_chat_format", "op12_filter_audit", "op13_centroids"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


PIECES = st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "[", "s>", "a", " ", "\n", "é", "\U0001f600"])
TEXTS = st.lists(PIECES, max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool]", "[TEXT]"]), TEXTS), max_size=5))
@settings(max_examples=400, deadline=None)
def test_turns_come_back(turns):
    out, loss = chat.written(turns)
    assert chat.parsed(out) == turns
    assert [chat.unescaped(out[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    for control in chat.CONTROLS:  # none of them stands in a text
        assert not any(control in chat.escaped(t) for _, t in turns)


def brute_read_back(rows):
    """conv_id -> the row that read_back has to give, for (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        by[c].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    out = {}
    for c, turns in by.items():
        turns = [(role, text) for _, role, _, text in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.written(turns)[0]))
    return out


def test_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "tool", None]), rng.choice(["hi", "", None, "</s>", "x" * 50, "\\[INST]", "日本"])) for c in range(12) for t in range(rng.choice([1, 2, 3, 64, 65, 130]))]
    rows += [(3, 0, "user", "hi"), (3, 0, "user", "hi"), (4, None, "user", "first"), (None, 1, "assistant", "nobody's"), (None, 0, "user", "q"), (20, -5, "assistant", "w " * 200_000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    out = chat.conversations(chat.linear(table))
    got = {r.tree: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(out).collect()}
    assert got == brute_read_back(rows)
    assert out.agg(F.max("n_turns")).first()[0] == chat.TURNS
    none = chat.read_back(chat.conversations(chat.linear(table.limit(0))))
    assert none.count() == 0 and none.columns == ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def brute_paths(rows, best):
    """tree -> its best paths as texts, for (tree, node, parent, role, text, score) with distinct ids."""
    by = {(t, n): (p, text, s or 0.0) for t, n, p, _, text, s in rows}
    parents = {(t, p) for t, _, p, _, _, _ in rows}
    out = defaultdict(list)
    for t, n in by:
        if (t, n) in parents:
            continue
        path, at, seen = [], (t, n), set()
        while at in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = (t, by[at][0])
        if at in seen:
            continue
        out[t].append((-sum(by[x][2] for x in path) / len(path), n, [by[x][1] for x in reversed(path)]))
    return {t: [p for _, _, p in sorted(paths)[:best]] for t, paths in out.items()}


@pytest.mark.parametrize("best", [1, 3, None])
def test_reply_trees(spark, best):
    rng = random.Random(6)
    rows = []
    for t in ("a", "b", "c"):
        for n in range(60):
            parent = None if n == 0 else rng.choice([n - 1, rng.randrange(n)]) if n < 50 else n - 1
            rows.append((t, n, parent, rng.choice(["user", "assistant"]), f"{t}{n}", rng.choice([0.0, 0.5, 1.0, None])))
    rows += [("a", 100, 101, "user", "circle", 9.0), ("a", 101, 100, "user", "circle", 9.0), ("a", 102, 101, "user", "from a circle", 9.0)]
    rows += [("b", 200, 999, "user", "an orphan", 0.25), ("d", 1, 1, "user", "its own parent", 1.0)]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    out = chat.conversations(chat.trees(table), best, turns=7)
    segments = defaultdict(dict)
    for r in out.collect():
        segments[r.tree, r.rank][r.segment] = r.formatted
    got = defaultdict(list)
    for (t, _), parts in sorted(segments.items()):
        assert sorted(parts) == list(range(len(parts)))
        got[t].append([text for k in sorted(parts) for _, text in chat.parsed(parts[k])])
    assert got == brute_paths(rows, best)


def test_odd_messages(spark):
    rows = [("t", 1, None, None, None, None), ("t", 2, 1, "user", "x", 1.0), ("t", 2, 1, "user", "y", 1.0), ("t", 3, 2, "user", "z", None), ("t", None, 2, "user", "leaf", 0.0), (None, 1, None, "user", "alone", 0.0), ("e", None, None, "user", "root", 0.0)]
    table = spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, role string, text string, score double")
    out = chat.conversations(chat.trees(table), None)
    got = sorted((str(r.tree), [t for _, t in chat.parsed(r.formatted)]) for r in out.collect())
    first = min("xy", key=lambda t: hashlib.md5(t.encode()).hexdigest())
    other = "y" if first == "x" else "x"
    assert got == sorted([("None", ["alone"]), ("e", ["root"]), ("t", ["", first, "leaf"]), ("t", ["", first, "z"]), ("t", ["", other])])


def brute_audit(docs, labels):
    """(part, order, step) -> counts, document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    judged = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        mine = [x for x in labels if i is not None and x[0] == i]
        judged.append((lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [x for x in judged if x[0] == part]
        removed_by = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            alive = list(own)
            for step, f in enumerate(order, 1):
                gone, alive = [x for x in alive if x[1][f]], [x for x in alive if not x[1][f]]
                removed_by[f] += len(gone)
                unique = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), step] = [len(alive), len(gone), sum(x[1][f] for x in own) - len(gone), unique, sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = removed_by[row[6]] if isinstance(row[6], str) else row[6]
    return out


def test_filter_audit(spark):
    rng = random.Random(9)
    kinds = ["", None, "short text", " ".join(f"w{k}" for k in range(120)), " ".join(["same"] * 150), "A " * 130, " ".join(f"w{k}#" for k in range(100)), "\x0b\n" + " ".join(f"é{k}" for k in range(101)), "w " * 50_000]
    docs = [(k if k % 11 else None, rng.choice(kinds), rng.choice(["en", "de", None, ""])) for k in range(70)] + [(7, "short text", "en"), (7, "short text", "en"), (-1, "another", "only")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 70, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*d, True, 3) for d in docs], "doc_id long, text string, lang string, A boolean, n int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in filter_audit.audit(filter_audit.flagged(table, said), "ABCDE").collect()}
    assert got == brute_audit(docs, labels)
    assert filter_audit.audit(filter_audit.flagged(table.limit(0), said), "ABCDE").count() == 0
    assert filter_audit.audit(filter_audit.flagged(table, said.limit(0)), "ABCDE").agg(F.max("good_lost")).first()[0] == 0


def brute_clusters(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [e for _, e in start[:k]]
    near = lambda e: min((sum((x - y) ** 2 for x, y in zip(e, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, e in kept:
            groups[near(e)[1]].append(e)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centres)]
    found = [(i, *near(e)[::-1]) for i, e in kept]
    sums = defaultdict(int)
    for _, c, d in found:
        sums[c] += min(d, centroids.LONGEST)
    cut = lambda x: min(x, centroids.LONGEST)
    return sorted((str(i), c, cut(d), cut(sums[c]), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize("wide", [False, True])
def test_clusters(spark, wide):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(i % 4, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(5, rows[5][1]), (5, [0.0] * 6), (None, [1.0] * 6), (400, None), (401, [1.0] * 5), (402, [None] * 6), (403, [math.nan] * 6), (404, [math.inf] * 6), (405, [])]
    if wide:
        rows += [(500, [3e30] * 6), (501, [-2.5e33] + [0.0] * 5), (502, [3e30] * 5 + [1e20]), (503, [1e9] * 6)]
    table = spark.createDataFrame([(i, e, 0) for i, e in rows], "vec_id long, embedding array<double>, cluster int").repartition(5)
    got = centroids.clustered(table, k=5, rounds=3, dimensions=6, segment=4)
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == brute_clusters(rows, 5, 3, 6)


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id, r.distance) for r in centroids.clustered(table, k=16, dimensions=2).collect()) == [(1, 0), (2, 0)]
    assert centroids.clustered(table.limit(0), dimensions=2).count() == 0


def test_screening_leaves_out_distances_not_results():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (16, 64))
    vectors = centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 64))
    number, distance, done = centroids.nearest(vectors, centroids.segment_norms(vectors), centres)
    exact = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert done < 0.5 * exact.size
    same = np.repeat(vectors[:1], 3, axis=0)  # ties go to the smaller number
    assert centroids.nearest(same, centroids.segment_norms(same), np.repeat(vectors[1:2], 4, axis=0))[0].tolist() == [0, 0, 0]
