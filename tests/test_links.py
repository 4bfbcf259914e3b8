"""Set joins, top pairs, gram index, pages, keyed tables and streams on small tables, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import graph, setjoin, toppairs
from termweave.sources import gramindex, keyed, pages

EDGES = "pub_id string, keyword_id string"


def random_edges(seed, documents=80, terms=60, most=14):
    """Edges with frequent terms, copies, near copies, repeated rows and nulls."""
    rng = random.Random(seed)
    rows, sets = [], []
    for k in range(documents):
        if sets and rng.random() < 0.4:
            s = list(rng.choice(sets))
            if rng.random() < 0.6 and s:
                s[rng.randrange(len(s))] = f"t{rng.randrange(terms)}"
        else:
            s = [f"t{int(terms * rng.random() ** 2)}" for _ in range(rng.randint(1, most))]
        sets.append(s)
        rows += [(f"d{k:03}", t) for t in s] + [(f"d{k:03}", "everywhere")] * (k % 3 > 0)
    return rows + [(None, "t1"), ("d001", None), ("only", None)]


def by_document(rows):
    out = {}
    for d, t in rows:
        if d is not None and t is not None:
            out.setdefault(d, []).append(t)
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("block", [3, 512])
def test_similar_to(spark, monkeypatch, threshold, block):
    rows = random_edges(3)
    monkeypatch.setattr(setjoin, "DENSE", 6)
    sets = {d: set(t) for d, t in by_document(rows).items()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {p: s for p, s in want.items() if s >= threshold}
    edges = spark.createDataFrame(rows, EDGES)
    got = {(r.source, r.target): r.score for r in graph.similar_to(edges, threshold).collect()}
    assert got == want
    s = setjoin.classes(edges)
    links = setjoin.linked_classes(s.sets, setjoin.Alike(threshold), block)
    first = {frozenset(t): min(d for d in sets if sets[d] == t) for t in sets.values()}
    assert sorted((r.class1, r.class2) for r in links.collect()) == sorted(p for p in want if set(p) <= set(first.values()))
    counts = {r.pub_id: r for r in graph.link_counts(edges, threshold).collect()}
    for d in sets:
        near = [x for x in sets if sets[x] != sets[d] and len(sets[d] & sets[x]) / len(sets[d] | sets[x]) >= threshold]
        assert (counts[d].class_id, counts[d].linked, counts[d].links) == (first[frozenset(sets[d])], len(near), len({frozenset(sets[x]) for x in near}))
    assert "only" not in counts


def test_frequent_terms_bring_nothing_together(spark):
    rows = [(f"d{k:03}", t) for k in range(300) for t in ("hub", *(f"own{k}-{i}" for i in range(9)))]
    rows += [(f"e{k}", t) for k in range(4) for t in ("hub", "a", "b", "c", f"x{k}")]
    s = setjoin.classes(spark.createDataFrame(rows, EDGES))
    cells = setjoin.dealt(s.sets, setjoin.Alike(0.5))
    compared = cells.groupBy("token", "i", "j").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0]
    assert compared <= 18  # of 46,056 pairs that share the hub
    assert setjoin.linked_classes(s.sets, setjoin.Alike(0.5)).count() == 6


def test_empty_sets(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.similar_to(none, 0.5).count() == 0 and graph.link_counts(none).count() == 0
    assert toppairs.top_pairs(none).count() == 0


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize(("k", "head"), [(1, 2), (10, 5), (60, 2048)])
def test_top_pairs(spark, weighted, k, head):
    rows = random_edges(8) + [("d005", "t3")] * 3
    documents = by_document(rows)
    count = (lambda d, t: documents[d].count(t)) if weighted else (lambda d, t: 1)
    score = {(a, b): sum(count(a, t) * count(b, t) for t in set(documents[a]) & set(documents[b])) for a, b in itertools.combinations(sorted(documents), 2)}
    want = sorted(((s, p) for p, s in score.items() if s >= 2), key=lambda x: (-x[0], x[1]))[:k]
    got = toppairs.top_pairs(spark.createDataFrame(rows, EDGES), 2, k, weighted, head)
    assert [(r.score, (r.d1, r.d2)) for r in got.collect()] == want


def test_top_pairs_join_few_rows(spark, monkeypatch):
    """Documents that can't reach the k-th best pair are never joined."""
    rows = [(f"d{k:04}", f"t{i}") for k in range(600) for i in (k % 5, 5 + k % 7)]
    rows += [(f"big{k}", f"u{i}") for k in range(12) for i in range(k, 40 + k)]
    seen = []
    plain = setjoin.dealt


    def watched(sets, rule, block=setjoin.BLOCK):
        seen.append([r.class_id for r in plain(sets, rule, block).collect()])
        return plain(sets, rule, block)

    monkeypatch.setattr(setjoin, "dealt", watched)
    got = toppairs.top_pairs(spark.createDataFrame(rows, EDGES), 2, 10, False, head=12).collect()
    assert [r.score for r in got] == [39] * 10
    assert len(seen) == 2 and len(seen[1]) < len(seen[0]) / 10
    assert not [d for ids in seen for d in ids if d.startswith("d")]


@pytest.fixture(scope="module")
def titled(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["Graph", "knowledge", "ßeta", "Öl", "x", "a.b", "tr\\ee", "100%", "日本語", "\U0001f600ok", "two\nlines"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))) for k in range(150)]
    rows += [(150, None), (151, ""), (152, "x"), (152, "again Graph"), (None, "nobody's")]
    folder = str(tmp_path_factory.mktemp("grams"))
    index = gramindex.build(spark.createDataFrame(rows, "id long, text string"), folder, buckets=8, block=32)
    return rows, index


@pytest.mark.parametrize("query", ["x", "ö", "gr", "%", ".", "\\", "APH", "knowledge g", "語", "本語", "日本語", "\U0001f600", "\U0001f600o", "o\nl", "zzz", "q", "nobody", ""])
def test_gram_index(spark, titled, query):
    rows, index = titled
    want = {i for i, t in rows if t and query.lower() in t.lower()}
    assert sorted((r.id for r in index.ids(spark, query).collect()), key=str) == sorted(want, key=str)


def test_a_search_reads_the_buckets_of_its_grams(spark, titled):
    _, index = titled
    buckets = {r.bucket for r in index._read(spark, "lists").select("bucket").distinct().collect()}
    plan = index.lists(spark, "knowledge")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    asked = {gramindex._bucket("knowledge"[i : i + 3], 8) for i in range(7)}
    read = index.lists(spark, "knowledge").select("bucket").distinct().collect()
    assert {r.bucket for r in read} <= asked < buckets
    assert index.lists(spark, "gr").select("gram").distinct().filter("gram not like 'gr%'").count() == 0


def test_gram_index_of_nothing(spark, tmp_path):
    index = gramindex.build(spark.createDataFrame([], "id string, text string"), str(tmp_path))
    assert index.ids(spark, "abc").count() == index.ids(spark, "a").count() == 0


@pytest.mark.parametrize("order", [("title", "id"), ("-n", "id"), ("id",)])
def test_pages(spark, tmp_path, order):
    rng = random.Random(7)
    rows = [(k, rng.choice(["b", "a", None, "c", "Ä"]), rng.choice([1, 2, None, 7])) for k in range(97)]
    rng.shuffle(rows)
    table = pages.write(spark.createDataFrame(rows, "id long, title string, n int"), str(tmp_path), order, parts=5)

    def place(r):
        row = dict(zip(("id", "title", "n"), r, strict=True))
        out = []
        for name in order:
            v = row[name.removeprefix("-")]
            out += [v is None, (0 if v is None else -v) if name.startswith("-") else (v or "" if isinstance(v, str) or name == "title" else v)]
        return out

    want = [r[0] for r in sorted(rows, key=place)]
    assert table.total(spark) == 97
    for number in (1, 2, 5, 10, 11):
        assert [r.id for r in table.page(spark, number, 10).collect()] == want[(number - 1) * 10 : number * 10]
    by_id = {r[0]: r for r in rows}
    for at in (0, 30, 95, 96):
        row = dict(zip(("id", "title", "n"), by_id[want[at]], strict=True))
        key = tuple(row[name.removeprefix("-")] for name in order)
        assert [r.id for r in table.after(spark, key, 4).collect()] == want[at + 1 : at + 5]
    # a page reads the files of the ranges it lies in
    sizes = {r.range_no: r.range_rows for r in table.directory(spark).collect()}
    plan = table.page(spark, 7, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range_no" in plan or "PartitionFilters: [isnotnull(range_no" in plan
    assert len(sizes) == 5 and max(sizes.values()) < 40


def test_pages_of_nothing(spark, tmp_path):
    table = pages.write(spark.createDataFrame([], "id long, title string"), str(tmp_path), ("title", "id"))
    assert table.total(spark) == 0 and table.page(spark, 1, 5).count() == 0 and table.after(spark, ("x", 1), 5).count() == 0


def test_keyed_table(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path), "id string, v int", ("id",), 8).create(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int, seq long, deleted boolean")
    state = lambda: {r.id: r.v for r in table.rows(spark).collect()}
    assert state() == {}
    table.apply(rows(("a", 1, 1, None), ("a", 2, 3, False), ("a", 3, 2, False), ("b", 1, 1, False), (None, 9, 9, False), ("n", 4, None, False)), "one")
    assert state() == {"a": 2, "b": 1, "n": 4}
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("bucket=*/*.parquet")}
    before = files()
    assert table.apply(rows(("a", 7, 9, False)), "one") == 0 and files() == before
    assert table.apply(rows(("b", 5, 4, False), ("b", 6, 2, False), ("a", 0, 1, False)), "two") in (1, 2)
    after = files()
    kept = {p for p in before if after.get(p) == before[p]}
    touched = {p.parent for p in after if p not in before}
    assert state() == {"a": 2, "b": 5, "n": 4} and touched and {p.parent for p in kept}.isdisjoint(touched)
    table.apply(rows(("b", None, 5, True), ("c", None, 5, True)), "three")
    table.apply(rows(("b", 1, 4, False), ("c", 2, 6, False)), "four")
    assert state() == {"a": 2, "c": 2, "n": 4}
    table.apply(rows(("b", 1, 4, False), ("c", 2, 6, False)), "four", skip=False)
    assert state() == {"a": 2, "c": 2, "n": 4} and table.applied(spark).count() == 4
    table.apply(rows(), "none")
    assert table.applied(spark).filter("touched = 0").count() == 1


def test_graph_store(spark, tmp_path):
    store = keyed.GraphStore.at(str(tmp_path), buckets=4).create(spark)
    docs = lambda *r: spark.createDataFrame(list(r), "id string, title string, annotation string")
    words = lambda *r: spark.createDataFrame([(w, w.upper(), ["author"]) for w in r], "id string, name string, methods array<string>")
    edges = lambda *r: spark.createDataFrame([(d, k, "author", 1.0) for d, k in r], "pub_id string, keyword_id string, method string, weight double")
    store.load(graph.Graph(docs(("d1", "A", ""), ("d2", "B", "")), words("k1", "k2"), edges(("d1", "k1"), ("d1", "k1"), ("d2", "k2"), ("d2", "gone"))), 1, "b1")
    store.load(graph.Graph(docs(("d2", "B2", "")), words("k3"), edges(("d2", "k3"))), 2, "b2")
    store.load(graph.Graph(docs(("d2", "old", "")), words(), edges(("d2", "k1"))), 1, "b3")
    g = store.graph(spark)
    assert {r.id: r.title for r in g.documents.collect()} == {"d1": "A", "d2": "B2"}
    assert sorted((r.pub_id, r.keyword_id) for r in g.has_keyword.collect()) == [("d1", "k1"), ("d1", "k1"), ("d2", "k3")]
    store.delete(docs(("d1", "", "")).select("id"), 3, "b4")
    g = store.graph(spark)
    assert [r.id for r in g.documents.collect()] == ["d2"] and g.has_keyword.count() == 1 and g.keywords.count() == 3


def test_sessions_close_and_repeats_count_once(spark, tmp_path):
    from datetime import datetime, timedelta

    from termweave.streaming import ingest

    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=m), u, "x", 1.0) for k, (u, m) in enumerate([(1, 0), (1, 20), (1, 55), (2, 5), (2, 34), (2, 65), (1, 500), (None, 10)])]
    events = spark.createDataFrame([*rows, rows[0], rows[3]], ingest.EVENTS)
    ingest.feed(events, str(tmp_path / "in"), 3, jitter=600, end=True)
    found = ingest.session_table(spark, str(tmp_path / "table")).create(spark)
    for _ in range(2):
        ingest.into_table(ingest.sessions(ingest.event_stream(spark, str(tmp_path / "in"), 1)), found, str(tmp_path / "ck")).awaitTermination()
    got = sorted((r.user_id, (r.start - start).seconds // 60, r.n) for r in found.rows(spark).collect())
    assert got == [(1, 0, 2), (1, 55, 1), (1, 500, 1), (2, 5, 2), (2, 65, 1)]


def test_links_of_single_documents_are_not_moved(spark):
    """Links of two classes of one document each come out of the task that finds them: no join reads them."""
    edges = spark.createDataFrame([(d, k) for d in range(30) for k in (d % 5, 5 + d % 3, 9 + d // 3)] + [(40 + d, k) for d in range(3) for k in (1, 6, 9)], "pub_id long, keyword_id long")
    s = setjoin.classes(edges)
    rule = setjoin.Alike(0.05)
    for block in (3, 512):
        every, with_copies, without = ({tuple(r) for r in setjoin.linked_classes(s.sets, rule, block, copies).collect()} for copies in (None, True, False))
        assert with_copies and without and not with_copies & without and with_copies | without == every
    sizes = {r.class_id: r.class_size for r in s.members.collect()}
    assert all(sizes[r[0]] == sizes[r[1]] == 1 for r in without)
