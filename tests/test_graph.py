import pytest
from pyspark.sql import functions as F

from termweave.operators import graph as G
from termweave.operators import search as S
from termweave.sources import readers, writers


@pytest.fixture(scope="module")
def articles(spark):
    rows = [
        ("a.pdf", "Alpha", ["X Y"], "about graphs", ["граф знаний", "Граф Знаний", " "], ["граф", "онтология"], []),
        ("b.pdf", "Beta, \"quoted\"\nline", [], "", ["Граф Знаний."], [], ["онтология"]),
        ("c.pdf", "Gamma", [], "", None, None, None),
    ]
    return spark.createDataFrame(rows, "filename string, title string, authors array<string>, annotation string, keywords array<string>, keywords_tfidf array<string>, keywords_keybert array<string>")


@pytest.fixture(scope="module")
def g(articles):
    return G.build(articles)


def test_edges(g):
    edges = {(r.pub_id, r.keyword_id, r.method, r.weight) for r in g.has_keyword.collect()}
    assert ("a.pdf", "граф", "tfidf", 10.0) in edges and ("a.pdf", "онтология", "tfidf", 9.0) in edges
    assert g.has_keyword.filter("keyword_id = 'граф знаний' and pub_id = 'a.pdf'").count() == 2
    assert g.has_keyword.filter("pub_id = 'c.pdf'").count() == 0


def test_weights(spark):
    rows = spark.createDataFrame([("tfidf", 0), ("tfidf", 9), ("keybert", 12), ("author", 5)], "m string, i int")
    assert [r.w for r in rows.select(G.edge_weight(F.col("m"), F.col("i")).alias("w")).collect()] == [10, 1, 1, 1]


def test_spelling(g):
    k = {r.id: r for r in g.keywords.collect()}
    assert k["граф знаний"].name == "Граф Знаний" and k["граф знаний"].methods == ["author"]
    assert k["онтология"].methods == ["keybert", "tfidf"]
    assert {r.id: r.keybert_kw for r in G.labelled(g.keywords).collect()}["онтология"] is True


def test_paths_and_distinct(spark):
    edges = spark.createDataFrame([("d1", "k1", "author", 1.0), ("d1", "k1", "tfidf", 1.0), ("d2", "k1", "author", 1.0)], "pub_id string, keyword_id string, method string, weight double")
    r = G.shared_terms(edges).first()
    assert (r.paths, r.shared) == (2, 1)
    assert G.similar_to(edges).first().score == 1.0
    assert G.both_ways(G.similar_to(edges)).count() == 2


def test_paging():
    assert S.Page.of(1, 15).pages(0) == 1 and S.Page.of(1, 15).pages(31) == 3
    assert S.Page.of(1, 500).size == 50 and S.Page.of(-3).number == 1


def test_search(g):
    assert [r.id for r in S.search_documents(g, "знаний").collect()] == ["a.pdf", "b.pdf"]
    assert S.search_documents(g, "").count() == 3
    assert len(S.search_documents(g, "gamma").first()["keywords"]) == 0
    assert [r.id for r in S.similar_documents(g, "a.pdf").collect()] == ["b.pdf"]
    assert S.ego_network(g, "c.pdf").first()["keyword_id"] is None
    assert S.keyword_facets(g, method="keybert").count() == 1
    assert S.combined_search(g, "g").count() == 0
    assert {r.kind for r in S.combined_search(g, "граф").collect()} == {"keyword"}
    assert S.rows_and_subgraph(g, g.has_keyword).count() == g.has_keyword.count()
    assert S.stats(g).first()["documents"] == 3


def test_round_trip(spark, g, tmp_path):
    writers.graph_csv(g, str(tmp_path))
    docs, words, edges = readers.graph_csv(spark, str(tmp_path))
    assert {r.id: r.title for r in docs.collect()}["b.pdf"] == "Beta, \"quoted\"\nline"
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, g.has_keyword.collect()))
    assert {r.id: sorted(r.methods) for r in words.collect()} == {r.id: sorted(r.methods) for r in g.keywords.collect()}
    writers.graph_tables(g, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/has_keyword")).count() == g.has_keyword.count()
    assert "toFloat(row.weight)" in writers.import_script(similar=True)


def test_upsert_and_endpoints(spark, g):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3)], "id string, v int")
    assert {tuple(r) for r in G.upserted(old, new, "id").collect()} == {("a", 1), ("b", 3)}
    assert G.with_endpoints(g.has_keyword, g.documents.filter("id = 'b.pdf'"), g.keywords).count() == 2
    g.as_views(spark)
    assert spark.sql("select count(*) as n from has_keyword e join keywords_v k on k.id = e.keyword_id").first()["n"] == g.has_keyword.count()


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"filename": "a",\n "title": "T"}')
    r = readers.articles_json(spark, str(tmp_path / "a.json")).first()
    assert (r.title, r.keywords, r.annotation) == ("T", [], "")
    index = spark.createDataFrame([("a",), ("z",)], "filename string")
    full = readers.articles_json(spark, str(tmp_path / "a.json"))
    assert readers.indexed(index, full).count() == 1 and readers.indexed(index, full, keep_missing=True).count() == 2
    for name in ("x.pdf", "y.PDF", "z.txt"):
        (tmp_path / name).write_text("x")
    assert readers.listing(spark, str(tmp_path)).count() == 2 and readers.listing(spark, str(tmp_path), first=1).count() == 1
    html = '<p><strong><a href="/i/1.pdf">x</a></strong></p><p><a href="/n.pdf">y</a></p><div class="elementor-widget-container"><a href="/issue"><img src="i"></a></div><div class="elementor-widget-container"><a href="/no">t</a></div>'
    page = spark.createDataFrame([(html,)], "html string")
    got = page.select(readers.issue_links(F.col("html")).alias("i"), readers.archive_links(F.col("html")).alias("a"), readers.links(F.col("html")).alias("l")).first()
    assert (got.i, got.a, len(got.l)) == (["/i/1.pdf"], ["/issue"], 4)
    last = readers.last_of_each(spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, o int, v string"), "k", "o").first()
    assert last.v == "new"
    (tmp_path / "w.txt").write_text("The\n\nand\n")
    assert readers.stopword_list(spark, str(tmp_path / "w.txt")) == ("and", "the")
    assert readers.settings("# c\nA=1=2\n\nB=3\nbad", {"B": "0"}) == {"A": "1=2", "B": "0"}


def test_streaming(spark, tmp_path):
    from termweave.streaming import ingest

    spark.createDataFrame([(1, "a" * 200), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    run()
    assert {r.doc_id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "ok", 2: "skipped"}


def test_hubs_are_split(spark):
    import random

    rng = random.Random(1)
    rows = [(f"d{rng.randrange(40):02}", f"k{min(rng.randrange(30), 12)}") for _ in range(400)]
    edges = spark.createDataFrame(rows, "pub_id string, keyword_id string")
    count = {}
    for d, k in rows:
        count[d, k] = count.get((d, k), 0) + 1
    want = {}
    for (a, k), m in count.items():
        for (b, j), n in count.items():
            if k == j and a < b:
                p, s = want.get((a, b), (0, 0))
                want[a, b] = (p + m * n, s + 1)
    for hub in (3, 2048):
        assert {(r.d1, r.d2): (r.paths, r.shared) for r in G.shared_terms(edges, hub=hub).collect()} == want
    assert G.shared_terms(edges, ordered=False, hub=5).count() == 2 * len(want)


def test_pairs_of_two_common_keywords(spark):
    """The same pairs as by single keywords, with hubs, long documents, parallel edges and nulls."""
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(30), min(rng.randrange(60), rng.randrange(60))) for _ in range(300)] + [(50, k) for k in range(40)] + [(51, k) for k in range(20, 60)] + [(60, 99), (60, 99), (61, 99), (61, 99), (62, 99), (None, 1), (3, None)]
    edges = spark.createDataFrame(rows, "pub_id long, keyword_id long")
    one = edges.groupBy("pub_id", "keyword_id").agg(F.count("*").alias("n"))
    every = {tuple(r) for r in G.shared_terms(edges).collect()}
    for hub, long in ((3, 25), (2048, 48), (2048, 1)):
        assert sorted(map(tuple, G.pairs_sharing_two(one, hub, long).collect())) == sorted(r for r in every if r[3] > 1)
    for least in (2, 3, 4):
        assert sorted(map(tuple, G.pairs_of_paths(one, least).collect())) == sorted(r for r in every if r[2] >= least)


def test_dangling_edges_go(spark):
    edges = spark.createDataFrame([("a", "k", "x", 1.0), ("a", "k", "x", 1.0), ("a", "gone", "x", 1.0), ("gone", "k", "x", 1.0), (None, "k", "x", 1.0)], "pub_id string, keyword_id string, method string, weight double")
    docs, words = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("k",)], "id string")
    assert [tuple(r) for r in G.with_endpoints(edges, docs, words).select("pub_id", "keyword_id").collect()] == [("a", "k")] * 2


def test_links_and_script(spark, g, tmp_path):
    links = spark.createDataFrame([("a.pdf", "b.pdf", 0.5), ("c.pdf", "a.pdf", 0.25)], "source string, target string, score double")
    full = G.Graph(g.documents, g.keywords, g.has_keyword, links)
    writers.graph_csv(full, str(tmp_path))
    assert sorted(map(tuple, readers.similar_csv(spark, str(tmp_path)).collect())) == sorted(map(tuple, links.collect()))
    assert {tuple(r) for r in G.similar_of(links, "a.pdf").collect()} == {("b.pdf", 0.5), ("c.pdf", 0.25)}
    assert S.stats(full).first()["similar"] == 2
    script = writers.import_script(similar=True)
    assert script.count("LOAD CSV") == 4 and writers.import_script().count("LOAD CSV") == 3
    for p in ("title", "annotation", "summary_tfidf", "summary_keybert", "name", "methods"):
        assert f"x.{p} = row.{p}" in script
    authors = spark.createDataFrame([("a.pdf", ["X"]), ("z", ["Y"])], "id string, authors array<string>")
    page = S.with_authors(g.documents.select("id"), authors)
    assert {r.id: r.authors for r in page.collect()} == {"a.pdf": ["X"], "b.pdf": [], "c.pdf": []}


def test_lemmas_join_keywords(spark, articles):
    lex = spark.createDataFrame([("графы", "граф", None), ("онтологии", "онтология", None)], "token string, lemma string, pos string")
    other = articles.withColumn("keywords", F.array(F.lit("Онтологии и графы"), F.lit("графы")))
    ids = {r.keyword_id for r in G.build(other, lexicon=lex).has_keyword.filter("method = 'author'").collect()}
    assert ids == {"граф и онтология", "граф"}


def test_pager_and_paths(g):
    assert S.Page.of(1).window(15) == [] and S.Page.of(8).window(300) == [1, None, 5, 6, 7, 8, 9, 10, 11, None, 20]
    assert S.Page.of(5).window(106) == [1, 2, 3, 4, 5, 6, 7, 8]
    path = S.paths(g, g.has_keyword, 1).first()["path"]
    assert [p.kind for p in path] == ["document", "edge", "keyword"] and path[0].id == "a.pdf"


def test_scratch_folder(spark):
    from types import SimpleNamespace

    from termweave.sources import scratch

    conf = SimpleNamespace(get=lambda *a: None)
    made = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(made("spark://host:7077"))
    assert scratch.shared_folder(made("local[4]")).startswith("file://")
    table = scratch.stored(spark.range(3), "x")
    assert table.count() == 3
    scratch.dropped(table)
    assert not spark._jvm.java.io.File(table._termweave_path.removeprefix("file://")).exists()


def test_repeated_keys_in_a_batch(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 2), ("b", 9, 1), ("c", 4, 1), ("c", 5, 1)], "id string, v int, seq int")
    assert sorted(map(tuple, G.upserted(old, new, "id", "seq").collect())) == [("a", 1), ("b", 3), ("c", 5)]
    assert sorted(map(tuple, G.upserted(old, new.drop("seq"), "id").collect())) == [("a", 1), ("b", 9), ("c", 5)]


def test_pager_columns(spark):
    rows = [(p, n) for n in (1, 2, 7, 8, 9, 30) for p in range(1, n + 1)]
    table = spark.createDataFrame(rows, "p int, n int")
    got = {(r.p, r.n): r.w for r in table.select("p", "n", S.window_column(F.col("p"), F.col("n")).alias("w")).collect()}
    assert got == {(p, n): S.Page.of(p, 15).window(15 * n) for p, n in rows}


def test_settings_table(spark):
    lines = [" # c", "A=1=2", "", "B = 3 ", "bad", "A=9", "=x"]
    table = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    present = spark.createDataFrame([("B", "0"), ("C", "y")], "key string, value string")
    got = {r.key: r.value for r in readers.settings_table(table, ["i"], present).collect()}
    assert got == readers.settings("\n".join(lines), {"B": "0", "C": "y"}) == {"A": "1=2", "B": "0", "C": "y", "": "x"}


def test_search_by_index(spark, g, tmp_path):
    index = S.SearchIndex.of(g, str(tmp_path))
    ids = lambda df: sorted(r.id for r in df.collect())
    for query in ("знаний", "ГРАФ", "gamma", "a", "ab", "graphs", "\nline", "zz", " "):
        assert ids(S.matching_documents(g, query, index)) == ids(S.matching_documents(g, query))
        assert ids(S.keyword_facets(g, query, index=index)) == ids(S.keyword_facets(g, query))
        assert sorted(map(tuple, S.combined_search(g, query, index=index).collect())) == sorted(map(tuple, S.combined_search(g, query).collect()))
    assert [r.id for r in S.search_documents(g, "знаний", index=index).collect()] == ["a.pdf", "b.pdf"]


def test_links_of_one_document(spark):
    """The same links as of all documents, found without the pairs of others."""
    rows = [(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "a"), (4, "b"), (5, None), (None, "a"), (0, "a")]
    edges = spark.createDataFrame(rows, "pub_id long, keyword_id string")
    from termweave.operators import graph

    for one in (1, 3, 5, 9):
        for least in (0.0, 0.4, 1.0):
            want = graph.similar_to(edges, least).filter(f"source = {one} or target = {one}")
            assert sorted(graph.similar_to_one(edges, one, least).collect()) == sorted(want.collect())
