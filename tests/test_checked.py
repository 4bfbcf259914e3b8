"""Broken JSON, short and long CSV rows, missing files; and joins of stored tables without exchanges."""

from pyspark.sql import functions as F

from termweave.operators import graph
from termweave.sources import checked, layout


def test_json_lines(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1, "title": "A", "tags": ["x"]}\n\n{"id": 2, "title": "cut\n{"id": "no number"}\n[1]\n{"title": "keyless"}\n{"id": 3, "other": 1}\n')
    (folder / "b.json").write_text("not json\n")
    found = checked.json_lines(spark, str(folder), "id long, title string, tags array<string>", "id")
    assert sorted((r.id, r.title) for r in found.good.collect()) == [(1, "A"), (3, None)]
    bad = sorted((r.file, r.reason, r.record) for r in found.bad.collect())
    assert [x[:2] for x in bad].count(("a.json", "unreadable")) == 3 and ("b.json", "unreadable", "not json") in bad
    assert ("a.json", "no key", '{"id":null,"title":"keyless","tags":null}') in bad and ("a.json", "unreadable", '{"id": 2, "title": "cut') in bad
    assert {(r.file, r.status): r.n for r in found.counters().collect()} == {("a.json", "ok"): 2, ("a.json", "unreadable"): 3, ("a.json", "no key"): 1, ("b.json", "unreadable"): 1}
    for batch in ("one", "two", "one"):
        found.quarantine(str(tmp_path / "bad"), batch)
    assert spark.read.parquet(str(tmp_path / "bad")).groupBy("batch").count().filter("count = 5").count() == 2


def test_csv_rows(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "k.csv").write_text('id,name,n\na,"two\nlines, ""quoted""",1\nb,short\nc,x,2,long\n,no key,3\nd,y,seven\ne,,\n')
    found = checked.csv_rows(spark, str(folder), "id string, name string, n int", "id")
    assert sorted((r.id, r.name, r.n) for r in found.good.collect()) == [("a", 'two\nlines, "quoted"', 1), ("e", None, None)]
    assert sorted((r.reason, r.record.split(",")[0]) for r in found.bad.collect()) == [("no key", '{"id":null'), ("unreadable", "b"), ("unreadable", "c"), ("unreadable", "d")]


def test_missing_files_and_empty_folders(spark, tmp_path):
    for name in ("x.json", "y.json"):
        (tmp_path / name).write_text("{}")
    index = spark.createDataFrame([("x.json",), ("z.json",)], "filename string")
    assert [r.filename for r in checked.missing(index, str(tmp_path)).collect()] == ["z.json"]
    (tmp_path / "none").mkdir()
    nothing = checked.json_lines(spark, str(tmp_path / "none"), "id long", "id")
    assert nothing.good.count() == nothing.bad.count() == nothing.counters().count() == 0


def test_joins_of_stored_tables_move_no_edges(spark, tmp_path):
    edges = spark.createDataFrame([(f"d{k % 20}", f"k{k % 7}", "author", 1.0) for k in range(100)], "pub_id string, keyword_id string, method string, weight double")
    documents = spark.createDataFrame([(f"d{k}", f"T{k}", "") for k in range(20)], "id string, title string, annotation string")
    keywords = spark.createDataFrame([(f"k{k}", f"K{k}", ["author"]) for k in range(6)], "id string, name string, methods array<string>")
    g = graph.Graph(documents, keywords, edges)
    store = layout.write(g, "test_layout", str(tmp_path), buckets=4)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plain = lambda df: sorted(map(str, df.collect()))
        for got, want in ((store.expanded_keywords(), edges.join(keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id")), (store.expanded_documents(), edges.join(documents.select(F.col("id").alias("pub_id"), "title"), "pub_id"))):
            assert plain(got.select(*sorted(want.columns))) == plain(want.select(*sorted(want.columns)))
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        hops = store.two_hops()
        want = edges.join(edges.select("keyword_id", F.col("pub_id").alias("d2")), "keyword_id").filter("pub_id < d2").groupBy(F.col("pub_id").alias("d1"), "d2").agg(F.count("*").alias("paths"))
        assert plain(hops.select("d1", "d2", "paths")) == plain(want)
        assert hops._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # of the pairs' sums, none of edges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        store.drop()
