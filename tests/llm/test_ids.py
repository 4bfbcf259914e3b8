"""Rows that share an id or have none."""

from helpers import same_as_sql

from termweave.llm import neardup, topk


def test_a_class_is_kept_by_a_row_with_an_id(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(None, text), (9, text), (7, text + " end"), (None, "alone " + text[::-1])], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.keep) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(None, 7, False), (9, 7, False), (7, 7, True), (None, None, True)}
    assert sorted((r.doc_id for r in neardup.deduplicated(docs).collect()), key=str) == [7, None]


def test_every_query_row_is_answered(spark, tmp_path):
    rows = [(20, [1.0, 2.0], 0), (20, [3.0, 0.0], 0), (40, [1.0, 1.0], 0), (1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (2, [-1.0, 4.0], 0), (None, [1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    folder = tmp_path / "only"
    folder.mkdir()
    (tmp_path / "embeddings.parquet").rename(folder / "embeddings.parquet")
    got = topk.op5_exact_topk(spark, str(folder))
    same_as_sql(got, topk.OP5_SQL, str(folder))
    assert got.filter("query_id = 20").count() == 8
