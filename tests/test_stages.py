"""Stages that go on where a run stopped."""

import pytest
from pyspark.sql import functions as F

from termweave.plans.stages import Runner, Stage


class Killed(RuntimeError):
    pass


def stages(calls, version="1", fail=None):
    def made(name, f):
        def run(tables):
            calls.append(name)
            if name == fail:
                raise Killed
            return f(tables)

        return run

    return [
        Stage("corpus", ("docs",), made("corpus", lambda t: t["docs"].filter("length(text) > 1"))),
        Stage("keywords", ("corpus",), made("keywords", lambda t: t["corpus"].select("id", F.explode(F.split("text", " ")).alias("term"))), version),
        Stage("counts", ("keywords", "corpus"), made("counts", lambda t: t["keywords"].join(t["corpus"], "id").groupBy("term").agg(F.count("*").alias("n")))),
    ]


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "x")], "id int, text string").write.parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_killed_run_goes_on(spark, tmp_path, docs):
    whole = Runner(spark, str(tmp_path / "whole"), {"docs": docs}, stages([]))
    assert whole.run() == ["corpus", "keywords", "counts"] and whole.run() == []

    def kill(name):
        if name == "keywords":
            raise Killed

    calls = []
    part = lambda **k: Runner(spark, str(tmp_path / "part"), {"docs": docs}, stages(calls, **k))
    with pytest.raises(Killed):  # between two stages
        part().run(ended=kill)
    with pytest.raises(Killed):  # inside a stage
        part(fail="counts").run()
    with pytest.raises(LookupError):
        part().result("counts")
    assert part().run() == ["counts"] and calls == ["corpus", "keywords", "counts", "counts"]
    for name in ("corpus", "keywords", "counts"):
        assert rows(part().result(name)) == rows(whole.result(name)) and part().manifest(name).rows == whole.manifest(name).rows
    assert rows(whole.result("counts")) == [("a", 1), ("b", 2), ("c", 1)]


def test_changes_run_what_depends_on_them(spark, tmp_path, docs):
    runner = lambda **k: Runner(spark, str(tmp_path / "run"), {"docs": docs}, stages([], **k))
    runner().run()
    assert runner(version="2").run() == ["keywords", "counts"]
    spark.createDataFrame([(9, "c c")], "id int, text string").write.mode("append").parquet(docs)
    assert runner(version="2").run() == ["corpus", "keywords", "counts"]
    assert rows(runner().result("counts")) == [("a", 1), ("b", 2), ("c", 3)]


def test_one_step(spark, tmp_path, docs):
    runner = Runner(spark, str(tmp_path / "run"), {"docs": docs}, stages([]))
    with pytest.raises(LookupError):
        runner.run(only="keywords")
    assert runner.run(only="corpus") == ["corpus"] and runner.run(only="keywords") == ["keywords"] == runner.run(only="keywords")
    assert runner.run() == ["counts"]
    with pytest.raises(ValueError, match="needs"):
        Runner(spark, str(tmp_path), {}, stages([]))
