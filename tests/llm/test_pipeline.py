"""The pipeline's stages, each on what the one before kept."""

import random
from collections import defaultdict

import pytest
from helpers import SF

import corpus_pipeline
from termweave.llm import decontaminate, linededup, neardup, packing, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs.cache()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    assert all(df.columns == columns for df in kept[:-1])
    ids = [[r.doc_id for r in df.select("doc_id").distinct().collect()] for df in kept]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert set(ids[1]) == {r.doc_id for r in quality.quality_scores(docs, labels).filter("keep").collect()}
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(kept[1]).collect()}
    assert sorted(ids[2]) == sorted(set(classes.values()))
    assert sorted(ids[3]) == sorted(ids[2]) and linededup.repeated_spans(kept[2]).count() >= linededup.repeated_spans(kept[3]).count()
    dirty = {r.doc_id for r in decontaminate.contaminated(kept[3], bench).collect()}
    assert set(ids[4]) == set(ids[3]) - dirty
    assert sorted(ids[5]) == sorted(ids[4])
    assert kept[5].agg({"length": "max"}).first()[0] <= packing.LENGTH
    for df in kept:
        df.unpersist()


def words(rng, n):
    return ["".join(rng.choice(["er", "th", "on", "an", "re", "ing", "ou", "st", "le", "ha"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def prose(rng, n):
    w = words(rng, n)
    for at in range(8, n, 11):
        w[at] += "."
    return " ".join(w)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with planted cases, odd rows and columns of odd names; what has to become of them."""
    rng = random.Random(31)
    passage, items = prose(rng, 70), [(k, prose(rng, 40)) for k in range(6)]
    clean = [(k, prose(rng, rng.randint(80, 200))) for k in range(120)]
    junk = [(200 + k, " ".join(rng.choice(["$$$", "||", "1234", "###", "AAAA"]) for _ in range(60))) for k in range(40)]
    copies = [(300 + k, clean[k][1]) for k in range(10)]
    near = []
    for k in range(10, 20):
        w = clean[k][1].split()
        w[rng.randrange(len(w))] = "changed"
        near.append((300 + k, " ".join(w)))
    repeated = [(400 + k, f"{prose(rng, 90)} {passage} {prose(rng, 90)}") for k in range(8)]
    leaks = [(500 + k, f"{prose(rng, 90)} {t} {prose(rng, 90)}") for k, t in items]
    odd = [(None, prose(rng, 100)), (600, None), (601, ""), (602, clean[30][1]), (602, clean[30][1]), (603, prose(rng, 9000))]
    rows = [(i, t, None if i == 77 else "en", None if i == 78 else "src", None if i == 79 or t is None else len(t), 1, "x", 2) for i, t in [*clean, *junk, *copies, *near, *repeated, *leaks, *odd]]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int, content string, _doc int").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:60]] + [(i, 0, 0) for i, _ in junk[:20]] + [(None, 0, 0), (61, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    stay = [i for i, _ in clean] + [i for i, _ in repeated] + [603]
    return path, passage, {i: t for i, t in [*clean, *odd] if i is not None}, stay, [i for i, _ in [*junk, *copies, *near, *leaks]] + [602]


def test_planted_cases(spark, planted):
    from termweave.llm.bpe import word_model

    path, passage, text, stay, go = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
    rows = docs.collect()
    ids = [r.doc_id for r in rows]
    assert set(stay) <= set(ids) and not set(go) & set(ids) and len(ids) == len(set(ids)) and None in ids
    for r in rows:
        if r.doc_id in text and r.doc_id < 120 or r.doc_id == 603:
            assert r.text == text[r.doc_id]
        assert r.n_chars is None or r.n_chars == len(r.text)
    inner = " ".join(passage.split()[12:-12])  # what surely goes of the passage, wherever sentences end
    assert [r.doc_id for r in rows if r.text and inner in r.text] == [400]
    model = word_model(packing.model_path())
    total = {r.doc_id: len(model.library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}
    packed = corpus_pipeline.run(spark, path).collect()
    used, whole = defaultdict(list), defaultdict(int)
    for r in packed:
        used[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id] += r.length
    assert whole == total
    for spans in used.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= packing.LENGTH


def test_empty_tables(spark, planted, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet").filter("doc_id < 30 or doc_id in (205, 503)")
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, path).collect()} == {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, path).collect()}
