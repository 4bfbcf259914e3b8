from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import evaluate, lexicon, semantic, summarize, tfidf


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("broken", "joined"), [
    ("научно-\nтехнический", "научно-технический"), ("инфор-\nмация", "информация"), ("веб-\nсайт", "веб-сайт"), ("коро-\nткого", "коро-ткого"),
    ("multi-\nagent", "multi-agent"), ("know-\nledge", "knowledge"), ("plain text", "plain text"), (None, ""),
])
def test_hyphens(spark, broken, joined):
    assert one(spark, broken, T.join_hyphens) == joined


@pytest.mark.parametrize(("text", "squeezed"), [("a\nb\n\n  c \n\n\nd", "a b\n\nc\n\nd"), ("", ""), (None, ""), (" ¶xy ", "xy")])
def test_spacing(spark, text, squeezed):
    assert one(spark, text, T.squeeze_spacing) == squeezed


def test_keyword_list(spark):
    assert one(spark, "Онтология, Граф знаний;  doi: 10.1.", T.keyword_list) == ["онтология", "граф знаний"]
    assert one(spark, None, T.keyword_list) == []


def test_gates(spark):
    assert one(spark, "a" * 99, T.is_readable) is False
    assert one(spark, "a" * 100, T.is_readable) is True
    assert one(spark, "абвde", T.is_in_script) is True
    assert one(spark, "", T.is_in_script) is False
    assert one(spark, "123", T.is_in_script) is False
    assert one(spark, "ab", T.is_valid_title) is False
    assert one(spark, "Онтология", T.is_valid_title) is True


def test_sentences(spark):
    assert one(spark, "Рис. 1 показан. Далее текст! См. рис. 2. Конец.", T.sentences) == ["Рис. 1 показан", "Далее текст", "См. рис. 2", "Конец."]
    assert one(spark, None, T.sentences) == []
    counts = {7: 0, 8: 1, 60: 1, 61: 0}
    for n, kept in counts.items():
        found = one(spark, " ".join(["слово"] * n), lambda x: T.numbered_sentences(T.sentences(x)))
        assert len(found) == kept


def test_phrase_ids(spark):
    assert one(spark, "Web 2.0 граф", T.phrase_id) == "0 2 web граф"
    assert one(spark, "Web 2.0 граф", lambda x: T.phrase_id(x, keep_digits=False)) == "web граф"


def test_metrics(spark):
    case = spark.createDataFrame([(["a b", "a b", "c"], ["a b"]), (["a b", "c"], ["a b c"]), ([], ["a"])], "f array<string>, w array<string>")
    exact = [tuple(r["m"]) for r in case.select(T.exact_metrics(F.col("f"), F.col("w"), 5).alias("m")).collect()]
    assert exact[0] == pytest.approx((2 / 3, 2.0, 1.0)) and exact[2] == (0, 0, 0)
    soft = [tuple(r["m"]) for r in case.select(T.soft_metrics(F.col("f"), F.col("w"), 5).alias("m")).collect()]
    assert soft[1] == pytest.approx((1 / 2, 2 / 3, 4 / 7))


def test_rouge(spark):
    pair = spark.createDataFrame([("p", list("abca"), list("aad"))], "pair_id string, cand array<string>, ref array<string>")
    assert tuple(evaluate.rouge_n(pair, 1).first())[1:] == pytest.approx((1 / 2, 2 / 3, 4 / 7))
    assert tuple(evaluate.rouge_n(pair, 2).first())[1:] == (0, 0, 0)
    assert tuple(evaluate.rouge_l(pair).first())[1:] == pytest.approx((1 / 2, 2 / 3, 4 / 7))
    assert evaluate.rouge_l(spark.createDataFrame([("p", [], ["a"])], pair.schema)).first()["f1"] == 0


def test_tfidf(spark):
    docs = [(1, "xx"), (1, "xx"), (1, "yy"), (2, "xx"), (2, "zz"), (3, "yy"), (3, "zz"), (3, "zz")]
    tf = tfidf.term_counts(spark.createDataFrame(docs, "doc_id long, term string"))
    found = {(r.doc_id, r.term): r.weight for r in tfidf.top_terms(tfidf.weights(tf, spark.range(3))).collect()}
    assert found[1, "xx"] == pytest.approx(0.894427, abs=1e-6) and found[1, "yy"] == pytest.approx(0.447214, abs=1e-6)


def test_redundancy(spark):
    assert one(spark, ["граф", "граф знаний", "онтология"], semantic.without_redundant, "array<string>") == ["граф", "онтология"]


def test_display(spark):
    assert one(spark, "граф ЗНАНИЙ", T.upper_first) == "Граф ЗНАНИЙ"
    assert one(spark, 0.256, T.percent, "double") == "26%"
    assert one(spark, "my_file.v2.pdf", T.stem_of) == "my file.v2"
    assert one(spark, ["tfidf", "author"], T.method_style, "array<string>") == "#10b981"


@pytest.mark.parametrize("count", range(9))
def test_summary_size(count):
    picked = summarize.chosen_sentences([{str(i), "x"} for i in range(count)], [float(i) for i in range(count)])
    assert len(picked) == [0, 1, 1, 2, 2, 3, 3, 4, 4][count] and len(set(picked)) == len(picked)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=1, max_size=9))
def test_first_pick_is_the_best(scores):
    assert summarize.chosen_sentences([{str(i)} for i in range(len(scores))], scores)[0] == scores.index(max(scores))


def test_lexicon(spark):
    words = spark.createDataFrame([("кошки",), ("кошки",), ("бежать",)], "token string")
    lex = lexicon.lexicon_of(words, lambda w: (w[:4], "VERB" if w == "бежать" else "NOUN"))
    assert {(r.token, r.lemma, r.pos) for r in lex.collect()} == {("кошки", "кошк", "NOUN"), ("бежать", "бежа", "VERB")}
    phrases = spark.createDataFrame([("кошки",), ("бежать",), ("the cat",), ("xy",)], "phrase string")
    assert [r.phrase for r in lexicon.valid_keywords(phrases, lex).collect()] == ["кошки"]
    docs = spark.createDataFrame([(1, "Кошки и я -бежать- вкл")], "doc_id long, text string")
    assert Counter(r.lemma for r in lexicon.lemmas(docs, F.col("text"), lex).collect())["кошк"] == 1


def test_semantic_keywords_by_brute_force(spark):
    """Each document alone, with plain loops over the vectors."""
    import numpy as np

    texts = {1: "graphs of knowledge link words and documents by the words of a graph", 2: "", 3: None, 4: "one", 5: "the of and", 6: "alpha beta alpha gamma beta delta alpha"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    embed = semantic.hashed_ngram_embedder()
    stop = set(lexicon.P.UNICODE.stopwords)
    got = {}
    for r in semantic.semantic_keywords(docs, lexicon.is_valid_keyword, k=4).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.phrase)
    for i, t in texts.items():
        w = [x for x in (t or "").split() if len(x) >= 2 and x not in stop]
        phrases = list(dict.fromkeys([*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]))
        chosen = []
        if phrases:
            doc, vectors = embed([t])[0], embed(phrases)
            while len(chosen) < min(25, len(phrases)):
                score = [-9 if p in chosen else (0.45 * float(vectors[p] @ doc) - 0.55 * max(float(vectors[p] @ vectors[c]) for c in chosen)) if chosen else float(vectors[p] @ doc) for p in range(len(phrases))]
                chosen.append(int(np.argmax(np.round(score, 12))))
        kept = []
        for p in (phrases[c] for c in chosen):
            if all(len(x) >= 3 for x in p.split()) and len(kept) < 4 and not any(p in e or e in p for e in kept):
                kept.append(p)
        assert got.get(i, []) == kept


def test_russian_profile(spark):
    docs = spark.createDataFrame([(1, "Для статьи и модели онтология из-за анализ всех граф")], "doc_id long, text string")
    found = [r.lemma for r in lexicon.lemmas(docs, F.col("text"), profile=lexicon.P.RUSSIAN).orderBy("pos_in_text").collect()]
    assert found == ["статьи", "модели", "онтология", "граф"]
    assert len(lexicon.P.RUSSIAN_STOPWORDS) + len(lexicon.P.RUSSIAN_DOMAIN_STOPWORDS) == len({*lexicon.P.RUSSIAN_STOPWORDS, *lexicon.P.RUSSIAN_DOMAIN_STOPWORDS})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    from termweave.functions.sequences import common_subsequence

    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert common_subsequence(a, b) == row[-1]


def test_counted_terms(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    rows = [(1, ["b", "a", "b", "é", "b"]), (2, []), (3, None), (4, ["x"]), (5, ["a", "a"]), (None, ["n", "n"])]
    docs = spark.createDataFrame(rows, "doc_id long, w array<string>").select("doc_id", F.col("w").alias("words"))
    got = sorted(map(str, tfidf.counted_terms(docs, F.col("words")).collect()))
    want = [(d, t, n) for d, w in rows for t, n in Counter(w or []).items()]
    assert got == sorted(f"Row(doc_id={d}, term={t!r}, tf={n})" for d, t, n in want)


def test_batches_go_in_pieces():
    """Of long arrays few rows are Python objects at once; no row is lost or cut."""
    import pyarrow as pa

    from termweave.functions.sequences import pieces

    lists = [["a"] * n for n in (3, 0, 9, 1, 1, 30, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], names=["i", "x"])
    got = [p.column(0).to_pylist() for p in pieces(batch, (1,), 10)]
    assert got == [[0, 1], [2, 3], [4], [5], [6, 7]] and sum(got, []) == list(range(8))
    assert list(pieces(batch.slice(0, 0), (1,), 10)) == []


def test_top_of_documents(spark):
    """Counted in batches of any size, the same terms in the same order as by a row a document and term."""
    import random

    rng = random.Random(3)
    words = ["straße", "ÉTÉ", "x", "a1", "граф", "Ωmega", "der", "die", "ab", "ba", "n²", "zz"]
    texts = [None, "", " ", "x", "ab,ab ba", "x-y_z"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) + "." for _ in range(40)]
    for rows in (texts, texts[:4], texts[4:5], texts[4:6], []):
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
        pairs = tfidf.counted_terms(docs, F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 2))
        want = tfidf.top_terms(tfidf.weights(pairs, docs.select("doc_id")), 4)
        for most in (1, 100, tfidf.BYTES):
            got = tfidf.top_of_documents(docs, F.col("text"), 4, most=most)
            assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_large_rows_of_the_tfidf_step(spark, monkeypatch):
    """What documents ask with lies in small row groups: neither writing nor reading holds a task's whole part."""
    import glob

    import pyarrow.parquet as pq

    from termweave.operators import tfidf

    found = []

    def kept(df):
        for f in glob.glob(df._termweave_path.removeprefix("file:") + "/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            found.extend(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups))

    monkeypatch.setattr(tfidf, "dropped", kept)
    words = F.transform(F.sequence(F.lit(0), F.lit(1_999)), lambda i: F.substring(F.sha1(((F.col("doc_id") * 2_000 + i) % 300_000).cast("string")), 1, 8))
    docs = spark.range(0, 750, 1, 1).withColumnRenamed("id", "doc_id").select("doc_id", F.array_join(words, " ").alias("text"))
    assert tfidf.top_of_documents(docs, F.col("text"), 2, most=1 << 20).count() == 1_500
    assert sum(found) > 24_000_000 and max(found) < 22_000_000


def test_summaries_of_long_texts_come_in_small_batches(spark):
    """A batch's words are Python objects, so a worker gets a few megabytes at once; the summaries stay the same."""
    from termweave.functions.sequences import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    sentence = "Alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([(i, f"{sentence} {i}. " * 3 + f"Graph {sentence}.", ["graph"]) for i in range(3)], "doc_id long, text string, keywords array<string>")
    made = summarize.summaries(docs)
    assert int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES
    assert {r.summary for r in made.collect()} and made.filter("summary like '%Graph Alpha%'").count() == 3
