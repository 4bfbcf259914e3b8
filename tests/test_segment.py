import pytest

from termweave.operators import segment as S

BODY_RU = "Введение\n" + "В работе рассматривается построение графа знаний для научных статей. " * 8
BODY_EN = "Introduction\n" + "This paper describes the building of a graph of knowledge for articles. " * 8


def cut(spark, text, **options):
    return S.segmented(spark.createDataFrame([("my_paper.pdf", text)], "filename string, full_text string"), **options).first()


def test_standard(spark):
    text = "Построение графов знаний\nИ.И. Иванов, П.П. Петров\nСамарский университет\n\nАннотация: Краткое описание работы.\nКлючевые слова: онтология, граф знаний.\n" + BODY_RU + "\nСписок литературы\n1. Книга"
    r = cut(spark, text)
    assert (r.template, r.status, r.title) == ("B", "ok", "Построение графов знаний")
    assert r.authors == ["И.И. Иванов", "П.П. Петров"]
    assert r.annotation == "Краткое описание работы."
    assert r.keywords == ["онтология", "граф знаний"]
    assert r.main_text.startswith("Введение") and "Книга" not in r.main_text


def test_english_with_russian_summary(spark):
    text = "Building of knowledge graphs\n\nAbstract: Short.\nKeywords: graph, ontology\n" + BODY_EN + "\nАннотация\nКраткое описание.\nКлючевые слова: граф, онтология\nСведения об авторах\nИванов"
    r = cut(spark, text, language_gate=False)
    assert (r.template, r.status, r.annotation) == ("A", "ok", "Краткое описание.")
    assert r.keywords == ["граф", "онтология"]
    assert r.main_text.startswith("Introduction")
    assert cut(spark, text).reason.startswith("Non-Russian article")


def test_english(spark):
    text = "Building of knowledge graphs\n\nAbstract: Short text.\nKeywords: graph, ontology, one more keyword of many, and another one that makes the line long enough, last word\n" + BODY_EN + "\nReferences\n1. Book"
    r = cut(spark, text, language_gate=False)
    assert (r.template, r.annotation, r.status) == ("C", "Short text.", "ok")
    assert r.keywords[:2] == ["graph", "ontology"] and "Book" not in r.main_text


def test_fallback_and_reasons(spark):
    r = cut(spark, "Просто длинный русский текст\n" + "Слова идут одно за другим без разметки. " * 10)
    assert (r.template, r.status, r.title, r.keywords) == ("D", "ok", "Просто длинный русский текст", [])
    assert cut(spark, "мало").reason.startswith("Too little")
    assert cut(spark, "☃" * 300).reason.startswith("Text appears garbled")
    assert cut(spark, "").status == "error"
    assert cut(spark, None).status == "error"


def test_blocks_and_counters(spark):
    rows = [("d", 1, 2, 0.0, 100.0, 0.0, 200.0, "b"), ("d", 1, 1, 0.0, 100.0, 0.0, 200.0, "a"), ("d", 1, 0, 0.0, 10.0, 0.0, 20.0, "head"), ("d", 2, 0, 0.0, 700.0, 0.0, 760.0, "foot")]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    assert S.page_text(blocks).first()["full_text"] == "a\n\nb"
    articles = S.segmented(spark.createDataFrame([("a", "мало"), ("b", "Текст статьи\n" + BODY_RU)], "filename string, full_text string"))
    assert {r.status: r.articles for r in S.counters(articles).collect()} == {"skipped": 1, "ok": 1}
    assert "text_length" in S.corpus_index(articles).columns


@pytest.mark.parametrize("value", ["", None])
def test_no_authors(spark, value):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(value,)], "x string").select(S.authors_of(F.col("x")).alias("a"), S.title_of(F.col("x"), F.lit("a_b.pdf")).alias("t")).first()
    assert r.a == [] and r.t == "a b"


def test_end_of_keywords_without_a_later_line(spark):
    """Where no line ends 100 characters behind the heading, keywords end 200 behind it, as the feature has it, so nothing is left for the body."""
    text = "+++ 1234 5678 +++\n\nAbstract: short\nKeywords: anea, eriner, thanea\n\nknowledge graphs link words knowledge graphs link words \nReferences\n[1] X"
    r = cut(spark, text)
    assert (r.template, r.main_text) == ("C", "")

def test_chars_are_counted_by_runs(spark):
    """The same counts as by single characters, with few matches."""
    from pyspark.sql import functions as F

    from termweave.functions import text as T

    rows = [("",), (None,), ("Слово word 12",), ("☃☃a☃ß\u0001b-\\]^",), ("абв\nabc\tёЁ",)]
    want = lambda x, ok: sum(ok(c) for c in x or "")
    readable = lambda c: 0x400 <= ord(c) <= 0x4FF or c.isascii() and (c.isalnum() or c in " \t\n\r.,;:!?()-\"'/[]{}+=<>@#$%&*_~\\")
    latin = lambda c: c.isascii() and c.isalpha()
    got = spark.createDataFrame(rows, "x string").select("x", T.matching_chars(F.col("x"), T.READABLE).alias("r"), T.matching_chars(F.col("x"), "[a-zA-Z]").alias("l")).collect()
    assert [(r.r, r.l) for r in got] == [(want(x, readable), want(x, latin)) for (x,) in rows]
    plan = spark.range(1).select(T.matching_chars(F.lit("x"), "[a-z]"))._jdf.queryExecution().logical().toString()
    assert "[^abcdefghijklmnopqrstuvwxyz]+" in plan


def test_hyphens_only_where_lines_are_broken(spark):
    from pyspark.sql import functions as F

    from termweave.functions import text as T

    rows = [("кни-\nга про multi-\nagent",), ("a-b c\u0001d",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(T.join_hyphens(F.col("x"))).collect()]
    assert got == ["книга про multi-agent", "a-b c-d", ""]
