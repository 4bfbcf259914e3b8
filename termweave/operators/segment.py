"""Articles from extracted text: layout, sections, titles, authors, keywords, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import profiles as P
from termweave.functions import text as T

INITIALS = "[А-ЯЁA-Z]\\s*\\.\\s*[А-ЯЁA-Z]\\s*\\."
# Section headings.
HEADINGS_REFERENCES = ("^\\s*список\\s+источников\\s*$", "^\\s*список\\s+использованной\\s+литературы\\s*$", "^\\s*список\\s+литературы\\s*$", "^\\s*литература\\s*$", "^\\s*references\\s*$")
HEADINGS_SHORT = ("^\\s*references\\s*$", "^\\s*список\\s+литературы\\s*$", "^\\s*литература\\s*$", "^\\s*список\\s+источников\\s*$")
AFTER_KEYWORDS = (*HEADINGS_REFERENCES, "сведения\\s+об\\s+авторах", "about\\s+the\\s+authors")
BODY_STANDARD = ("\\bвведение\\b", "\\bцитирование\\b", "\\bдля\\s+цитирования\\b", "\\bконфликт\\s+интересов\\b", "^\\s*1\\s+[а-яА-Яa-zA-Z]+")
BODY_ENGLISH = ("\\bintroduction\\b", "\\bвведение\\b", "^\\s*1\\s+[a-zA-Z]+")


def page_text(blocks: DataFrame, top: float = 70, bottom: float = 755) -> DataFrame:
    """doc_id, full_text from layout blocks; running heads and feet are left out."""
    inside = blocks.filter((F.col("y0") >= top) & (F.col("y1") <= bottom))
    ordered = F.array_sort(F.collect_list(F.struct("page", "block_no", "text")))
    return inside.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("full_text"))


def _lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(T.some(block), "\n"), T.strip), lambda x: x != "")


def title_of(block: Column, filename: Column) -> Column:
    good = F.filter(_lines(block), lambda x: (F.length(x) >= 10) & ~T.bound(F.lower(x), lambda y: T.noisy(y, P.TITLE_NOISE)))
    return F.coalesce(F.get(good, F.lit(0)), T.stem_of(filename))


def authors_of(block: Column) -> Column:
    lines = F.filter(_lines(block), lambda x: (F.length(x) <= 200) & x.rlike(f"(?U){INITIALS}") & ~T.bound(F.lower(x), lambda y: T.noisy(y, P.AUTHOR_NOISE)))
    clean = F.transform(lines, lambda x: T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[¹²³⁴⁵⁶⁷⁸⁹⁰]+", ""), "(?U)\\d+(?=[А-ЯЁA-Z])", ""), "(?U)\\s+", " ")))
    parts = F.transform(F.flatten(F.transform(clean, lambda x: F.split(x, "(?U)\\s*,\\s*"))), T.strip)
    named = F.filter(parts, lambda p: p.rlike(f"(?U){INITIALS}") & (F.length(p) > 3))
    tidy = F.transform(named, lambda p: F.regexp_replace(F.btrim(F.regexp_replace(F.replace(p, F.lit("_"), F.lit(" ")), "(?U)\\s+", " "), F.lit(" ,.")), "[0-9]", ""))
    return F.filter(tidy, lambda p: p != "")


def _at(text: Column, pattern: str) -> Column:
    """1-based place of the first match, 0 if there is none."""
    return F.regexp_instr(text, F.lit(f"(?iUm){pattern}"))


def _after(text: Column, patterns: tuple[str, ...], place: Column) -> Column:
    """1-based place of the first match of any pattern beyond ``place``; null if there is none."""
    # the character at the place is kept only as a line's end, so that ^ keeps its meaning
    edge = F.when(place > 0, F.when(F.substring(text, place, F.lit(1)) == "\n", "\n").otherwise("\u0002")).otherwise("")
    rest = F.concat(edge, F.substring(text, place + 1, F.length(text)))
    found = []
    for p in patterns:
        k = _at(rest, p)
        found.append(F.when(k > 0, F.when(place > 0, place + k - 1).otherwise(k)))
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def _newline(text: Column, place: Column, otherwise: Column) -> Column:
    """1-based place of the first newline at ``place`` or later."""
    k = F.locate("\n", F.substring(text, place, F.length(text)))
    return F.when(k > 0, place + k - 1).otherwise(otherwise)


def _between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start, F.greatest(end - start, F.lit(0)))


def _lead(text: Column) -> Column:
    return T.strip(F.regexp_replace(T.strip(text), "(?U)^[:\\s\\-.]+", ""))


def _recut(body: Column, word: str) -> Column:
    """From a line that begins with the word, else from the word near the start, else all."""
    line = _at(body, f"^\\s*(?:\\d+[\\s.\\-]+)?{word}\\b")
    near = _at(F.substring(body, 1, 1500), f"\\b{word}\\b")
    return T.strip(F.when(line > 0, F.substring(body, line, F.length(body))).when(near > 0, F.substring(body, near, F.length(body))).otherwise(body))


def segmented(texts: DataFrame, language_gate: bool = True) -> DataFrame:
    """Articles from (filename, full_text): template, sections, status and reason.

    Templates: A English article with a Russian summary behind, B standard
    Russian, C English markers, D neither.  The first gate that fails names the
    reason; the language gate may be left out.
    """
    t = F.col("t")
    step = T.held(texts, "filename", t=T.join_hyphens(F.col("full_text")))
    step = T.held(
        step, "filename", "t",
        n=F.length(t), ru_a=_at(t, "\\bаннотация\\b"), ru_k=_at(t, "\\bключевые\\s+слова\\b"), en_a=_at(t, "\\babstract\\b"), en_k=_at(t, "\\bkeywords\\b|\\bkey\\s+words\\b"),
        ru_k_len=F.length(F.regexp_extract(t, "(?iU)\\bключевые\\s+слова\\b", 0)), en_k_len=F.length(F.regexp_extract(t, "(?iU)\\bkeywords\\b|\\bkey\\s+words\\b", 0)),
    )
    c = F.col
    is_a = (c("ru_a") > 0) & (c("ru_k") > 0) & (c("ru_a") - 1 > 0.5 * c("n")) & (c("en_a") > 0) & (c("en_a") - 1 < 0.3 * c("n"))
    is_b = (c("ru_a") > 0) & (c("ru_k") > c("ru_a"))
    is_c = (c("en_a") > 0) & (c("en_k") > c("en_a"))
    step = T.held(step, *step.columns, template=F.when(is_a, "A").when(is_b, "B").when(is_c, "C").otherwise("D"))
    k = c("template")
    # where the search for the body begins (1-based places)
    from_a = F.when(c("en_k") > 0, c("en_k") + c("en_k_len")).otherwise(c("en_a") + 100)
    body_a = F.coalesce(_after(t, BODY_ENGLISH, from_a), _newline(t, from_a + 100, from_a + 100))
    body_b = F.coalesce(_after(t, BODY_STANDARD, c("ru_k")), _newline(t, c("ru_k") + 150, c("ru_k") + 150))
    end_c = _newline(t, c("en_k") + 100, c("en_k") + 200)
    step = T.held(step, *step.columns, body=F.when(k == "A", body_a).when(k == "B", body_b).when(k == "C", end_c).otherwise(F.lit(1)))
    keys_a = F.coalesce(_after(t, AFTER_KEYWORDS, c("ru_k")), _newline(t, c("ru_k") + 150, c("ru_k") + 150))
    step = T.held(
        step, *step.columns,
        keys_end=F.when(k == "A", keys_a).otherwise(c("body")),
        body_end=F.when(k == "A", c("ru_a")).when(k == "B", F.coalesce(_after(t, HEADINGS_REFERENCES, c("body")), c("n") + 1)).when(k == "C", F.coalesce(_after(t, HEADINGS_SHORT, c("body")), c("n") + 1)).otherwise(F.coalesce(_after(t, HEADINGS_SHORT, F.lit(0)), c("n") + 1)),
    )
    block = F.when(k.isin("A", "C"), T.strip(F.substring(t, F.lit(1), c("en_a") - 1))).when(k == "B", T.strip(F.substring(t, F.lit(1), c("ru_a") - 1))).otherwise(F.substring(t, 1, 500))
    raw_abstract = F.when(k == "A", _between(t, c("ru_a") + 9, c("ru_k"))).when(k == "B", _between(t, c("ru_a") + 9, c("ru_k"))).when(k == "C", _between(t, c("en_a") + 8, c("en_k"))).otherwise(F.lit(""))
    raw_keys = F.when(k.isin("A", "B"), _between(t, c("ru_k") + c("ru_k_len"), c("keys_end"))).when(k == "C", _between(t, c("en_k") + c("en_k_len"), c("keys_end"))).otherwise(F.lit(""))
    raw_body = T.strip(_between(t, c("body"), c("body_end")))
    body = F.when(k == "A", _recut(raw_body, "introduction")).when(k == "B", _recut(raw_body, "введение")).otherwise(raw_body)
    step = T.held(step, "filename", "template", "n", block=block, raw_abstract=_lead(raw_abstract), raw_keys=_lead(raw_keys), raw_body=body)
    out = T.held(
        step, "filename", "template", "n",
        title=title_of(c("block"), c("filename")), authors=authors_of(c("block")), annotation=T.squeeze_spacing(c("raw_abstract")),
        keywords=F.when(k == "D", F.array().cast("array<string>")).otherwise(T.keyword_list(c("raw_keys"))), main_text=T.squeeze_spacing(c("raw_body")),
    )
    short = F.substring("title", 1, 50)
    # The reasons' texts.
    reason = (
        F.when(c("n") == 0, F.lit("No text content found after filtering headers/footers"))
        .when(k.isin("C", "D") & (F.length("main_text") < 200), F.lit("Too little text content to extract anything useful"))
        .when(~T.is_readable(c("main_text")), F.lit("Text appears garbled (encoding issue)"))
        .when(~T.is_valid_title(c("title")), F.concat(F.lit("Title appears garbled: "), short))
    )
    if language_gate:
        reason = reason.when(~T.is_in_script(c("main_text")), F.concat(F.lit("Non-Russian article: "), short))
    out = T.held(out, *out.columns, reason=reason)
    status = F.when(c("reason").isNull(), "ok").when(c("n") == 0, "error").otherwise("skipped")
    return out.withColumn("status", status).drop("n")


def corpus_index(articles: DataFrame) -> DataFrame:
    """The articles without their text, but its length."""
    return articles.select("filename", "title", "authors", "annotation", "keywords", F.length("main_text").alias("text_length"))


def counters(articles: DataFrame) -> DataFrame:
    """How many articles of each status, and how many of them lack keywords."""
    return articles.groupBy("status").agg(F.count("*").alias("articles"), F.count_if(F.size("keywords") == 0).alias("without_keywords"))
