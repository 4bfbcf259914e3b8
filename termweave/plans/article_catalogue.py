"""Queries over articles made from ``documents``: segmentation, lemmas, summaries, graph building, files.

``documents`` has no section headings and no Cyrillic text, so articles are laid out
from its words, by language: "de" as English articles with a Russian summary behind,
"es" as Russian ones, "en" as English ones, others without headings.  Every SQL
builds the same texts, or says from the parts what has to come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import profiles as P
from termweave.functions import text as T
from termweave.operators import evaluate, graph, lexicon, paradigms, search, segment, semantic, summarize, tfidf
from termweave.plans import text_catalogue as base
from termweave.plans.graph_catalogue import CTE, orders_graph
from termweave.sources import markup, readers, scratch, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}
AUTHORS, FILLER = "A.B. Cdef, G.H. Ijkl", "knowledge graphs link words "
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхуз"
STOP = base.STOP


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, full_text."""
    words = F.regexp_extract_all("text", F.lit("([a-zA-Z]{2,20})"), F.lit(1))
    w = base.table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("w"))
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    body = F.concat(F.regexp_replace(F.array_join(F.slice("w", F.lit(24), F.greatest(F.size("w") - 23, F.lit(0))), " "), "(([a-zA-Z]+ ){15})", "$1\n"), F.lit("\n"), F.repeat(F.lit(FILLER), F.when(F.size("w") < 30, 2).otherwise(30)))
    parts = w.select("doc_id", "lang", F.concat(F.when(F.size("w") > 40, "Paper about ").otherwise("+++ 1234 5678 +++"), F.when(F.size("w") > 40, cut(1, 7)).otherwise("")).alias("title"), cut(9, 12).alias("ann"), F.lower(F.array_join(F.slice("w", 21, 3), ", ")).alias("keys"), body.alias("body"))
    de = F.concat(F.lit("Abstract: "), "ann", F.lit("\nKeywords: "), "keys", F.lit("\nIntroduction\n"), "body", F.lit("\nАннотация: кратко "), "ann", F.lit("\nКлючевые слова: "), "keys", F.lit("\nСведения об авторах\nx"))
    es = F.concat(F.lit("Аннотация: "), "ann", F.lit("\nКлючевые слова: "), "keys", F.lit(".\nВведение\n"), F.translate(F.lower("body"), LATIN, CYRILLIC), F.lit("\nСписок литературы\n1. X"))
    en = F.concat(F.lit("Abstract: "), "ann", F.lit("\nKeywords: "), "keys", F.lit("\n"), "body", F.lit("\nReferences\n[1] X"))
    laid = F.when(F.col("lang") == "de", de).when(F.col("lang") == "es", es).when(F.col("lang") == "en", en).otherwise(F.col("body"))
    return parts.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.concat("title", F.lit(f"\n{AUTHORS}\nUniversity\n\n"), laid).alias("full_text"))


ARTICLES = rf"""with w as (select doc_id, lang, regexp_extract_all(text, '[a-zA-Z]{{2,20}}') as w from documents),
p as (select doc_id, lang, case when len(w) > 40 then 'Paper about ' || array_to_string(w[1:7], ' ') else '+++ 1234 5678 +++' end as title, array_to_string(w[9:20], ' ') as ann, lower(array_to_string(w[21:23], ', ')) as keys, w[21:23] as k,
  regexp_replace(array_to_string(w[24:], ' '), '(([a-zA-Z]+ ){{15}})', '\1' || chr(10), 'g') || chr(10) || repeat('{FILLER}', case when len(w) < 30 then 2 else 30 end) as body from w),
q as (select *, translate(lower(body), '{LATIN}', '{CYRILLIC}') as cyr, 'doc_' || doc_id || '.pdf' as filename, case lang when 'de' then 'A' when 'es' then 'B' when 'en' then 'C' else 'D' end as template from p),
-- of C the keywords reach to the first line end 100 characters behind their heading
c as (select *, 'Keywords: ' || keys || chr(10) || body || chr(10) || 'References' || chr(10) || '[1] X' as tail from q),
e as (select *, 100 + strpos(substr(tail, 101), chr(10)) as e from c),
m as (select *, regexp_replace(regexp_replace(trim(case template when 'A' then 'Introduction' || chr(10) || body when 'B' then 'Введение' || chr(10) || cyr when 'C' then substr(tail, e, case when strpos(substr(tail, e), chr(10) || 'References') > 0 then strpos(substr(tail, e), chr(10) || 'References') - 1 else length(tail) end)
    else title || chr(10) || '{AUTHORS}' || chr(10) || 'University' || chr(10) || chr(10) || body end), '\n\s*\n', chr(1), 'g'), '\s+', ' ', 'g') as squeezed from e),
r as (select filename, template, case when length(title) >= 10 then title end as title, case template when 'A' then trim('кратко ' || ann) when 'D' then '' else ann end as annotation,
  case template when 'D' then '' when 'C' then array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(trim(replace(substr(tail, 11, e - 11), chr(10), ' ')), '\.+$', ''), '[,;]\s*'), lambda x: regexp_replace(lower(trim(x)), '\s+', ' ', 'g')), lambda x: x <> '' and length(x) <= 60 and len(string_split(x, ' ')) <= 6), '|')
    else array_to_string(list_transform(k, lambda x: lower(x)), '|') end as keywords,
  array_to_string(list_filter(list_transform(string_split(squeezed, chr(1)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) as main_text from m),
g as (select *, length(main_text) as n, length(regexp_replace(main_text, '[^\x{{0400}}-\x{{04FF}}]', '', 'g')) as cyr, length(regexp_replace(main_text, '[^a-zA-Z]', '', 'g')) as lat from r),
a as (select *, case when template in ('C', 'D') and n < 200 then 'Too little text content to extract anything useful' when n < 100 then 'Text appears garbled (encoding issue)'
  when not regexp_matches(title, '[a-zA-Z]{{3,}}') then 'Title appears garbled: ' || substr(title, 1, 50) when cyr = 0 or cyr / (cyr + lat) < 0.5 then 'Non-Russian article: ' || substr(title, 1, 50) end as reason from g)
"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segmented(full_texts(spark, sf_dir))


@query(ARTICLES + "select filename, template, annotation, keywords, md5(main_text) as main_text from a")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates A to D, cut at the places of headings and line ends."""
    return articles(spark, sf_dir).select("filename", "template", "annotation", F.array_join("keywords", "|").alias("keywords"), F.md5("main_text").alias("main_text"))


@query(ARTICLES + f"select filename, title, '{AUTHORS}'.replace(', ', '|') as authors from a")
def article_titles_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("filename", "title", F.array_join("authors", "|").alias("authors"))


@query(ARTICLES + "select filename, reason, case when reason is null then 'ok' else 'skipped' end as status from a")
def article_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of gates; the first that fails names the reason."""
    return articles(spark, sf_dir).select("filename", "reason", "status")


@query(ARTICLES + "select case when reason is null then 'ok' else 'skipped' end as status, count(*) as articles, count(*) filter (keywords = '') as without_keywords from a group by 1")
def article_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.counters(articles(spark, sf_dir))


@query(ARTICLES + "select filename, title, keywords, length(main_text)::int as text_length from a where reason is null")
def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that pass, written as JSON lines, read again and indexed."""
    path = scratch.new_path(spark, "articles")
    writers.articles_json(articles(spark, sf_dir).filter("status = 'ok'").select("filename", "title", "authors", "annotation", "keywords", "main_text"), path)
    index = segment.corpus_index(readers.articles_json(spark, path, lines=True))
    return index.select("filename", "title", F.array_join("keywords", "|").alias("keywords"), "text_length")


@query(r"""with b as (select doc_id, i, line, 40 + 45 * (i % 17) as y0 from (select doc_id, unnest(l) as line, unnest(range(len(l))) as i from (select doc_id, string_split(text, chr(10)) as l from documents)))
select doc_id, md5(string_agg(line, chr(10) || chr(10) order by i)) as full_text from b where y0 >= 70 and y0 + 30 <= 755 group by 1""")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as layout blocks, 17 a page; the running heads and feet go."""
    lines = base.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    blocks = lines.select("doc_id", F.floor(F.col("i") / 17).alias("page"), (F.col("i") % 17).alias("block_no"), (40 + 45 * (F.col("i") % 17)).cast("double").alias("y0"), "text").withColumn("y1", F.col("y0") + 30)
    return segment.page_text(blocks).select("doc_id", F.md5("full_text").alias("full_text"))


NAV = r"regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)"


def _joined(links: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, links of all pages in the order of their elements."""
    lists = links.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "href"))).alias("l"))
    return pages.select("page_id").join(lists, "page_id", "left").select("page_id", F.coalesce(F.array_join(F.col("l.href"), "|"), F.lit("")).alias("links"))


@query(f"select page_id, array_to_string(list_filter({NAV}, lambda x: contains(x, 'on')), '|') as links from pages")
def issue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links set as issue pages set theirs, <p><strong><a>; those of one kind."""
    html = F.regexp_replace(F.regexp_replace("html", '<li><a href="', '<p><strong><a href="'), "</a></li>", "</a></strong></p>")
    pages = base.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return _joined(markup.issue_links(markup.elements(pages), "on"), pages)


@query(f"select page_id, array_to_string(list_filter({NAV}, lambda x: contains(x, 'e')), '|') as links from pages")
def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation links set as an archive sets its issues, in boxes that are never closed; those whose link holds an image."""
    box = '<div class="elementor-widget-container"><a href="$1">'
    html = F.regexp_replace(F.regexp_replace("html", '<li><a href="([^"]*e[^"]*)">', box + '<img src="i">'), '<li><a href="([^"]*)">', box)
    pages = base.table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return _joined(markup.archive_links(markup.elements(pages)), pages)


TAGS = r"regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)>.*?</(script|style)>', '<\1>', 'gs'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)"


@query(rf"""select page_id, 'html/body/nav/ul/li/a' as path, href, text, 1 as n from (select page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) as href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) as text from pages)
union all select page_id, tag, null, null, count(*)::int from (select page_id, unnest({TAGS}) as tag from pages) where tag <> 'a' group by 1, 2""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link with its path, target and text, and how many elements of each other kind a page has."""
    found = markup.elements(base.table(spark, sf_dir, "pages"))
    links = found.filter("tag = 'a'").select("page_id", "path", F.col("attributes")["href"].alias("href"), "text", F.lit(1).alias("n"))
    others = found.filter("tag <> 'a'").groupBy("page_id", F.col("tag").alias("path")).agg(F.count("*").cast("int").alias("n"))
    none = F.lit(None).cast("string")
    return links.unionByName(others.select("page_id", "path", none.alias("href"), none.alias("text"), "n"))


@query("select string_split(url, '/')[-1] as name, max(page_id) as page_id, arg_max(url, page_id) as url from pages group by 1")
def last_download_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = base.table(spark, sf_dir, "pages").select(T.last_segment(F.col("url")).alias("name"), "page_id", "url")
    return readers.last_of_each(named.withColumn("seq", F.col("page_id")), "name", "seq").select("name", "page_id", "url")


@query("select doc_id, lang from documents order by doc_id limit 15")
def first_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_by(base.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 15)


@query("""with l as (select doc_id, i, line from (select doc_id, unnest(l) as line, unnest(range(len(l))) as i from (select doc_id, string_split(text, chr(10)) as l from documents))),
p as (select trim(string_split(line, '=')[1]) as key, trim(substr(line, instr(line, '=') + 1)) as value, doc_id, i from l where trim(line) <> '' and not starts_with(trim(line), '#') and contains(line, '=')),
f as (select key, arg_min(value, (doc_id, i)) as value from p group by 1)
select md5(key) as key, md5(value) as value from f union all select md5(source), md5(n::varchar) from (select source, count(*) as n from documents group by 1)""")
def dotenv_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as a settings file: comments and lines without '=' go, the first '=' splits, the first line of a key counts; beside them what is present."""
    docs = base.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    present = docs.groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return readers.settings_table(lines, ["doc_id", "i"], present).select(F.md5("key").alias("key"), F.md5("value").alias("value"))


@query("""select coalesce(s.s_suppkey, c.c_custkey) as id, coalesce(s.s_name, c.c_name) as name from customer c full join supplier s on s.s_suppkey = c.c_custkey""")
def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers come as arrays of rows and win over customers of the same id."""
    old = base.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    batches = base.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("batch"))
    return graph.upserted(old, readers.unnested(batches), "id")


INDEX = "with i as (select 'doc_' || doc_id as filename, lang from documents), f as (select 'doc_' || doc_id as filename, 'T' || quality as title, ['q' || quality, 't' || toxic] as keywords from labels) "


def index_and_articles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename")
    index = base.table(spark, sf_dir, "documents").select(name, "lang")
    some = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return index, base.table(spark, sf_dir, "labels").select(name, some("T", "quality").alias("title"), F.array(some("q", "quality"), some("t", "toxic")).alias("keywords"))


@query(INDEX + "select filename, lang, title, array_to_string(keywords, ',') as keywords from i join f using (filename)")
def index_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries with their article; those without one go."""
    return readers.indexed(*index_and_articles(spark, sf_dir)).withColumn("keywords", F.array_join("keywords", ","))


@query(INDEX + "select filename, lang, coalesce(title, '') as title, coalesce(array_to_string(keywords, ','), '') as keywords from i left join f using (filename)")
def index_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries with their article, or with defaults."""
    return readers.indexed(*index_and_articles(spark, sf_dir), keep_missing=True).withColumn("keywords", F.array_join("keywords", ","))


@query(CTE + """select p.id, p.title, coalesce(array_to_string(x.authors, ';'), '') as authors from (select id, title from d order by title nulls last, id limit 15) p
left join (select o_orderkey as id, [c_name] as authors from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'P') x using (id)""")
def page_with_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of results with authors from another table; unknown ones have none."""
    authors = base.table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").join(base.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.array("c_name").alias("authors"))
    page = search.search_documents(orders_graph(spark, sf_dir), "", search.Page.of(1, 15)).select("id", "title")
    return search.with_authors(page, authors).withColumn("authors", F.array_join("authors", ";"))


@query(CTE + "select d.id as doc, d.title, e.method, e.weight, k.id as keyword, k.name from e join d on d.id = e.pub_id join k on k.id = e.keyword_id")
def entity_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entities d, r, k of every edge, then some of their fields."""
    g = orders_graph(spark, sf_dir)
    return search.rows_and_subgraph(g, g.has_keyword).select(F.col("d.id").alias("doc"), "d.title", "r.method", "r.weight", F.col("k.id").alias("keyword"), "k.name")


METHODS = "case l_returnflag when 'A' then 'author' when 'R' then 'tfidf' else 'keybert' end"


@query(f"""select l_partkey as id, case when bool_or(m = 'author') then '#10b981' when bool_or(m = 'tfidf') then '#3b82f6' when bool_or(m = 'keybert') then '#f59e0b' else '#94a3b8' end as colour,
bool_or(m = 'author') as author_kw, bool_or(m = 'tfidf') as tfidf_kw, bool_or(m = 'keybert') as keybert_kw, printf('%.1f%%', 100 * max(l_discount)) as discount from (select *, {METHODS} as m from lineitem where l_quantity < 30) group by 1""")
def keyword_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, colour by the first method and a share as percent of each keyword."""
    m = F.when(F.col("l_returnflag") == "A", "author").when(F.col("l_returnflag") == "R", "tfidf").otherwise("keybert")
    words = base.table(spark, sf_dir, "lineitem").filter("l_quantity < 30").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(m).alias("methods"), F.max("l_discount").alias("top"))
    return graph.labelled(words).select("id", T.method_style(F.col("methods")).alias("colour"), "author_kw", "tfidf_kw", "keybert_kw", T.percent(F.col("top"), 1).alias("discount"))


# A rule stands for the morphological analyser: it says lemma and part of speech by a word's ending.
LEMMA = "case when length(token) > 5 then regexp_replace(token, '(ing|tion|ly|s)$', '') else token end"
POS = "case when suffix(token, 'tion') then 'NOUN' when suffix(token, 'er') then 'VERB' when suffix(token, 'ly') then 'ADJF' when suffix(token, 'on') then 'PREP' end"


def analysed(word: str) -> tuple[str, str | None]:
    lemma = next((word[: -len(e)] for e in ("ing", "tion", "ly", "s") if word.endswith(e)), word) if len(word) > 5 else word
    return lemma, next((pos for e, pos in (("tion", "NOUN"), ("er", "VERB"), ("ly", "ADJF"), ("on", "PREP")) if word.endswith(e)), None)


def ruled_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.words(F.col("text"), "\\p{L}")
    return lexicon.lexicon_of(base.table(spark, sf_dir, "documents").select(F.explode(words).alias("token")), analysed)


@query(rf"""with t as (select doc_id, trim(raw, '-') as token from (select doc_id, unnest(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\- ]', ' ', 'g'), '\s+')) as raw from documents) where length(raw) >= 3),
l as (select doc_id, {LEMMA} as lemma, {POS} as pos from t where token <> '' and regexp_matches(token, '^\p{{L}}+$') union all select doc_id, token, null from t where token <> '' and not regexp_matches(token, '^\p{{L}}+$'))
select doc_id, lemma, count(*) as n from l where (pos is null or pos <> 'PREP') and lemma not in {STOP} and (length(lemma) > 3 or regexp_matches(lemma, '[аоуыэяеёюиaeiouy]') or regexp_matches(lemma, '[^а-яёa-z]')) group by 1, 2""")
def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas by a lexicon of the distinct words; function words, stopwords and short lemmas without a vowel go."""
    found = lexicon.lemmas(base.table(spark, sf_dir, "documents"), F.col("text"), ruled_lexicon(spark, sf_dir))
    return found.groupBy("doc_id", "lemma").agg(F.count("*").alias("n"))


@query(rf"""with t as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) as token from conversations),
lex as (select token, {LEMMA} as lemma, {POS} as pos from t),
a as (select *, list_max(list_filter(range(0, least(length(token), length(lemma)) + 1), lambda n: token[1:n] = lemma[1:n])) as same from lex),
w as (select token, pos, length(token) - same as cut, substr(lemma, same + 1) as put, least(length(token) - 2, 5) as most from a where same >= 2),
c as (select case when n > 0 then right(token, n) else '' end as ending, cut, put, pos, count(*) as c from (select *, unnest(range(cut, most + 1)) as n from w where cut <= most) group by all having count(*) >= 2),
r as (select * from (select *, row_number() over (partition by ending order by c desc, cut, put, pos nulls last) as place from c) where place = 1),
u as (select distinct unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+')) as token from documents),
e as (select token, n, case when n > 0 then right(token, n) else '' end as ending from (select token, unnest(range(0, greatest(least(length(token) - 2, 5), 0) + 1)) as n from u where token not in (select token from t))),
g as (select token, arg_max((cut, put, pos), n) as rule from e join r using (ending) group by 1)
select token, case when t.token is not null then lex.lemma when rule is null then u.token else substr(u.token, 1, (length(u.token) - rule[1])::int) || rule[2] end as lemma, case when t.token is not null then lex.pos else rule[3] end as pos, t.token is not null as known
from u left join t using (token) left join lex using (token) left join g using (token)""")
def guessed_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents by a lexicon of the words of conversations, and by rules learned from it where it has none."""
    words = lambda t: base.table(spark, sf_dir, t).select(F.explode(T.words(F.col("text"), "\\p{L}")).alias("token")).distinct()
    known = scratch.stored(lexicon.lexicon_of(words("conversations"), analysed), "lexicon")
    found = paradigms.completed(words("documents"), known)
    return found.join(known.select("token", F.lit(True).alias("known")), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))


RU_STOP = "(" + ", ".join(f"'{w}'" for w in P.RUSSIAN.stopwords) + ")"
RU_LINE = " и ".join(P.RUSSIAN_STOPWORDS[10:40]) + " граф знаний модель " + " ".join(P.RUSSIAN_DOMAIN_STOPWORDS[:20]) + " онтология "


@query(f"""with t as (select doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(translate(lower(text), '{LATIN}', '{CYRILLIC}') || ' {RU_LINE}', '[^а-яё\\- ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) as raw from documents)
select lemma, count(*) as n from (select trim(raw, '-') as lemma from t where length(raw) >= 3) where lemma <> '' and lemma not in {RU_STOP} and (length(lemma) > 3 or regexp_matches(lemma, '[аоуыэяеёюиaeiouy]') or regexp_matches(lemma, '[^а-яёa-z]')) group by 1""")
def russian_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Cyrillic letters with Russian words behind, by the Russian profile and its stopwords."""
    text = F.concat(F.translate(F.lower("text"), LATIN, CYRILLIC), F.lit(f" {RU_LINE}"))
    found = lexicon.lemmas(base.table(spark, sf_dir, "documents"), text, profile=P.RUSSIAN)
    return found.groupBy("lemma").agg(F.count("*").alias("n"))


PHRASES = r"(select doc_id, unnest(range(1, len(w))) as i, w[i] || ' ' || w[i + 1] as phrase from (select doc_id, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\p{L}]+') as w from documents))"


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, phrase: the neighbouring words of annotations."""
    w = base.parts(spark, sf_dir).select("doc_id", T.words(F.col("annotation"), "\\p{L}").alias("w"))
    return w.select("doc_id", F.explode(T.ngrams(F.col("w"), 2)).alias("phrase"))


NOT_POS = "('" + "', '".join(P.NOT_KEYWORD_POS) + "')"


@query(rf"""with p as (select phrase, string_split(phrase, ' ') as w from {PHRASES}), f as (select phrase, w, list_transform(w, lambda token: {POS}) as pos from p)
select phrase, count(*) as n from f where len(list_filter(w, lambda x: length(x) >= 3 and x not in {STOP})) = 2 and len(list_filter(pos, lambda x: x in {NOT_POS})) = 0 and coalesce(pos[2], '') not in ('ADJF', 'ADJS', 'COMP') group by 1""")
def valid_keyword_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word phrases that are keywords by their words and parts of speech."""
    good = lexicon.valid_keywords(word_pairs(spark, sf_dir), ruled_lexicon(spark, sf_dir))
    return good.groupBy("phrase").agg(F.count("*").alias("n"))


@query(rf"with f as (select phrase, list_sort(list_transform(string_split(phrase, ' '), lambda token: {LEMMA})) as w from {PHRASES}) select array_to_string(w, ' ') as phrase_id, count(*) as n, count(distinct phrase) as phrases from f group by 1")
def lemma_phrase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the same lemmas in any order are one."""
    ids = lexicon.phrase_ids(word_pairs(spark, sf_dir), ruled_lexicon(spark, sf_dir), letters="\\p{L}")
    return ids.groupBy("phrase_id").agg(F.count("*").alias("n"), F.countDistinct("phrase").alias("phrases"))


def _scores(n: int, mode: str, words: str) -> str:
    gram = "array_to_string(x.w[i : i + " + str(n - 1) + "], ' ')"
    return rf"""(with t as (select conv_id, turn, {words} as w from conversations), p as (select conv_id || '-' || turn as pair_id, w as cand, lag(w) over (partition by conv_id order by turn) as ref from t),
q as (select * from p where ref is not null), c as (select pair_id, {gram} as g, count(*) as n from (select pair_id, cand as w, unnest(range(1, len(cand) - {n - 2})) as i from q) x group by all),
r as (select pair_id, {gram} as g, count(*) as n from (select pair_id, ref as w, unnest(range(1, len(ref) - {n - 2})) as i from q) x group by all), h as (select pair_id, sum(least(c.n, r.n)) as hits from c join r using (pair_id, g) group by 1)
select pair_id, '{mode}' as mode, 'rouge{n}' as metric, case when len(cand) >= {n} then coalesce(hits, 0) / (len(cand) - {n - 1}) else 0 end as precision, case when len(ref) >= {n} then coalesce(hits, 0) / (len(ref) - {n - 1}) else 0 end as recall from q left join h using (pair_id))"""


RAW = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
LEMMAS = f"list_transform({RAW}, lambda token: {LEMMA})"
LCS = r"""list_reduce(flatten(list_transform(ref, lambda y: list_reverse_sort(list_filter(range(1, len(cand) + 1), lambda i: cand[i] = y)))).list_transform(lambda i: [i]),
lambda acc, e: list_concat(list_concat(list_filter(acc, lambda t: t < e[1]), e), acc[len(list_filter(acc, lambda t: t < e[1])) + 2 :]), []::bigint[])"""


def _longest(mode: str, words: str) -> str:
    """Patience sorting of the places of each word of one side in the other, from right to left."""
    return rf"""(with t as (select conv_id, turn, {words} as w from conversations), p as (select conv_id || '-' || turn as pair_id, w as cand, lag(w) over (partition by conv_id order by turn) as ref from t), h as (select *, len({LCS}) as hits from p where ref is not null)
select pair_id, '{mode}' as mode, 'rougeL' as metric, coalesce(hits / nullif(len(cand), 0), 0) as precision, coalesce(hits / nullif(len(ref), 0), 0) as recall from h)"""


ROUNDED = "round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1"


@query("select pair_id, mode, metric, " + ROUNDED + " from (" + " union all ".join(f(m, w) if n is None else f(n, m, w) for m, w in (("raw", RAW), ("lemmatized", LEMMAS)) for n, f in ((1, _scores), (2, _scores), (None, _longest))) + ")")
def raw_and_lemma_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1, -2 and -L of consecutive turns, of the words and of their lemmas."""
    turns = base.table(spark, sf_dir, "conversations")
    known = lexicon.lexicon_of(turns.select(F.explode(T.words(F.col("text"))).alias("token")), analysed)
    pairs = base.turn_texts(spark, sf_dir)
    scored = evaluate.summary_scores(pairs, known)
    return scored.select("pair_id", "mode", "metric", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("select pair_id, " + ROUNDED + " from " + _longest("raw", RAW))
def rougeL(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._rounded(evaluate.rouge_l(base.turn_pairs(spark, sf_dir)), "pair_id")


@query(base.TFIDF + """, t25 as (select doc_id, list([term] order by rank) as k from top where rank <= 25 group by 1)
select doc_id, array_to_string(list_reduce(k, lambda acc, e: case when len(acc) >= 10 or len(list_filter(acc, lambda x: contains(x, e[1]) or contains(e[1], x))) > 0 then acc else list_concat(acc, e) end, []::varchar[]), '|') as kept from t25""")
def greedy_substring_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of 25 terms of which none holds another, in order of weight."""
    terms = base.top_terms(spark, sf_dir, 25).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return terms.select("doc_id", F.array_join(semantic.without_redundant(F.transform("k", lambda x: x["term"])), "|").alias("kept"))


SCORED = base.TFIDF + rf""", s as (select doc_id, idx, s, list_distinct(w) as u, len(w) as nw from (select doc_id, idx, s, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+') as w from (select doc_id, unnest(s) as s, unnest(range(len(s)))::int as idx from (select doc_id, {base.SENTENCES} as s from documents))) where len(w) between 8 and 60),
raw as (select s.doc_id, s.idx, any_value(s.s) as s, any_value(s.u) as u, coalesce(sum(case when list_contains(s.u, top.term) then 11 - top.rank else 0 end), 0) / sqrt(any_value(s.nw)) as score from s left join top on top.doc_id = s.doc_id and top.rank <= 10 group by 1, 2),
b as (select *, case when max(score) over (partition by doc_id) > 0 then score / max(score) over (partition by doc_id) else 0 end as base, count(*) over (partition by doc_id) as c from raw)
"""


@query(SCORED + "select doc_id, idx, round(base, 6) as score from b")
def normalised_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence scores as shares of the best one of the document."""
    step = base.summary_inputs(spark, sf_dir).select("doc_id", "keywords", T.numbered_sentences(T.sentences(F.col("text"))).alias("s"))
    raw = T.held(step, "doc_id", "s", v=summarize.sentence_scores(F.transform("s", lambda x: T.words(x["text"])), F.col("keywords")))
    scored = raw.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["idx"]).alias("idx"), summarize.normalised(F.col("v")).alias("v"))).alias("x"))
    return scored.select("doc_id", "x.idx", F.round("x.v", 6).alias("score"))


def _chosen() -> str:
    """Four steps of the greedy choice: of the sentences left, the best by score less likeness to those chosen."""
    out = "p0 as (select 0::bigint as doc_id, 0 as idx where false)"
    for k in range(1, 5):
        out += f""", p{k} as (select * from p{k - 1} union all select doc_id, arg_max(idx, (round(0.6 * base - 0.4 * near, 12), -idx)) as idx from (
select b.doc_id, b.idx, b.base, coalesce(max(len(list_intersect(b.u, o.u)) / (len(b.u) + len(o.u) - len(list_intersect(b.u, o.u)))), 0) as near from b left join p{k - 1} p on p.doc_id = b.doc_id left join b o on o.doc_id = p.doc_id and o.idx = p.idx
where ceil(b.c / 2) >= {k} and not exists (select 1 from p{k - 1} x where x.doc_id = b.doc_id and x.idx = b.idx) group by b.doc_id, b.idx, b.base) group by doc_id)"""
    return out


@query(SCORED + ", " + _chosen() + " select d.doc_id, coalesce(md5(string_agg(b.s, ' ' order by b.idx)), md5('')) as summary from documents d left join p4 p on p.doc_id = d.doc_id left join b on b.doc_id = p.doc_id and b.idx = p.idx group by 1")
def mmr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of up to four sentences by score and diversity, in document order."""
    return summarize.summaries(base.summary_inputs(spark, sf_dir)).select("doc_id", F.md5("summary").alias("summary"))


@query(rf"""with s as (select doc_id, idx, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) as u from (select doc_id, unnest(s) as s, unnest(range(len(s)))::int as idx from (select doc_id, {base.SENTENCES} as s from documents)))
select a.doc_id, a.idx, round(case when len(a.u) > 0 and len(b.u) > 0 then len(list_intersect(a.u, b.u)) / (len(a.u) + len(b.u) - len(list_intersect(a.u, b.u))) else 0 end, 9) as score from s a join s b on b.doc_id = a.doc_id and b.idx = a.idx + 1""")
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the word sets of neighbouring sentences."""
    w = base.table(spark, sf_dir, "documents").select("doc_id", F.transform(T.sentences(F.col("text")), lambda s: T.words(s)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), T.jaccard(a, b)))
    return w.select("doc_id", F.posexplode(F.array_compact(pairs)).alias("idx", "score")).select("doc_id", "idx", F.round("score", 9).alias("score"))


BUILT = base.TFIDF + rf""", {base.PARTS}, f as (select doc_id, [' ', array_to_string(w[1:2], ' ') || '.', replace(upper(w[2]), 'ẞ', 'SS') || ' ' || w[1], w[3]] as author, w[4:6] as other from (select doc_id, list_transform(range(1, 7), lambda i: coalesce(x[i], '')) as w from (select doc_id, regexp_extract_all(annotation, '[\p{{L}}]+') as x from parts))),
l as (select doc_id, 0 as list, 'author' as method, unnest(author) as raw, unnest(range(4)) as idx from f union all select doc_id, 2, 'keybert', unnest(other), unnest(range(3)) from f union all select doc_id, 1, 'tfidf', term, rank - 1 from top where rank <= 10),
y as (select *, regexp_replace(trim(raw), '\.+$', '') as spelling from l), mm as (select *, array_to_string(list_sort(regexp_extract_all(lower(spelling), '[\p{{L}}0-9]+')), ' ') as keyword_id from y),
mention as (select * from mm where spelling <> '' and keyword_id <> '')
"""


def built_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """The graph of articles with author's keywords (a blank one, two spellings of one, one more), terms, and others."""
    x = F.regexp_extract_all("annotation", F.lit("(\\p{L}+)"), F.lit(1))
    at = lambda i: F.coalesce(F.get(x, F.lit(i - 1)), F.lit(""))
    listed = base.parts(spark, sf_dir).select("doc_id", "annotation", F.array(F.lit(" "), F.concat(at(1), F.lit(" "), at(2), F.lit(".")), F.concat(F.upper(at(2)), F.lit(" "), at(1)), at(3)).alias("keywords"), F.array(at(4), at(5), at(6)).alias("keywords_keybert"))
    terms = base.top_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k")).select("doc_id", F.transform("k", lambda v: v["term"]).alias("keywords_tfidf"))
    rows = listed.join(terms, "doc_id", "left").select(F.col("doc_id").alias("filename"), F.col("annotation").alias("title"), F.array("annotation").alias("authors"), "annotation", "keywords", "keywords_tfidf", "keywords_keybert")
    return graph.build(scratch.stored(rows, "articles"), letters="\\p{L}")  # read once a list and a use


@query(BUILT + "select doc_id as pub_id, keyword_id, method, case method when 'author' then 1.0 else 10 - least(idx, 9) end::double as weight from mention")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of three keyword lists, weighted by rank; blank ones go but count as ranks."""
    return built_graph(spark, sf_dir).has_keyword


@query(BUILT + """, sp as (select keyword_id, spelling, count(*) as c, min((doc_id, list, idx)) as first from mention group by 1, 2), o as (select keyword_id, arg_min(spelling, (-c, first)) as s from sp group by 1)
select keyword_id as id, case substr(s, 1, 1) when 'ß' then 'SS' else upper(substr(s, 1, 1)) end || substr(s, 2) as name, methods from o join (select keyword_id, array_to_string(list_sort(list(distinct method)), ',') as methods from mention group by 1) using (keyword_id)""")
def graph_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_graph(spark, sf_dir).keywords.withColumn("methods", F.array_join("methods", ","))


@query(rf"with {base.PARTS} select doc_id as id, annotation as title, annotation as authors, annotation from parts")
def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_graph(spark, sf_dir).documents


SIMILAR = """, z as (select d1 as source, d2 as target, round(shared / (a.n + b.n - shared), 9) as score from p
join (select pub_id, count(distinct keyword_id) as n from e group by 1) a on a.pub_id = d1 join (select pub_id, count(distinct keyword_id) as n from e group by 1) b on b.pub_id = d2)
"""


@query(CTE + SIMILAR + "select target as pub_id, score from z where source = 42 union all select source, score from z where target = 42")
def similar_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked to one, whichever way the link points."""
    linked = graph.similar_to_one(orders_graph(spark, sf_dir).has_keyword, 42, 0.0)
    return graph.similar_of(linked, 42).withColumn("score", F.round("score", 9))


@query(CTE + SIMILAR + "select (select count(*) from d) as documents, (select count(*) from k) as keywords, (select count(*) from e) as edges, count(*) as similar from z where score >= 0.2")
def stats_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = orders_graph(spark, sf_dir)
    return search.stats(graph.Graph(g.documents, g.keywords, g.has_keyword, graph.similar_to(g.has_keyword, 0.2)))


FILES = CTE + """select 'publications' as file, id::varchar as a, title as b, annotation as c, null::double as x from d union all select 'keywords', id::varchar, name, brand, null from k
union all select 'edges', pub_id::varchar, keyword_id::varchar, method, weight from e union all select 'similar', l_orderkey::varchar, l_partkey::varchar, '', round(l_discount, 4) from lineitem where l_linenumber = 1"""


def with_links(spark: SparkSession, sf_dir: str) -> graph.Graph:
    g = orders_graph(spark, sf_dir)
    links = base.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.round("l_discount", 4).alias("score"))
    return graph.Graph(g.documents, g.keywords, g.has_keyword, links)


def _as_rows(docs: DataFrame, words: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("double")
    tables = (
        docs.select(F.lit("publications").alias("file"), text("id").alias("a"), F.col("title").alias("b"), F.col("annotation").alias("c"), none.alias("x")),
        words.select(F.lit("keywords"), text("id"), "name", F.array_join("methods", ","), none),
        edges.select(F.lit("edges"), text("pub_id"), text("keyword_id"), "method", "weight"),
        links.select(F.lit("similar"), text("source"), text("target"), F.lit(""), F.col("score").cast("double")),
    )
    return tables[0].union(tables[1]).union(tables[2]).union(tables[3])


@query(FILES)
def graph_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as four CSV files, written and read again."""
    path = scratch.new_path(spark, "graph")
    writers.graph_csv(with_links(spark, sf_dir), path)
    return _as_rows(*readers.graph_csv(spark, path), readers.similar_csv(spark, path))


@query(FILES)
def graph_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the graph, written over others of the same names."""
    path, g = scratch.new_path(spark, "tables"), with_links(spark, sf_dir)
    writers.graph_tables(graph.Graph(g.documents.limit(3), g.keywords.limit(3), g.has_keyword.limit(3), g.similar.limit(3)), path)
    writers.graph_tables(g, path)
    return _as_rows(*(spark.read.parquet(f"{path}/{t}") for t in ("documents_v", "keywords_v", "has_keyword", "similar_to")))


@query(CTE + "select k.name, e.method, count(*) as n, round(sum(e.weight), 4) as weight from e join k on k.id = e.keyword_id group by 1, 2 having count(*) > 1")
def free_form_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user asks in SQL of the graph's tables."""
    orders_graph(spark, sf_dir).as_views(spark)
    return spark.sql("select k.name, e.method, count(*) as n, round(sum(e.weight), 4) as weight from has_keyword e join keywords_v k on k.id = e.keyword_id group by all having count(*) > 1")


ENRICHED = base.TFIDF + rf""", {base.PARTS}, k as (select doc_id, list(term order by rank) as t from top where rank <= 10 group by 1)
select doc_id, json_extract_string(j, '$.title') as title, json_array_length(j, '$.keywords_tfidf')::int as n, array_to_string(from_json(json_extract(j, '$.keywords_tfidf'), '["VARCHAR"]'), '|') as terms
from (select doc_id, to_json({{'title': annotation, 'keywords_tfidf': coalesce(t, [])}}) as j from parts left join k using (doc_id))"""


@query(ENRICHED)
def enriched_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with its keywords, as JSON text and back."""
    terms = base.top_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    rows = base.parts(spark, sf_dir).join(terms, "doc_id", "left").select("doc_id", F.struct(F.col("annotation").alias("title"), F.coalesce(F.transform("k", lambda v: v["term"]), F.array().cast("array<string>")).alias("keywords_tfidf")).alias("x"))
    back = F.from_json(F.to_json("x"), "title string, keywords_tfidf array<string>")
    return rows.select("doc_id", back.alias("y")).select("doc_id", "y.title", F.size("y.keywords_tfidf").alias("n"), F.array_join("y.keywords_tfidf", "|").alias("terms"))


SOFT = rf"""with a as (select doc_id, w[1] || ' ' || w[2] as x, w[2] || ' ' || w[3] as y, w[1] as z from (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}]+') as w from documents) where len(w) >= 3),
p as (select doc_id, [x, z] as f, [y, x] as g from a), s as (select doc_id, list_transform(f, lambda u: string_split(u, ' ')) as f, list_transform(g, lambda u: string_split(u, ' ')) as g from p),
j as (select doc_id, list_transform(f, lambda u: list_max(list_transform(g, lambda v: len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v)))))) as pr, list_transform(g, lambda v: list_max(list_transform(f, lambda u: len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v)))))) as re from s)
select doc_id, round(list_avg(pr), 9) as precision, round(list_avg(re), 9) as recall from j"""


@query(SOFT)
def keyword_soft_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft precision and recall where phrases share some of their words."""
    w = base.table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text"), "\\p{L}").alias("w")).filter(F.size("w") >= 3)
    at = lambda i: F.element_at("w", i)
    two = lambda a, b: F.concat_ws(" ", a, b)
    pairs = w.select("doc_id", F.lit("tfidf").alias("method"), F.array(two(at(1), at(2)), at(1)).alias("found"), F.array(two(at(2), at(3)), two(at(1), at(2))).alias("wanted"))
    scored = evaluate.keyword_metrics(pairs, (5,)).filter("match = 'soft'")
    return scored.select("doc_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall")])


@query("""with v as (select vec_id, cast(embedding as double[]) as e from embeddings), q as (select e as q from v where vec_id = 0),
b as (select vec_id, e, round(list_cosine_similarity(q, e), 12) as likeness from v, q where vec_id <> 0 order by 3 desc, 1 limit 64), p0 as (select 0::bigint as vec_id, 0::int as rank where false)""" + "".join(f""",
p{k} as (select * from p{k - 1} union all select arg_max(vec_id, (round(case when near is null then likeness else 0.45 * likeness - 0.55 * near end, 10), -vec_id)), {k}::int from (
select b.vec_id, b.likeness, max(list_cosine_similarity(b.e, o.e)) as near from b left join p{k - 1} p on true left join b o on o.vec_id = p.vec_id where b.vec_id not in (select vec_id from p{k - 1}) group by 1, 2))""" for k in range(1, 9)) + " select rank, vec_id from p8")
def mmr_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight of the 64 vectors nearest to one that are like it and unlike each other."""
    vectors = base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return semantic.diverse_rows(vectors.filter("vec_id <> 0"), vectors.filter("vec_id = 0"), 8, 0.55, 64)


PATH = "'document:' || d.id || ':' || d.title || '>edge:' || e.method || ':' || cast(e.weight as bigint) || '>keyword:' || k.id || ':' || k.name as path from e join d on d.id = e.pub_id join k on k.id = e.keyword_id"


def _spelled(found: DataFrame) -> DataFrame:
    return found.select(F.array_join(F.transform("path", lambda x: F.concat_ws(":", x["kind"], x["id"], F.regexp_replace(x["label"], "\\.0$", ""))), ">").alias("path"))


@query(CTE + f"select {PATH} where e.keyword_id = 7")
def path_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paths of one keyword's edges, as arrays of nodes and edges."""
    g = orders_graph(spark, sf_dir)
    return _spelled(search.paths(g, g.has_keyword.filter("keyword_id = 7")))


@query(CTE + f"select {PATH} order by e.pub_id, e.keyword_id, e.method, e.weight limit 100")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of documents and keywords in the form for display: the first hundred paths."""
    g = orders_graph(spark, sf_dir)
    return _spelled(search.paths(g, g.has_keyword, 100))


@query("""with t as (select lang, source, greatest(1, ceil(count(*) / 3.0))::int as n from documents group by 1, 2), p as (select lang, source, unnest(range(1, n + 1))::int as p, n from t),
l as (select *, least(greatest(1, p - 3), greatest(1, n - 6)) as lo from p), h as (select *, least(n, lo + 6) as hi from l)
select lang, source, p as page, case when n = 1 then '' else case when lo > 1 then '1 ' else '' end || case when lo > 2 then '... ' else '' end || array_to_string(range(lo, hi + 1), ' ') || case when hi < n - 1 then ' ...' else '' end || case when hi < n then ' ' || n else '' end end as shown from h""")
def pager_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pager offers on each page of the documents of each language and source, three a page."""
    counts = base.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 3)).cast("int").alias("pages"))
    each = counts.withColumn("page", F.explode(F.sequence(F.lit(1), "pages")))
    shown = F.transform(search.window_column(F.col("page"), F.col("pages")), lambda x: F.coalesce(x.cast("string"), F.lit("...")))
    return each.select("lang", "source", "page", F.array_join(shown, " ").alias("shown"))



AVERAGES = ", ".join(f"round(coalesce(avg({c}), 0), 6) as {c}" for c in ("precision", "recall", "f1"))


@query("select mode, metric, " + AVERAGES + " from (select pair_id, mode, metric, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from (" + " union all ".join(f(m, w) if n is None else f(n, m, w) for m, w in (("raw", RAW), ("lemmatized", LEMMAS)) for n, f in ((1, _scores), (2, _scores), (None, _longest))) + ")) group by mode, metric")
def rouge_averages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of ROUGE-1, -2 and -L, of words and of lemmas."""
    mean = evaluate.rouge_averages(raw_and_lemma_scores(spark, sf_dir), "mode", "metric")
    return mean.select("mode", "metric", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(base.PAIRS + "select 'tfidf' as method, k, match, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 6) as f1 from m, (values ('exact'), ('soft')) v(match) group by k, match")
def keyword_averages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of exact and of soft matches; single words match softly where they match exactly."""
    mean = evaluate.keyword_averages(evaluate.keyword_metrics(base.term_pairs(spark, sf_dir)))
    return mean.select("method", "k", "match", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
