"""Text queries over documents, pages, embeddings and conversations, each with its SQL.

A document's annotation is its first line, its body the rest (or all of it if
there is one line only).
"""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.functions import profiles as P
from termweave.functions import text as T
from termweave.operators import evaluate, graph, lexicon, search, semantic, summarize, tfidf
from termweave.sources import readers, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}
STOP = "(" + ", ".join(f"'{w}'" for w in P.ENGLISH_STOPWORDS) + ")"
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
TFIDF = rf"""with tok as (select doc_id, unnest({WORDS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from tok where length(term) >= 2 group by all),
df as (select term, count(*) as df from tf group by all),
n as (select count(*) as n from documents),
w as (select doc_id, tf.term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n where df >= least(2, n) and df <= case when n < 3 then n else 0.85 * n end),
t as (select doc_id, term, tf, df, round(w / sqrt(sum(w * w) over (partition by doc_id)), 9) as weight from w),
top as (select doc_id, cast(row_number() over (partition by doc_id order by weight desc, term desc) as int) as rank, term, weight from t)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, annotation, body."""
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.get(lines, F.lit(0)).alias("annotation"), F.when(F.size(lines) > 1, F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")).otherwise(F.col("text")).alias("body"))


PARTS = "parts as (select doc_id, string_split(text, chr(10))[1] as annotation, case when len(string_split(text, chr(10))) > 1 then array_to_string(string_split(text, chr(10))[2:], chr(10)) else text end as body from documents)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))


def top_terms(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return tfidf.top_of_documents(table(spark, sf_dir, "documents"), F.col("text"), k)


@query(r"""select doc_id, round(length(regexp_replace(text, '[^\x{0400}-\x{04FF}a-zA-Z0-9 \t\n\r.,;:!?()\-"''/\[\]{}+=<>@#$%&*_~\\]', '', 'g')) / greatest(length(text), 1), 9) as share,
length(text) >= 100 and length(regexp_replace(text, '[^\x{0400}-\x{04FF}a-zA-Z0-9 \t\n\r.,;:!?()\-"''/\[\]{}+=<>@#$%&*_~\\]', '', 'g')) / greatest(length(text), 1) >= 0.75 as readable from documents""")
def char_share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.readable_share(t), 9).alias("share"), T.is_readable(t).alias("readable"))


@query(rf"""with {PARTS} select doc_id, length(annotation) >= 3 and regexp_matches(annotation, '[а-яёА-ЯЁ]{{3,}}|[a-zA-Z]{{3,}}')
and length(regexp_replace(annotation, '[^\x{{0400}}-\x{{04FF}}a-zA-Z0-9 .,;:!?()\-"''/]', '', 'g')) / greatest(length(annotation), 1) >= 0.7 as valid from parts""")
def title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("doc_id", T.is_valid_title(F.col("annotation")).alias("valid"))


@query(r"select doc_id, round(coalesce(a / nullif(a + b, 0), 0), 9) as share, coalesce(a / nullif(a + b, 0), 0) >= 0.9 as plain from (select doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as a, length(regexp_replace(text, '[^\x{00C0}-\x{024F}]', '', 'g')) as b from documents)")
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.script_share(F.col("text"), "[a-zA-Z]", "[\\x{00C0}-\\x{024F}]")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(s, 9).alias("share"), (s >= 0.9).alias("plain"))


@query(r"""select lang, case when length(text) < 200 then 'short' when length(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g')) / length(text) < 0.75 then 'garbled' else 'ok' end as status, count(*) as n, sum(length(text))::bigint as chars from documents group by 1, 2""")
def quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    status = F.when(F.length(t) < 200, "short").when(T.share(T.matching_chars(t, "[a-zA-Z0-9 ]"), F.length(t)) < 0.75, "garbled").otherwise("ok")
    return table(spark, sf_dir, "documents").groupBy("lang", status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"))


@query(rf"with {PARTS} select doc_id, annotation as title, length(body)::int as text_length from parts")
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("doc_id", F.col("annotation").alias("title"), F.length("body").alias("text_length"))


@query(rf"select term, count(*) as tf, count(distinct doc_id) as df from (select doc_id, unnest({WORDS}) as term from documents) group by 1")
def tokens_tf_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = tfidf.term_counts(tokens(spark, sf_dir))
    return tf.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(TFIDF + "select doc_id, rank, term, round(weight, 6) as weight from top where rank <= 10")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_terms(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(TFIDF + rf", v as (select doc_id, term, weight, row_number() over (partition by doc_id order by rank) as r from top where rank <= 30 and length(term) >= 3 and regexp_matches(term, '^[\p{{L}}\-]+$') and term not in {STOP}) select doc_id, cast(r as int) as rank, term from v where r <= 10")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tfidf.first_valid(top_terms(spark, sf_dir, 30), lexicon.is_valid_keyword).select("doc_id", "rank", "term")


@query(rf"select doc_id, count(*) as n from (select doc_id, unnest({WORDS}) as term from documents) where term not in {STOP} group by 1")
def stopword_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in P.ENGLISH_STOPWORDS], "term string")
    return tokens(spark, sf_dir).join(F.broadcast(stop), "term", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"select term as phrase, count(*) as n from (select unnest({WORDS}) as term from documents) where length(term) >= 3 and regexp_matches(term, '^[\p{{L}}\-]+$') and term not in {STOP} group by 1")
def valid_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.valid_keywords(tokens(spark, sf_dir).withColumnRenamed("term", "phrase")).groupBy("phrase").agg(F.count("*").alias("n"))


@query(rf"with {PARTS} select doc_id, array_to_string(list_sort(regexp_extract_all(lower(annotation), '[\p{{L}}0-9]+')), ' ') as phrase, array_to_string(list_sort(regexp_extract_all(lower(annotation), '[\p{{L}}]+')), ' ') as letters_only from parts")
def normalize_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("annotation")
    return parts(spark, sf_dir).select("doc_id", T.phrase_id(a, True, "\\p{L}").alias("phrase"), T.phrase_id(a, False, "\\p{L}").alias("letters_only"))


SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[.!?]\s+$', ''), '[.!?]\s+([^\p{Ll}\p{Lo}\p{N}\s])', chr(1) || '\1', 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"""


@query(f"select doc_id, len(s)::int as n, array_to_string(s, ' / ') as parts from (select doc_id, {SENTENCES} as s from documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n"), F.array_join("s", " / ").alias("parts"))


@query(f"select doc_id, idx, s as text from (select doc_id, unnest(s) as s, unnest(range(len(s)))::int as idx from (select doc_id, {SENTENCES} as s from documents)) where len(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+')) between 8 and 60")
def sentence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.numbered_sentences(T.sentences(F.col("text")))).alias("s"))
    return kept.select("doc_id", "s.idx", "s.text")


def summary_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = top_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(keys, "doc_id", "left").select("doc_id", "text", F.coalesce(F.transform("k", lambda x: x["term"]), F.array().cast("array<string>")).alias("keywords"))


@query(TFIDF + rf""", s as (select doc_id, idx, s, list_distinct(w) as u, len(w) as nw from (select doc_id, idx, s, regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+') as w from (select doc_id, unnest(s) as s, unnest(range(len(s)))::int as idx from (select doc_id, {SENTENCES} as s from documents))) where len(w) between 8 and 60)
select s.doc_id, s.idx, round(sum(case when list_contains(s.u, top.term) then 11 - top.rank else 0 end) / sqrt(any_value(s.nw)), 6) as score from s join top on top.doc_id = s.doc_id and top.rank <= 10 group by 1, 2""")
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = summary_inputs(spark, sf_dir).filter(F.size("keywords") > 0).select("doc_id", "keywords", T.numbered_sentences(T.sentences(F.col("text"))).alias("s"))
    scored = step.select("doc_id", "s", summarize.sentence_scores(F.transform("s", lambda x: T.words(x["text"])), F.col("keywords")).alias("v"))
    return scored.select("doc_id", F.explode(F.arrays_zip(F.transform("s", lambda x: x["idx"]).alias("idx"), F.col("v").alias("v"))).alias("x")).select("doc_id", "x.idx", F.round("x.v", 6).alias("score"))


@query(rf"with {PARTS} select doc_id, array_to_string(list_filter(list_transform(string_split_regex(rtrim(trim(replace(annotation, chr(10), ' ')), '.'), '[,;]\s*'), lambda k: regexp_replace(lower(trim(k)), '\s+', ' ', 'g')), lambda k: k <> '' and length(k) <= 60 and len(string_split(k, ' ')) <= 6 and not contains(k, 'doi:') and not contains(k, 'http') and not contains(k, '//') and not contains(k, '№') and not contains(k, ' c. ')), ';') as keywords from parts")
def clean_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("doc_id", F.array_join(T.keyword_list(F.col("annotation")), ";").alias("keywords"))


@query(r"select doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '[\s]+', ' ', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> ''), chr(10) || chr(10)) as body from documents")
def spacing_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squeeze_spacing(F.col("text")).alias("body"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(broken, '(^|[^а-яёА-ЯЁa-zA-Z])(?i:(multi|anti|sub|co|non|pre|post|micro|macro|semi|self))-\s*\n\s*([а-яёА-ЯЁa-zA-Z]+)', '\1\2' || chr(1) || '\3', 'g'), '([а-яёА-ЯЁa-zA-Z]+)-\s*\n\s*([а-яёА-ЯЁa-zA-Z]+)', '\1\2', 'g').replace(chr(1), '-')) as joined from (select doc_id, 'x ' || regexp_replace(lower(text), ' ([a-z]{2,4})([a-z]{3}) ', ' \1-' || chr(10) || '\2 ', 'g') as broken from documents)""")
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("x "), F.regexp_replace(F.lower("text"), " ([a-z]{2,4})([a-z]{3}) ", " $1-\n$2 "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.join_hyphens(broken).cast("binary")).alias("joined"))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, method, found (top terms), wanted (first eight longer words of the annotation)."""
    top = top_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    long_words = F.filter(T.words(F.col("annotation"), "\\p{L}"), lambda w: F.length(w) >= 5)
    wanted = parts(spark, sf_dir).select("doc_id", F.slice(F.array_distinct(long_words), 1, 8).alias("wanted"))
    return wanted.join(top, "doc_id").select("doc_id", F.lit("tfidf").alias("method"), F.transform("k", lambda x: x["term"]).alias("found"), "wanted")


PAIRS = TFIDF + rf""", {PARTS}, f as (select doc_id, list(term order by rank) as found from top where rank <= 10 group by 1),
a as (select doc_id, list_distinct_ordered as wanted from (select doc_id, (list_filter(w, lambda x, i: list_position(w, x) = i))[1:8] as list_distinct_ordered from (select doc_id, list_filter(regexp_extract_all(lower(annotation), '[\p{{L}}]+'), lambda x: length(x) >= 5) as w from parts))),
pairs as (select f.doc_id, found, wanted from f join a using (doc_id)),
cut as (select doc_id, kk, found[1:kk] as found, wanted from pairs, (values (5), (10)) v(kk)),
m as (select doc_id, kk as k, case when len(wanted) = 0 then 0.0 else len(list_filter(found, lambda x: list_contains(wanted, x))) / len(found) end as p, case when len(wanted) = 0 then 0.0 else len(list_filter(found, lambda x: list_contains(wanted, x))) / len(wanted) end as r from cut)
"""


@query(PAIRS + "select doc_id, k, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 9) as f1 from m")
def keyword_exact_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluate.keyword_metrics(term_pairs(spark, sf_dir), matches=("exact",))
    return scored.select("doc_id", "k", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(PAIRS + "select doc_id, k, round(p, 9) as precision, round(r, 9) as recall from m")
def keyword_soft_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single words: soft and exact precision and recall agree."""
    scored = evaluate.keyword_metrics(term_pairs(spark, sf_dir), matches=("soft",))
    return scored.select("doc_id", "k", *[F.round(c, 9).alias(c) for c in ("precision", "recall")])


@query(PAIRS + "select 'tfidf' as method, k, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end), 6) as f1 from m group by k")
def keyword_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = evaluate.keyword_averages(evaluate.keyword_metrics(term_pairs(spark, sf_dir), matches=("exact",)))
    return mean.select("method", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, cand, ref: the words of consecutive turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("cand"))
    return turns.withColumn("ref", F.lag("cand").over(w)).filter("ref is not null").select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "cand", "ref")


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("cand"))
    return turns.withColumn("ref", F.lag("cand").over(w)).filter("ref is not null").select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), "cand", "ref")


def _turn_sql(n: int) -> str:
    gram = "array_to_string(x.w[i : i + " + str(n - 1) + "], ' ')"
    return rf"""with t as (select conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from conversations),
p as (select conv_id || '-' || turn as pair_id, w as cand, lag(w) over (partition by conv_id order by turn) as ref from t),
q as (select * from p where ref is not null),
c as (select pair_id, {gram} as g, count(*) as n from (select pair_id, cand as w, unnest(range(1, len(cand) - {n - 2})) as i from q) x group by all),
r as (select pair_id, {gram} as g, count(*) as n from (select pair_id, ref as w, unnest(range(1, len(ref) - {n - 2})) as i from q) x group by all),
h as (select pair_id, sum(least(c.n, r.n)) as hits from c join r using (pair_id, g) group by 1),
s as (select pair_id, case when len(cand) >= {n} then coalesce(hits, 0) / (len(cand) - {n - 1}) else 0 end as p, case when len(ref) >= {n} then coalesce(hits, 0) / (len(ref) - {n - 1}) else 0 end as r from q left join h using (pair_id)),
f as (select pair_id, p as precision, r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1 from s)
"""


ROUND9 = "round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1"


def _rounded(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(_turn_sql(1) + f"select pair_id, {ROUND9} from f")
def rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.rouge_n(turn_pairs(spark, sf_dir), 1), "pair_id")


@query(_turn_sql(2) + f"select pair_id, {ROUND9} from f")
def rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.rouge_n(turn_pairs(spark, sf_dir), 2), "pair_id")


@query(_turn_sql(1) + "select 'rouge1' as metric, round(coalesce(avg(precision), 0), 6) as precision, round(coalesce(avg(recall), 0), 6) as recall, round(coalesce(avg(f1), 0), 6) as f1 from f")
def rouge_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.rouge_n(turn_pairs(spark, sf_dir), 1).withColumn("metric", F.lit("rouge1"))
    return evaluate.rouge_averages(scores, "metric").select("metric", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(r"""select page_id, cast(i as int) as i, link, string_split(link, '/')[-1] as name from (select page_id, unnest(l) as link, unnest(range(len(l))) as i from (select page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) as l from pages))""")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(readers.links(F.col("html"))).alias("i", "link"))
    return found.withColumn("name", T.last_segment(F.col("link")))


@query("""with v as (select vec_id, cast(embedding as double[]) as e from embeddings), q as (select * from v where vec_id = 0)
select v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) as score from v, q where v.vec_id <> 0 order by list_cosine_similarity(q.e, v.e) desc, v.vec_id limit 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = vectors.filter("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", semantic.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@query()
def semantic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten diverse phrases of each document; as the feature is, of its first 5,000 characters."""
    return semantic.semantic_keywords(table(spark, sf_dir, "documents"), lexicon.is_valid_keyword)


def terms_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """Documents and their ten heaviest terms as a graph; its edges are read several times from the written terms."""
    top = top_terms(spark, sf_dir)
    docs = parts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("annotation").alias("title"), "annotation")
    edges = top.select(F.col("doc_id").alias("pub_id"), F.col("term").alias("keyword_id"), F.lit("tfidf").alias("method"), graph.edge_weight(F.lit("tfidf"), F.col("rank") - 1).alias("weight"))
    words = edges.select(F.col("keyword_id").alias("id")).distinct().select("id", T.upper_first(F.col("id")).alias("name"), F.array(F.lit("tfidf")).alias("methods"))
    return graph.Graph(docs, words, edges)


@query(TFIDF + """, e as (select doc_id, term from top where rank <= 10), a as (select min(doc_id) as a from e),
o as (select e.doc_id, e.term from e, a where doc_id <> a and term in (select term from e, a where doc_id = a)),
z as (select doc_id, count(*) as score, array_to_string(list_sort(list(upper(substr(term, 1, 1)) || substr(term, 2))), '|') as shared from o group by 1)
select doc_id as id, score, shared from z order by score desc, doc_id limit 10""")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents that share most terms with the first one that has any."""
    g = terms_graph(spark, sf_dir)
    anchor = g.has_keyword.agg(F.min("pub_id"))
    return search.similar_documents(g, anchor).select("id", "score", F.array_join("shared", "|").alias("shared"))


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termweave.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select("event_type", "start", "n", F.round("total", 4).alias("total"))


class Stopped(RuntimeError):
    """What stops a stream or a run in a query that shows its restart."""


GATED = TFIDF.replace("with tok as", r"""with ok as (select * from documents where length(text) >= 100 and length(regexp_replace(text, '[^\x{0400}-\x{04FF}a-zA-Z0-9 \t\n\r.,;:!?()\-"''/\[\]{}+=<>@#$%&*_~\\]', '', 'g')) / length(text) >= 0.75),
tok as""").replace("from documents)", "from ok)").replace("n from documents", "n from ok")


@query(GATED + ", e as (select term, doc_id from top where rank <= 10) select term, count(*) as documents, min(doc_id) as first from e group by 1")
def staged_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable documents, their keywords and the keywords' documents, in stages; the run is killed behind the second and goes on."""
    from termweave.plans.stages import Runner, Stage

    def keywords(tables: dict[str, DataFrame]) -> DataFrame:
        return tfidf.top_of_documents(tables["corpus"], F.col("text"))

    stages = [
        Stage("corpus", ("documents",), lambda t: t["documents"].filter(T.is_readable(F.col("text"))).select("doc_id", "text")),
        Stage("keywords", ("corpus",), keywords),
        Stage("graph", ("keywords",), lambda t: t["keywords"].groupBy("term").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))),
    ]
    runner = Runner(spark, scratch.new_path(spark, "stages"), {"documents": f"{sf_dir}/documents.parquet"}, stages)

    def kill(name: str) -> None:
        if name == "keywords":
            raise Stopped

    with contextlib.suppress(Stopped):
        runner.run(ended=kill)
    runner.run()
    return runner.result("graph")


def _run_with_restart(start) -> None:
    """Runs a stream, lets it fail behind its second micro-batch before that is committed, and runs it to its end."""

    def stop(number: int) -> None:
        if number == 1:
            raise Stopped

    try:
        start(stop).awaitTermination()
    except StreamingQueryException as e:
        if Stopped.__name__ not in str(e):
            raise
    start(None).awaitTermination()


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_rollup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals of a stream whose files come in any order of time, with a failure and a restart on the way."""
    from termweave.streaming import ingest

    path = scratch.new_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(6, "event_id").write.parquet(f"{path}/in")
    totals = ingest.rollup(spark, f"{path}/totals").create(spark)
    _run_with_restart(lambda stop: ingest.into_table(ingest.event_stream(spark, f"{path}/in"), totals, f"{path}/checkpoint", ingest.hourly, stop))
    return ingest.rolled_up(totals, spark).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with o as (select *, ts - lag(ts) over (partition by user_id order by ts) as gap from events where user_id is not null),
s as (select *, sum(case when gap is null or gap > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as session from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n, round(sum(value), 4) as total from s group by user_id, session""")
def user_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream whose events come up to an hour late and twice in part, with a failure and a restart on the way."""
    from termweave.streaming import ingest

    path = scratch.new_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    again = events.filter("event_id % 7 = 0")  # come a second time, a row each
    ingest.feed(events.unionByName(again), f"{path}/in", 6, jitter=3600, end=True)
    found = ingest.session_table(spark, f"{path}/sessions").create(spark)
    _run_with_restart(lambda stop: ingest.into_table(ingest.sessions(ingest.event_stream(spark, f"{path}/in")), found, f"{path}/checkpoint", watch=stop))
    return found.rows(spark).select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n", F.round("total", 4).alias("total"))
