"""Graph queries over the relational tables, each with its SQL.

Documents are orders, keywords are parts, and a line item links them: its return
flag is the method, its quantity the weight.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import graph as G
from termweave.operators import search as S
from termweave.sources import layout, scratch


def orders_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("annotation"))
    words = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("methods"))
    edges = read("lineitem").select(F.col("l_orderkey").alias("pub_id"), F.col("l_partkey").alias("keyword_id"), F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("weight"))
    return G.Graph(docs, words, edges)


CTE = """with d as (select o_orderkey as id, o_orderpriority || ' ' || o_orderkey as title, o_orderstatus as annotation from orders),
k as (select p_partkey as id, p_name as name, p_brand as brand from part),
e as (select l_orderkey as pub_id, l_partkey as keyword_id, l_returnflag as method, l_quantity as weight from lineitem),
o as (select keyword_id, pub_id, count(*) as n from e group by all),
p as (select a.pub_id as d1, b.pub_id as d2, sum(a.n * b.n)::bigint as paths, count(*) as shared
      from o a join o b on a.keyword_id = b.keyword_id and a.pub_id < b.pub_id group by all)
"""
ANCHOR, QUERY, TERM = 42, "red", 7

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of a Graph with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(orders_graph(spark, sf_dir))
        SQL[f.__name__] = CTE + sql
        return f

    return add


@query("select (select count(*) from d) as documents, (select count(*) from k) as keywords, (select count(*) from e) as edges, 0::bigint as similar")
def stats(g: G.Graph) -> DataFrame:
    return S.stats(g)


@query(f"""select d.id, d.title, coalesce(len(x.names), 0)::int as n_keywords, coalesce(array_to_string(x.names, '|'), '') as names from
(select * from d where contains(lower(title), '{QUERY}') or contains(lower(annotation), '{QUERY}') or id in (select pub_id from e join k on e.keyword_id = k.id where contains(lower(k.name), '{QUERY}')) order by title nulls last, id offset 15 limit 15) d
left join (select pub_id, list_sort(list(k.name)) as names from e join k on e.keyword_id = k.id group by pub_id) x on x.pub_id = d.id""")
def search_docs(g: G.Graph) -> DataFrame:
    found = S.search_documents(g, QUERY, S.Page.of(2, 15))
    return found.select("id", "title", F.size("keywords").alias("n_keywords"), F.array_join(F.array_sort(F.transform("keywords", lambda k: k["name"])), "|").alias("names"))


@query(f"select count(*) as total, greatest(1, ceil(count(*) / 15.0))::bigint as total_pages from d where contains(lower(title), '{QUERY}') or contains(lower(annotation), '{QUERY}') or id in (select pub_id from e join k on e.keyword_id = k.id where contains(lower(k.name), '{QUERY}'))")
def search_docs_count(g: G.Graph) -> DataFrame:
    return S.matching_documents(g, QUERY).agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 15)).cast("long"))


@query("select d.id, d.title from d order by title nulls last, id limit 15")
def first_page(g: G.Graph) -> DataFrame:
    return S.matching_documents(g).orderBy(F.asc_nulls_last("title"), "id").limit(15).select("id", "title")


@query(f"select k.id, k.name, method, weight from e join k on k.id = keyword_id where pub_id = {ANCHOR}")
def doc_keywords_ordered(g: G.Graph) -> DataFrame:
    return S.document_keywords(g, ANCHOR)


@query(f"""select t.pub_id as id, d.title, t.score, t.shared from (select b.pub_id, count(distinct b.keyword_id) as score, array_to_string(list_sort(list(distinct k.name)), '|') as shared
from e b join k on k.id = b.keyword_id where b.pub_id <> {ANCHOR} and b.keyword_id in (select keyword_id from e where pub_id = {ANCHOR}) group by 1 order by 2 desc, 1 limit 10) t join d on d.id = t.pub_id""")
def similar_docs_distinct(g: G.Graph) -> DataFrame:
    return S.similar_documents(g, ANCHOR).withColumn("shared", F.array_join("shared", "|"))


@query(f"select b.pub_id as id, count(*) as paths from e a join e b on a.keyword_id = b.keyword_id and a.pub_id <> b.pub_id where a.pub_id = {ANCHOR} group by 1 order by 2 desc, 1 limit 10")
def similar_docs_paths(g: G.Graph) -> DataFrame:
    mine = g.has_keyword.filter(F.col("pub_id") == ANCHOR).groupBy("keyword_id").agg(F.count("*").alias("n"))
    others = g.has_keyword.filter(F.col("pub_id") != ANCHOR).join(mine, "keyword_id")
    return others.groupBy(F.col("pub_id").alias("id")).agg(F.sum("n").alias("paths")).orderBy(F.desc("paths"), "id").limit(10)


@query("select d1, d2, paths as shared_count from p where paths >= 2 order by 3 desc, 1, 2 limit 10")
def top_pairs_paths(g: G.Graph) -> DataFrame:
    return S.top_pairs(g)


@query("select d1, d2, shared as shared_count from p where shared >= 2 order by 3 desc, 1, 2 limit 25")
def top_pairs_shared(g: G.Graph) -> DataFrame:
    return S.top_pairs(g, k=25, paths=False)


@query("select d1, d2, paths, shared from p where shared >= 2")
def cooccur_pairs_ge2(g: G.Graph) -> DataFrame:
    return G.pairs_sharing_two(g.has_keyword.groupBy("pub_id", "keyword_id").agg(F.count("*").alias("n")))


@query("select t.d1, t.d2, e.keyword_id, e.method, e.weight from (select * from p where paths >= 2 order by paths desc, d1, d2 limit 10) t join e on e.pub_id = t.d1 where e.keyword_id in (select keyword_id from e x where x.pub_id = t.d2)")
def edges_of_top_pairs(g: G.Graph) -> DataFrame:
    top = F.broadcast(S.top_pairs(g).select("d1", "d2"))
    left = g.has_keyword.join(top, F.col("pub_id") == F.col("d1")).select("d1", "d2", "keyword_id", "method", "weight")
    right = g.has_keyword.join(top.select(F.col("d2").alias("r2")).distinct(), F.col("pub_id") == F.col("r2")).select(F.col("r2").alias("d2"), "keyword_id").distinct()
    return left.join(right, ["d2", "keyword_id"], "left_semi").select("d1", "d2", "keyword_id", "method", "weight")


@query("select d1, d2, paths, shared from p where paths >= 3")
def bucketed_two_hops(g: G.Graph) -> DataFrame:
    """Pairs by common keywords from a stored layout in which edges that meet lie together."""
    spark = g.has_keyword.sparkSession
    store = layout.write(g, f"hops_{uuid.uuid4().hex}", scratch.new_path(spark, "layout"))
    return store.pairs_of_paths(3)


@query("select keyword_id, count(*) as cnt from e group by 1 order by 2 desc, 1 limit 10")
def top_keywords_rows(g: G.Graph) -> DataFrame:
    return S.top_keywords(g)


@query("select keyword_id, count(distinct pub_id) as cnt from e group by 1 order by 2 desc, 1 limit 10")
def top_keywords_distinct(g: G.Graph) -> DataFrame:
    return S.top_keywords(g, distinct=True)


@query("select * from e where keyword_id in (select keyword_id from e group by 1 order by count(*) desc, 1 limit 10)")
def edges_of_top_keywords(g: G.Graph) -> DataFrame:
    return S.edges_of_top(g, S.top_keywords(g)).select("pub_id", "keyword_id", "method", "weight")


@query("select pub_id, count(*) as cnt from e group by 1 order by 2 desc, 1 limit 10")
def docs_most_keywords(g: G.Graph) -> DataFrame:
    return S.documents_with_most(g)


@query("select k.id, k.name, k.brand, count(distinct pub_id) as pub_count from e join k on k.id = keyword_id group by all")
def keyword_facets(g: G.Graph) -> DataFrame:
    return S.keyword_facets(g).select("id", "name", F.array_join("methods", ",").alias("brand"), "pub_count")


@query(f"select k.id, k.name, count(distinct pub_id) as pub_count from e join k on k.id = keyword_id where method = 'R' and contains(lower(k.name), '{QUERY}') group by all order by 3 desc, 1 limit 30 offset 30")
def keyword_facets_by_method(g: G.Graph) -> DataFrame:
    return S.facet_page(S.keyword_facets(g, QUERY, "R"), S.Page.of(2, 30, 100)).select("id", "name", "pub_count")


@query(f"select d.id, d.title, method, weight from e join d on d.id = pub_id where keyword_id = {TERM}")
def keyword_detail(g: G.Graph) -> DataFrame:
    return S.keyword_documents(g, TERM)


@query(f"select e.* from e join k on k.id = keyword_id join d on d.id = pub_id where contains(lower(d.title), '{QUERY}') or contains(lower(d.annotation), '{QUERY}') or contains(lower(k.name), '{QUERY}') order by pub_id, keyword_id, method, weight limit 200")
def search_subgraph(g: G.Graph) -> DataFrame:
    return S.search_subgraph(g, QUERY)


@query(f"select e.* from e join k on k.id = keyword_id where contains(lower(k.name), '{QUERY}') order by pub_id, keyword_id, method, weight limit 150")
def search_subgraph_keywords(g: G.Graph) -> DataFrame:
    return S.search_subgraph(g, QUERY, "keywords")


@query(f"select * from e where keyword_id in (select keyword_id from e where pub_id = {ANCHOR}) union all select {ANCHOR}, null, null, null where not exists (select 1 from e where pub_id = {ANCHOR})")
def ego_network(g: G.Graph) -> DataFrame:
    return S.ego_network(g, ANCHOR)


@query("select pub_id, method, array_to_string(list_sort(list(k.name)), '|') as names from e join k on k.id = keyword_id group by 1, 2")
def kw_by_doc_method(g: G.Graph) -> DataFrame:
    return S.keywords_by_method(g).withColumn("names", F.array_join("names", "|"))


@query("select pub_id, array_to_string(list_sort(list(k.name)), '|') as names from e join k on k.id = keyword_id where method = 'A' group by 1")
def author_kws_per_doc(g: G.Graph) -> DataFrame:
    return S.keywords_by_method(g).filter("method = 'A'").select("pub_id", F.array_join("names", "|").alias("names"))


@query("""select name as keyword_id, upper(substr(first, 1, 1)) || substr(first, 2) as name, methods from (
select k.name, arg_min(k.brand, (-c, f)) as first, any_value(m.methods) as methods from (
select k.name, k.brand, count(*) as c, min((e.pub_id, e.keyword_id, e.weight)) as f from e join k on k.id = keyword_id group by 1, 2) k
join (select k.name, array_to_string(list_sort(list(distinct method)), ',') as methods from e join k on k.id = keyword_id group by 1) m using (name) group by 1)""")
def keyword_nodes_best_spelling(g: G.Graph) -> DataFrame:
    named = g.has_keyword.join(g.keywords.select(F.col("id").alias("kid"), "name", F.get("methods", F.lit(0)).alias("spelling")), F.col("keyword_id") == F.col("kid"))
    mentions = named.select(F.col("name").alias("keyword_id"), "spelling", "method", F.struct("pub_id", "kid", "weight").alias("seq"))
    return G.keyword_vertices(mentions).select(F.col("id").alias("keyword_id"), "name", F.array_join("methods", ",").alias("methods"))


@query("select keyword_id, array_to_string(list_sort(list(distinct method)), ',') as methods, max(method = 'A') as has_a, max(method = 'N') as has_n from e group by 1")
def methods_set(g: G.Graph) -> DataFrame:
    sets = g.has_keyword.groupBy("keyword_id").agg(F.array_sort(F.collect_set("method")).alias("m"))
    return sets.select("keyword_id", F.array_join("m", ",").alias("methods"), F.array_contains("m", "A").alias("has_a"), F.array_contains("m", "N").alias("has_n"))


JACCARD = """select d1 as source, d2 as target, round(shared / (a.n + b.n - shared), 9) as score from p
join (select pub_id, count(distinct keyword_id) as n from e group by 1) a on a.pub_id = d1 join (select pub_id, count(distinct keyword_id) as n from e group by 1) b on b.pub_id = d2
where shared / (a.n + b.n - shared) >= """


@query(JACCARD + "0.2")
def similar_to_jaccard(g: G.Graph) -> DataFrame:
    return G.similar_to(g.has_keyword, 0.2).withColumn("score", F.round("score", 9))


@query(JACCARD + "0.05")
def similar_to_loose(g: G.Graph) -> DataFrame:
    return G.similar_to(g.has_keyword, 0.05).withColumn("score", F.round("score", 9))


@query(JACCARD + "0.5")
def similar_to_close(g: G.Graph) -> DataFrame:
    return G.similar_to(g.has_keyword, 0.5).withColumn("score", F.round("score", 9))


@query("select d.id, count(e.keyword_id) as n, count(distinct e.keyword_id) as terms from d left join e on e.pub_id = d.id group by 1")
def optional_match_docs(g: G.Graph) -> DataFrame:
    joined = g.documents.join(g.has_keyword.withColumnRenamed("pub_id", "id"), "id", "left")
    return joined.groupBy("id").agg(F.count("keyword_id").alias("n"), F.countDistinct("keyword_id").alias("terms"))


@query("select * from e where pub_id in (select id from d where annotation = 'F') and keyword_id in (select id from k where contains(name, 'bolt'))")
def edge_endpoint_semi(g: G.Graph) -> DataFrame:
    """Edges whose ends are known, where finished orders are the documents and bolts the keywords."""
    return G.with_endpoints(g.has_keyword, g.documents.filter("annotation = 'F'"), g.keywords.filter(F.contains("name", F.lit("bolt")))).select("pub_id", "keyword_id", "method", "weight")


@query("select d.id, coalesce(array_to_string(list_sort(list(k.name)), '|'), '') as names from (select * from d order by title nulls last, id limit 15) d left join e on e.pub_id = d.id left join k on k.id = e.keyword_id group by 1")
def late_materialised_page(g: G.Graph) -> DataFrame:
    return S.search_documents(g, "", S.Page.of(1, 15)).select("id", F.array_join(F.array_sort(F.transform("keywords", lambda k: k["name"])), "|").alias("names"))


@query("""select * from (select 'document' as kind, id::varchar as id, title as label, 0::bigint as n from d where contains(lower(title), 'high') order by title nulls last, d.id limit 5)
union all select * from (select 'keyword', k.id::varchar, k.name, count(distinct pub_id) as c from e join k on k.id = keyword_id where contains(lower(k.name), 'high') group by k.id, k.name order by c desc, k.id limit 5)""")
def combined_search(g: G.Graph) -> DataFrame:
    return S.combined_search(g, "HIGH")


@query("""select pub_id, case when len(a) > 0 then array_to_string(a[1:5], ', ') else array_to_string(n[1:5], ', ') end as badges, len(a)::int as own from (
select pub_id, coalesce(list_sort(list(keyword_id) filter (method = 'A')), []) as a, coalesce(list_sort(list(keyword_id) filter (method = 'N')), []) as n from e group by 1)""")
def badge_fallback(g: G.Graph) -> DataFrame:
    kinds = g.has_keyword.groupBy("pub_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("method") == m, F.col("keyword_id")))).alias(c) for m, c in (("A", "a"), ("N", "n"))])
    return kinds.select("pub_id", F.array_join(T.badges(F.col("a"), F.col("n")).cast("array<string>"), ", ").alias("badges"), F.size("a").alias("own"))


@query("""select pub_id, array_to_string(names[1:5], ', ') || case when len(names) > 5 then ' (+' || (len(names) - 5) || ')' else '' end as label from (select pub_id, list_sort(list(distinct k.name)) as names from e join k on k.id = keyword_id group by 1)""")
def shared_label(g: G.Graph) -> DataFrame:
    names = S.keywords_by_method(g).groupBy("pub_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    return names.select("pub_id", T.first_and_more(F.col("names")).alias("label"))


@query("""select k.id, case when trim(brand) <> '' then brand when trim(name) <> '' then name else '' end as shown, case when length(name) > 8 then substr(name, 1, 8) || '...' else name end as tip from (select id, name, translate(brand, 'Brand#123', '         ') as brand from k) k""")
def display_fallback(g: G.Graph) -> DataFrame:
    """A text that is blank for some rows, or the name in its place; a short tip."""
    text = F.translate(F.get("methods", F.lit(0)), "Brand#123", "         ")
    return g.keywords.select("id", T.display_text(text, F.col("name")).alias("shown"), T.tooltip(F.col("name"), 8).alias("tip"))
