"""Search, detail and facet queries over a Graph.  All orders are total: ids break ties."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators import toppairs
from termweave.operators.graph import Graph, expanded
from termweave.sources.gramindex import GramIndex, build


@dataclass(frozen=True)
class Page:
    number: int
    size: int

    @classmethod
    def of(cls, number: int = 1, size: int = 15, most: int = 50) -> Page:
        return cls(max(1, number), min(most, max(1, size)))

    @property
    def skip(self) -> int:
        return (self.number - 1) * self.size

    def pages(self, total: int) -> int:
        return max(1, math.ceil(total / self.size))

    def window(self, total: int, most: int = 7) -> list[int | None]:
        """The page numbers to offer: ``most`` around this one, the first and the last; None is a gap."""
        last = self.pages(total)
        if last == 1:
            return []
        low = min(max(1, self.number - most // 2), max(1, last - most + 1))
        high = min(last, low + most - 1)
        before = [1, None][: min(low - 1, 2)]
        after = [None, last][2 - min(last - high, 2) :]
        return [*before, *range(low, high + 1), *after]


def window_column(number: Column, pages: Column, most: int = 7) -> Column:
    """``Page.window`` of columns: an array of page numbers, null for a gap."""
    low = F.least(F.greatest(F.lit(1), number - most // 2), F.greatest(F.lit(1), pages - most + 1))
    high = F.least(pages, low + most - 1)
    gap, none = F.array(F.lit(None).cast("int")), F.array().cast("array<int>")
    before = F.when(low > 2, F.concat(F.array(F.lit(1)), gap)).when(low > 1, F.array(F.lit(1))).otherwise(none)
    after = F.when(high < pages - 1, F.concat(gap, F.array(pages))).when(high < pages, F.array(pages)).otherwise(none)
    return F.when(pages <= 1, none).otherwise(F.concat(before, F.sequence(low, high), after))


def has(column: str, query: str) -> Column:
    return F.lower(F.col(column)).contains(query.lower())


@dataclass(frozen=True)
class SearchIndex:
    """Indexes of grams over the titles and annotations of documents and the names of keywords."""

    titles: GramIndex
    annotations: GramIndex
    names: GramIndex

    @classmethod
    def of(cls, g: Graph, folder: str) -> SearchIndex:
        """Writes the three indexes to a folder."""
        text = lambda df, c: df.select("id", F.col(c).alias("text"))
        return cls(build(text(g.documents, "title"), f"{folder}/titles"), build(text(g.documents, "annotation"), f"{folder}/annotations"), build(text(g.keywords, "name"), f"{folder}/names"))


def _named(g: Graph, query: str, index: SearchIndex | None) -> DataFrame:
    """The keywords whose name holds the query."""
    return g.keywords.filter(has("name", query)) if index is None else g.keywords.join(index.names.ids(g.keywords.sparkSession, query), "id", "left_semi")


def stats(g: Graph) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(g.documents, "documents").crossJoin(one(g.keywords, "keywords")).crossJoin(one(g.has_keyword, "edges"))
    return counts.withColumn("similar", F.lit(0).cast("long")) if g.similar is None else counts.crossJoin(one(g.similar, "similar"))


def matching_documents(g: Graph, query: str = "", index: SearchIndex | None = None) -> DataFrame:
    """Documents whose title, annotation or some keyword's name holds the query; all for a blank one.

    With an index only the buckets of the query's grams and the texts they leave are read; without one all are.
    """
    query = query.strip().lower()
    if not query:
        return g.documents
    names = _named(g, query, index).select(F.col("id").alias("keyword_id"))
    named = g.has_keyword.join(names, "keyword_id", "left_semi").select(F.col("pub_id").alias("id")).distinct()
    if index is not None:
        spark = g.documents.sparkSession
        found = index.titles.ids(spark, query).union(index.annotations.ids(spark, query)).union(named).distinct()
        return g.documents.join(found, "id", "left_semi")
    found = g.documents.join(named.withColumn("by_name", F.lit(True)), "id", "left")
    return found.filter(has("title", query) | has("annotation", query) | F.col("by_name")).drop("by_name")


def search_documents(g: Graph, query: str = "", page: Page = Page(1, 15), index: SearchIndex | None = None) -> DataFrame:
    """One page of matches by title, each with its keywords as an array of (name, method, weight)."""
    rows = matching_documents(g, query, index).orderBy(F.asc_nulls_last("title"), "id").offset(page.skip).limit(page.size)
    # the page is small and fixed in size: it is broadcast to the edges
    its = g.has_keyword.join(F.broadcast(rows.select(F.col("id").alias("pub_id"))), "pub_id").join(g.keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id")
    nested = its.groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("method", (-F.col("weight")).alias("low"), "name"))).alias("k"))
    k = F.transform("k", lambda x: F.struct(x["name"].alias("name"), x["method"].alias("method"), (-x["low"]).alias("weight")))
    empty = F.array().cast("array<struct<name:string,method:string,weight:double>>")
    return rows.join(nested.withColumnRenamed("pub_id", "id"), "id", "left").withColumn("keywords", F.coalesce(k, empty)).drop("k")


def with_authors(rows: DataFrame, authors: DataFrame) -> DataFrame:
    """A page of rows (id, ...) with each document's ``authors`` (id, authors), [] for unknown ones.

    The page is small and fixed in size, the table of authors is not: the page's
    ids are broadcast to it, and what is left is joined to the page.
    """
    page = rows.select("id").distinct()
    some = authors.join(F.broadcast(page), "id", "left_semi").groupBy("id").agg(F.min("authors").alias("authors"))
    return rows.join(some, "id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def document_keywords(g: Graph, pub_id) -> DataFrame:
    return expanded(Graph(g.documents, g.keywords, g.has_keyword.filter(F.col("pub_id") == F.lit(pub_id)))).select(F.col("k_id").alias("id"), F.col("k_name").alias("name"), "method", "weight").orderBy("method", F.desc("weight"), "id")


def similar_documents(g: Graph, pub_id, k: int = 10, names: bool = True) -> DataFrame:
    """The k documents that share most distinct keywords with one: id, title, score, shared names.

    ``pub_id`` is an id, or a DataFrame of one row that holds it.
    """
    if isinstance(pub_id, DataFrame):  # one row, so it is broadcast
        marked = g.has_keyword.join(F.broadcast(pub_id.toDF("_anchor")), F.lit(True)).withColumn("_own", F.col("pub_id") == F.col("_anchor"))
    else:
        marked = g.has_keyword.withColumn("_own", F.col("pub_id") == F.lit(pub_id))
    mine = marked.filter("_own").select("keyword_id").distinct()
    others = marked.filter("not _own").join(mine, "keyword_id", "left_semi").select("pub_id", "keyword_id").distinct()
    top = others.groupBy("pub_id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "pub_id").limit(k)
    if names:
        shared = others.join(F.broadcast(top), "pub_id").join(g.keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id")
        top = shared.groupBy("pub_id", "score").agg(F.array_sort(F.collect_set("name")).alias("shared"))
    return top.join(g.documents.select(F.col("id").alias("pub_id"), "title"), "pub_id").withColumnRenamed("pub_id", "id")


def keyword_facets(g: Graph, query: str = "", method: str = "all", index: SearchIndex | None = None) -> DataFrame:
    """Keywords by the number of documents linked to them (by the method, if one is named)."""
    edges = g.has_keyword if method in ("", "all") else g.has_keyword.filter(F.col("method") == method)
    names = g.keywords if not query.strip() else _named(g, query.strip(), index)
    joined = edges.join(names.select(F.col("id").alias("keyword_id"), "name", "methods"), "keyword_id")
    return joined.groupBy(F.col("keyword_id").alias("id"), "name", "methods").agg(F.countDistinct("pub_id").alias("pub_count"))


def facet_page(facets: DataFrame, page: Page = Page(1, 30)) -> DataFrame:
    return facets.orderBy(F.desc("pub_count"), "id").offset(page.skip).limit(page.size)


def keyword_documents(g: Graph, keyword_id) -> DataFrame:
    one = Graph(g.documents, g.keywords.filter(F.col("id") == F.lit(keyword_id)), g.has_keyword.filter(F.col("keyword_id") == F.lit(keyword_id)))
    return expanded(one).select(F.col("d_id").alias("id"), F.col("d_title").alias("title"), "method", "weight").orderBy("method", "title", "id", "weight")


def search_subgraph(g: Graph, query: str, kind: str = "publications") -> DataFrame:
    """Matching edges as (pub_id, keyword_id, method, weight); a name match takes only the edges to that keyword."""
    rows = expanded(g)
    name = has("k_name", query)
    match, most = (name, 150) if kind == "keywords" else (has("d_title", query) | has("d_annotation", query) | name, 200)
    return rows.filter(match).select("pub_id", "keyword_id", "method", "weight").orderBy("pub_id", "keyword_id", "method", "weight").limit(most)


def top_pairs(g: Graph, least: int = 2, k: int = 10, paths: bool = True) -> DataFrame:
    """The k pairs of documents with most common keywords (or paths over them), at least ``least``."""
    return toppairs.top_pairs(g.has_keyword, least, k, weighted=paths).withColumnRenamed("score", "shared_count")


def top_keywords(g: Graph, k: int = 10, distinct: bool = False) -> DataFrame:
    count = F.countDistinct("pub_id") if distinct else F.count("*")
    return g.has_keyword.groupBy("keyword_id").agg(count.alias("cnt")).orderBy(F.desc("cnt"), "keyword_id").limit(k)


def edges_of_top(g: Graph, top: DataFrame) -> DataFrame:
    return g.has_keyword.join(F.broadcast(top.select("keyword_id")), "keyword_id")


def documents_with_most(g: Graph, k: int = 10) -> DataFrame:
    return g.has_keyword.groupBy("pub_id").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "pub_id").limit(k)


def keywords_by_method(g: Graph) -> DataFrame:
    """(pub_id, method, names) with the names sorted."""
    joined = g.has_keyword.join(g.keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id")
    return joined.groupBy("pub_id", "method").agg(F.array_sort(F.collect_list("name")).alias("names"))


def ego_network(g: Graph, pub_id) -> DataFrame:
    """Edges of one document's keywords, to itself and to other documents; the document alone if it has none."""
    mine = g.has_keyword.filter(F.col("pub_id") == F.lit(pub_id)).select("keyword_id").distinct()
    near = g.has_keyword.join(mine, "keyword_id").select("pub_id", "keyword_id", "method", "weight")
    alone = g.documents.filter(F.col("id") == F.lit(pub_id)).select(F.col("id").alias("pub_id"), F.lit(None).cast(g.has_keyword.schema["keyword_id"].dataType).alias("keyword_id"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("weight"))
    return near.unionByName(alone.join(near.select("pub_id").distinct(), "pub_id", "left_anti"))


def combined_search(g: Graph, query: str, k: int = 5, index: SearchIndex | None = None) -> DataFrame:
    """The first k documents by title and the k keywords of most documents, documents first; nothing for a query below two characters."""
    if len(query.strip()) < 2:
        query = "\u0000"
    query = query.strip()
    titled = g.documents.filter(has("title", query)) if index is None else g.documents.join(index.titles.ids(g.documents.sparkSession, query), "id", "left_semi")
    docs = titled.select(F.lit("document").alias("kind"), F.col("id").cast("string").alias("id"), F.col("title").alias("label"), F.lit(0).cast("long").alias("n")).orderBy(F.asc_nulls_last("label"), "id").limit(k)
    kws = facet_page(keyword_facets(g, query, index=index), Page(1, k)).select(F.lit("keyword").alias("kind"), F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.col("pub_count").alias("n"))
    return docs.unionByName(kws)


def rows_and_subgraph(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges with their ends as structs: the graph form of a result."""
    e = expanded(Graph(g.documents, g.keywords, edges))
    ends = lambda p, df: F.struct(*[F.col(p + c).alias(c) for c in df.columns])
    return e.select(ends("d_", g.documents).alias("d"), F.struct("method", "weight").alias("r"), ends("k_", g.keywords).alias("k"))


def paths(g: Graph, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Edges as paths for display: an array of node, edge and node (kind, id, label); the first ``most`` by ids."""
    e = expanded(Graph(g.documents, g.keywords, edges))
    if most is not None:
        e = e.orderBy("pub_id", "keyword_id", "method", "weight").limit(most)
    part = lambda kind, i, label: F.struct(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(label).cast("string").alias("label"))
    return e.select(F.array(part("document", "pub_id", "d_title"), part("edge", "method", "weight"), part("keyword", "keyword_id", "k_name")).alias("path"))
