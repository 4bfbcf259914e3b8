"""The bipartite graph of documents and keywords, as tables.

documents (id, title, ...), keywords (id, name, methods) and has_keyword
(pub_id, keyword_id, method, weight); links between documents are a fourth.  has_keyword is a multiset: one pair may
be linked by several methods, or twice by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import setjoin
from termweave.operators.lexicon import phrase_ids


@dataclass
class Graph:
    documents: DataFrame
    keywords: DataFrame
    has_keyword: DataFrame
    similar: DataFrame | None = None  # (source, target, score), if there are such links

    def as_views(self, spark: SparkSession) -> None:
        """Names the tables for spark.sql: documents_v, keywords_v, has_keyword."""
        self.documents.createOrReplaceTempView("documents_v")
        self.keywords.createOrReplaceTempView("keywords_v")
        self.has_keyword.createOrReplaceTempView("has_keyword")
        if self.similar is not None:
            self.similar.createOrReplaceTempView("similar_to")


def keyword_mentions(articles: DataFrame, keep_digits: bool = True, letters: str = "а-яёa-z", lexicon: DataFrame | None = None) -> DataFrame:
    """(pub_id, method, idx, spelling, keyword_id) of all keyword lists; blank ones are left out but counted in idx.

    ``articles`` has filename and the arrays keywords, keywords_tfidf, keywords_keybert.
    """
    parts = None
    for order, (method, column) in enumerate((("author", "keywords"), ("tfidf", "keywords_tfidf"), ("keybert", "keywords_keybert"))):
        one = articles.select(F.col("filename").alias("pub_id"), F.lit(method).alias("method"), F.lit(order).alias("list"), F.posexplode(F.coalesce(F.col(column), F.array().cast("array<string>"))).alias("idx", "raw"))
        parts = one if parts is None else parts.unionByName(one)
    spelled = parts.withColumn("spelling", F.regexp_replace(T.strip(F.col("raw")), "\\.+$", ""))
    if lexicon is None:
        spelled = spelled.withColumn("keyword_id", T.phrase_id(F.col("spelling"), keep_digits, letters))
    else:
        spelled = phrase_ids(spelled.withColumn("phrase", F.col("spelling")), lexicon, keep_digits, letters).withColumnRenamed("phrase_id", "keyword_id").drop("phrase")
    return spelled.filter("spelling <> '' and keyword_id <> ''").drop("raw")


def edge_weight(method: Column, idx: Column) -> Column:
    return F.when(method == "author", F.lit(1.0)).otherwise((10 - F.least(idx, F.lit(9))).cast("double"))


def build(articles: DataFrame, summaries: DataFrame | None = None, keep_digits: bool = True, letters: str = "а-яёa-z", lexicon: DataFrame | None = None) -> Graph:
    mentions = keyword_mentions(articles, keep_digits, letters, lexicon)
    edges = mentions.select("pub_id", "keyword_id", "method", edge_weight(F.col("method"), F.col("idx")).alias("weight"))
    keywords = keyword_vertices(mentions.withColumn("seq", F.struct("pub_id", "list", "idx")))
    docs = articles.select(F.col("filename").alias("id"), "title", F.array_join("authors", "; ").alias("authors"), "annotation")
    if summaries is not None:
        docs = docs.join(summaries.select(F.col("filename").alias("id"), "summary_tfidf", "summary_keybert"), "id", "left").fillna("", ["summary_tfidf", "summary_keybert"])
    return Graph(docs, keywords, edges)


def keyword_vertices(mentions: DataFrame) -> DataFrame:
    """(id, name, methods) from (keyword_id, spelling, method, seq): the commonest spelling, the first seen of equal ones."""
    counted = mentions.groupBy("keyword_id", "spelling").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    most = counted.groupBy("keyword_id").agg(F.max("n").alias("n"))
    best = counted.join(most, ["keyword_id", "n"]).groupBy("keyword_id").agg(F.min_by("spelling", "first").alias("name"))
    methods = mentions.groupBy("keyword_id").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return best.join(methods, "keyword_id").select(F.col("keyword_id").alias("id"), T.upper_first(F.col("name")).alias("name"), "methods")


def labelled(keywords: DataFrame) -> DataFrame:
    """Keywords with a boolean column for each method."""
    return keywords.select("*", *[F.array_contains("methods", m).alias(c) for c, m in (("author_kw", "author"), ("tfidf_kw", "tfidf"), ("keybert_kw", "keybert"))])


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows by key, the new ones winning; of new rows of one key the last by ``order`` (a column of new) and then the greatest."""
    columns = [c for c in new.columns if c != order]
    rest = [c for c in columns if c != key]
    last = F.max(F.struct(*[F.col(f"`{c}`") for c in ([order] if order else [])], *[F.col(f"`{c}`") for c in rest]))
    one = new.groupBy(key).agg(last.alias("_last")).select(key, *[F.col(f"_last.`{c}`").alias(c) for c in rest]) if rest or order else new.dropDuplicates([key])
    return old.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def with_endpoints(edges: DataFrame, documents: DataFrame, keywords: DataFrame) -> DataFrame:
    """The edges whose ends both exist; their multiplicity stays."""
    return edges.join(documents.select(F.col("id").alias("pub_id")).distinct(), "pub_id", "left_semi").join(keywords.select(F.col("id").alias("keyword_id")).distinct(), "keyword_id", "left_semi")


def expanded(g: Graph) -> DataFrame:
    """One row an edge with its document's and keyword's columns (d_*, k_*)."""
    d = g.documents.select([F.col(c).alias("d_" + c) for c in g.documents.columns])
    k = g.keywords.select([F.col(c).alias("k_" + c) for c in g.keywords.columns])
    return g.has_keyword.join(d, F.col("pub_id") == F.col("d_id")).join(k, F.col("keyword_id") == F.col("k_id"))


HUB = 2048  # documents of a keyword that meet as many others in one key of the join


def shared_terms(edges: DataFrame, ordered: bool = True, hub: int = HUB) -> DataFrame:
    """(d1, d2, paths, shared) of the pairs of documents with a common keyword.

    paths counts pairs of parallel edges; shared counts distinct keywords.  Edges
    are summed by document and keyword before the join, so parallel edges don't
    multiply rows.  Only ids are joined; pairs are d1 < d2 unless not ordered.
    The documents of a keyword of more than ``hub`` are split into parts, and each
    part meets each in a key of its own: the same pairs, by more tasks.
    """
    one = edges.groupBy("keyword_id", "pub_id").agg(F.count("*").alias("n"))
    parts = one.groupBy("keyword_id").agg(F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    dealt = one.join(parts, "keyword_id").withColumn("part", F.pmod(F.xxhash64("pub_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("keyword_id", F.col("part").alias("p1"), every.alias("p2"), F.col("pub_id").alias("d1"), F.col("n").alias("n1"))
    right = dealt.select("keyword_id", every.alias("p1"), F.col("part").alias("p2"), F.col("pub_id").alias("d2"), F.col("n").alias("n2"))
    pairs = left.join(right, ["keyword_id", "p1", "p2"]).filter("d1 < d2" if ordered else "d1 <> d2")
    return pairs.groupBy("d1", "d2").agg(F.sum(F.col("n1") * F.col("n2")).alias("paths"), F.count("*").alias("shared"))


LONG = 48  # keywords of a document up to which all pairs of them are listed


def _met(left: DataFrame, right: DataFrame, keys: list[str], hub: int) -> DataFrame:
    """Rows of left and right with equal keys: their pub_id as d1 and d2, their n and m as n1, m1, n2, m2; hubs are split as above."""
    parts = right.groupBy(*keys).agg(F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    part = F.pmod(F.xxhash64("pub_id"), F.col("parts")).cast("int")

    def side(rows: DataFrame, i: int) -> DataFrame:
        own, other = f"p{i}", f"p{3 - i}"
        return rows.join(parts, keys).withColumn(own, part).select(*keys, own, every.alias(other), F.col("pub_id").alias(f"d{i}"), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}"))

    return side(left, 1).join(side(right, 2), [*keys, "p1", "p2"])


def pairs_sharing_two(one: DataFrame, hub: int = HUB, long: int = LONG) -> DataFrame:
    """(d1, d2, paths, shared) of the pairs d1 < d2 of documents with two common keywords at least, from (pub_id, keyword_id, n).

    Documents of few keywords meet in pairs of keywords, so those that share one keyword only make no rows.  A pair of
    documents that shares s meets s * (s - 1) / 2 times, and each common keyword counts in s - 1 of them.  Pairs with a
    document of more than ``long`` keywords meet in single keywords.
    """
    known = one.filter("pub_id is not null and keyword_id is not null")
    lists = known.groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct(F.col("keyword_id").alias("k"), "n"))).alias("x"))
    few = lists.filter(F.size("x") <= long).select("pub_id", F.posexplode("x").alias("i", "a"), "x")
    twos = few.select("pub_id", "a", F.explode(F.slice("x", F.col("i") + 2, F.lit(long))).alias("b")).select("pub_id", F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
    often = twos.groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1").select("k1", "k2")
    twos = twos.join(often, ["k1", "k2"])
    met = _met(twos, twos, ["k1", "k2"], hub).filter("d1 < d2").groupBy("d1", "d2").agg(F.sum(F.col("n1") * F.col("n2") + F.col("m1") * F.col("m2")).alias("sum"), F.count("*").alias("c"))
    shared = F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("long")
    short = met.withColumn("shared", shared).select("d1", "d2", (F.col("sum") / (F.col("shared") - 1)).cast("long").alias("paths"), "shared")
    marked = lists.select("pub_id", F.explode("x").alias("y"), (F.size("x") > long).cast("int").alias("m")).select("pub_id", F.col("y.k").alias("keyword_id"), F.col("y.n").alias("n"), "m")
    mixed = _met(marked.filter("m = 1"), marked, ["keyword_id"], hub).filter("d1 < d2 or (m2 = 0 and d1 <> d2)")
    ends = [F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2")]
    with_long = mixed.groupBy(*ends).agg(F.sum(F.col("n1") * F.col("n2")).alias("paths"), F.count("*").alias("shared")).filter("shared > 1")
    return short.unionByName(with_long)


def pairs_of_paths(one: DataFrame, least: int, hub: int = HUB) -> DataFrame:
    """The pairs of at least ``least`` paths, above 1: those that share two keywords, and those that share one by parallel edges."""
    several = pairs_sharing_two(one, hub)
    rows = one.filter("pub_id is not null and keyword_id is not null").withColumn("m", (F.col("n") > 1).cast("int"))
    single = _met(rows.filter("m = 1"), rows, ["keyword_id"], hub).filter("d1 < d2 or (m2 = 0 and d1 <> d2)").filter(F.col("n1") * F.col("n2") >= least)
    single = single.select(F.least("d1", "d2").alias("d1"), F.greatest("d1", "d2").alias("d2"), (F.col("n1") * F.col("n2")).alias("paths"), F.lit(1).cast("long").alias("shared"))
    return several.filter(F.col("paths") >= least).unionByName(single.join(several.select("d1", "d2"), ["d1", "d2"], "left_anti"))


def similar_classes(edges: DataFrame, threshold: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Members (pub_id, class_id, class_size) of the classes of equal keyword sets, and the links (class1, class2, score)
    of classes whose Jaccard similarity is at least the threshold, above 0."""
    s = setjoin.classes(edges)
    links = setjoin.linked_classes(s.sets, setjoin.Alike(threshold))
    return s.members, links.select("class1", "class2", (F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))).alias("score"))


def similar_to(edges: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(source, target, score): Jaccard similarity of the documents' keyword sets, at least the threshold.

    Equal sets are compared once and written out as the pairs of documents they stand for.  A class
    of one document is named by it, so a link of two such classes is ready where it is found and isn't moved.
    """
    s = setjoin.classes(edges)
    links = lambda copies: setjoin.linked_classes(s.sets, setjoin.Alike(threshold), copies=copies).withColumn("score", F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")))
    members = s.members.filter("class_size > 1")
    side = lambda n: members.select(F.col("class_id").alias(f"class{n}"), F.col("pub_id").alias(f"d{n}"))
    own = lambda n: F.coalesce(f"d{n}", f"class{n}").alias(f"d{n}")
    several = links(True).join(side(1), "class1", "left").join(side(2), "class2", "left").select(own(1), own(2), "score")
    others = links(False).select(F.col("class1").alias("d1"), F.col("class2").alias("d2"), "score").unionByName(several)
    equal = side(1).join(side(2), F.col("class1") == F.col("class2")).filter("d1 < d2").select("d1", "d2", F.lit(1.0).alias("score"))
    both = others.unionByName(equal) if threshold <= 1 else others
    return both.select(F.least("d1", "d2").alias("source"), F.greatest("d1", "d2").alias("target"), "score")


def similar_to_one(edges: DataFrame, pub_id, threshold: float = 0.05) -> DataFrame:
    """The rows of similar_to that have the document at one of their ends, without the others.

    Edges are counted by document, all of them and those to the document's keywords, so the work
    grows with the edges, not with pairs.
    """
    known = edges.filter("pub_id is not null and keyword_id is not null").select("pub_id", "keyword_id").distinct()
    one = F.col("pub_id") == F.lit(pub_id)
    mine = known.filter(one).select("keyword_id", F.lit(1).alias("mine"))
    sizes = known.join(mine, "keyword_id", "left").groupBy("pub_id").agg(F.count("*").alias("n"), F.count("mine").alias("shared"))
    own = known.filter(one).agg(F.count("*").alias("own"))  # one row
    scored = sizes.filter(~one & (F.col("shared") > 0)).crossJoin(F.broadcast(own)).withColumn("score", F.col("shared") / (F.col("n") + F.col("own") - F.col("shared")))
    other = F.lit(pub_id).cast(edges.schema["pub_id"].dataType)
    return scored.filter(F.col("score") >= threshold).select(F.least("pub_id", other).alias("source"), F.greatest("pub_id", other).alias("target"), "score")


def link_counts(edges: DataFrame, threshold: float = 0.05) -> DataFrame:
    """A row a document: pub_id, class_id, class_size, and to how many other classes (links), of how many documents (linked), its class is similar.

    Links are counted where they are found, so copies of one text cost no pairs.
    """
    s = setjoin.classes(edges)
    counts = setjoin.link_counts(s.sets, setjoin.Alike(threshold))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.members.join(counts, "class_id", "left").select("pub_id", "class_id", "class_size", none("links"), none("linked"))


def both_ways(edges: DataFrame) -> DataFrame:
    """An undirected reading of (source, target, score)."""
    return edges.union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "score"))


def similar_of(edges: DataFrame, pub_id) -> DataFrame:
    """(pub_id, score) of the documents linked to one, whichever way the link points."""
    return both_ways(edges).filter(F.col("source") == F.lit(pub_id)).select(F.col("target").alias("pub_id"), "score")
