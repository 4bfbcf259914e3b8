"""A graph's tables laid out so that its joins move no edges.

Edges are kept twice, in buckets by keyword and in buckets by document, sorted in each; keywords
and documents lie in as many buckets by id.  The catalogue knows the layout, so a join of
edges with either side, and of edges with edges over a keyword, reads buckets that belong
together in one task, without an exchange or (one file a bucket) a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.graph import Graph, pairs_of_paths

ROWS = 500_000  # edges of a bucket, about


@dataclass(frozen=True)
class BucketedGraph:
    spark: SparkSession
    name: str

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def expanded_keywords(self) -> DataFrame:
        """Edges with their keyword's name."""
        return self.table("edges_by_keyword").join(self.table("keywords").select(F.col("id").alias("keyword_id"), "name"), "keyword_id")

    def expanded_documents(self) -> DataFrame:
        """Edges with their document's title."""
        return self.table("edges_by_document").join(self.table("documents").select(F.col("id").alias("pub_id"), "title"), "pub_id")

    def two_hops(self) -> DataFrame:
        """(d1, d2, paths, shared) of documents with a common keyword, d1 < d2; parallel edges are summed where they lie."""
        one = self.table("edges_by_keyword").groupBy("keyword_id", "pub_id").agg(F.count("*").alias("n"))
        left = one.select("keyword_id", F.col("pub_id").alias("d1"), F.col("n").alias("n1"))
        pairs = left.join(one.select("keyword_id", F.col("pub_id").alias("d2"), F.col("n").alias("n2")), "keyword_id").filter("d1 < d2")
        return pairs.groupBy("d1", "d2").agg(F.sum(F.col("n1") * F.col("n2")).alias("paths"), F.count("*").alias("shared"))

    def pairs_of_paths(self, least: int) -> DataFrame:
        """Those of at least ``least`` paths, above 1; a document's keywords are gathered where they lie."""
        return pairs_of_paths(self.table("edges_by_document").groupBy("pub_id", "keyword_id").agg(F.count("*").alias("n")), least)

    def neighbours(self, documents: DataFrame) -> DataFrame:
        """(pub_id, other, shared): the documents that share keywords with each of a few (pub_id); only their edges are looked up by document."""
        mine = self.table("edges_by_document").join(documents.select("pub_id").distinct(), "pub_id", "left_semi").select("pub_id", "keyword_id").distinct()
        others = self.table("edges_by_keyword").select("keyword_id", F.col("pub_id").alias("other")).distinct()
        return mine.join(others, "keyword_id").filter("pub_id <> other").groupBy("pub_id", "other").agg(F.count("*").alias("shared"))

    def drop(self) -> None:
        for part in ("documents", "keywords", "edges_by_keyword", "edges_by_document"):
            self.spark.sql(f"drop table if exists {self.name}_{part}")


def write(g: Graph, name: str, folder: str, buckets: int | None = None) -> BucketedGraph:
    """Writes the tables to a folder and names them ``name_...``; ``buckets`` should be so many that one is a task's work, by default of about ``ROWS`` edges."""
    buckets = buckets or max(8, -(-g.has_keyword.count() // ROWS))
    for part, table, key, then in (
        ("documents", g.documents, "id", ()), ("keywords", g.keywords, "id", ()),
        ("edges_by_keyword", g.has_keyword, "keyword_id", ("pub_id",)), ("edges_by_document", g.has_keyword, "pub_id", ("keyword_id",)),
    ):
        dealt = table.repartition(buckets, key)  # one file a bucket
        dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *then).option("path", f"{folder}/{part}").saveAsTable(f"{name}_{part}")
    return BucketedGraph(g.documents.sparkSession, name)
