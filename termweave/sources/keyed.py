"""Tables by key that take batches of changes.

Rows lie in a folder a bucket, by the hash of their key.  A batch is reduced to its last row a
key, and only the buckets it touches are read, merged and written again (Spark's
dynamic partition overwrite); the files of the others stay as they are.  Of a key's rows
that of the largest sequence number stays, of equal numbers the larger row, so the order
of batches doesn't matter and a batch applied twice changes nothing.  Applied batches are noted too,
so a retry of one is skipped at once.  One writer at a time is expected.

Defined results: rows with a null in their key are left out; a null sequence number is below
all others; a deleted row stays as a mark that hides older ones; an empty batch is noted and
changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.graph import Graph, with_endpoints

SEQ, GONE = "seq", "deleted"


@dataclass(frozen=True)
class KeyedTable:
    """Columns are the key's, then others; ``buckets`` should be so many that one bucket is a task's work."""

    folder: str
    columns: str
    key: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.columns}, {SEQ} long, {GONE} boolean, bucket int").parquet(f"{self.folder}/rows")

    def create(self, spark: SparkSession) -> KeyedTable:
        """Makes an empty table, in place of one that is there."""
        empty = spark.createDataFrame([], f"{self.columns}, {SEQ} long, {GONE} boolean, bucket int")
        empty.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows")
        spark.createDataFrame([], "batch_id string, touched int").write.mode("overwrite").parquet(f"{self.folder}/applied")
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).filter(f"not {GONE}").drop(SEQ, GONE, "bucket")

    def applied(self, spark: SparkSession) -> DataFrame:
        """batch_id and touched (how many buckets) of the batches so far."""
        return spark.read.schema("batch_id string, touched int").parquet(f"{self.folder}/applied")

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.key, "bucket", SEQ, GONE)]
        best = rows.groupBy("bucket", *self.key).agg(F.max(F.struct(SEQ, GONE, *others)).alias("best"))
        return best.select(*self.key, *[F.col(f"best.{c}").alias(c) for c in (*others, SEQ, GONE)], "bucket")

    def apply(self, batch: DataFrame, batch_id: str, skip: bool = True) -> int:
        """Merges rows with ``seq`` (and ``deleted``, if some go) into the table; how many buckets were written.

        A batch that was applied before is skipped, or, without ``skip``, merged again: a stream's state
        is only kept if its rows are read.
        """
        spark = batch.sparkSession
        known = bool(self.applied(spark).filter(F.col("batch_id") == batch_id).limit(1).count())
        if known and skip:
            return 0
        now = batch if GONE in batch.columns else batch.withColumn(GONE, F.lit(False))
        names = [f.split()[0] for f in self.columns.split(", ")]
        now = now.select(*names, F.col(SEQ).cast("long").alias(SEQ), F.coalesce(GONE, F.lit(False)).alias(GONE)).dropna(subset=list(self.key))
        new = self._latest(now.withColumn("bucket", self._bucket())).persist()
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most as many as there are buckets
        if touched:
            old = self._all(spark).filter(F.col("bucket").isin(touched))
            merged = self._latest(old.unionByName(new).repartition("bucket"))
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/rows")
        new.unpersist()
        if not known:
            spark.createDataFrame([(batch_id, len(touched))], "batch_id string, touched int").coalesce(1).write.mode("append").parquet(f"{self.folder}/applied")
        return len(touched)


@dataclass(frozen=True)
class GraphStore:
    """A graph that grows by batches: documents and keywords by id, a document's edges as one list."""

    documents: KeyedTable
    keywords: KeyedTable
    edges: KeyedTable

    @classmethod
    def at(cls, folder: str, kind: str = "string", buckets: int = 64) -> GraphStore:
        """The store of a folder; ids of documents and keywords are of one kind."""
        table = lambda name, columns, key: KeyedTable(f"{folder}/{name}", columns, (key,), buckets)
        return cls(
            table("documents", f"id {kind}, title string, annotation string", "id"), table("keywords", f"id {kind}, name string, methods array<string>", "id"),
            table("edges", f"pub_id {kind}, links array<struct<keyword_id:{kind},method:string,weight:double>>", "pub_id"),
        )

    def create(self, spark: SparkSession) -> GraphStore:
        for t in (self.documents, self.keywords, self.edges):
            t.create(spark)
        return self

    def load(self, g: Graph, seq: int | Column, batch_id: str) -> None:
        """Adds or replaces documents (with all their edges) and keywords; what the batch doesn't name stays.

        ``seq`` is the batch's number, or a column of the documents.
        """
        number = F.lit(seq) if isinstance(seq, int) else seq
        links = g.has_keyword.groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("keyword_id", "method", F.col("weight").cast("double").alias("weight")))).alias("links"))
        docs = g.documents.withColumn(SEQ, number)
        none = F.array().cast(links.schema["links"].dataType)
        self.documents.apply(docs, batch_id)
        self.keywords.apply(g.keywords.withColumn(SEQ, F.lit(seq) if isinstance(seq, int) else F.lit(0)), batch_id)
        self.edges.apply(docs.select(F.col("id").alias("pub_id"), SEQ).join(links, "pub_id", "left").withColumn("links", F.coalesce("links", none)), batch_id)

    def delete(self, documents: DataFrame, seq: int, batch_id: str) -> None:
        """Removes documents (id) and their edges."""
        for table, key in ((self.documents, "id"), (self.edges, "pub_id")):
            names = [f.split()[0] for f in table.columns.split(", ") if f.split()[0] != key]
            kinds = {f.name: f.dataType for f in table._all(documents.sparkSession).schema.fields}
            marks = documents.select(F.col("id").alias(key), *[F.lit(None).cast(kinds[n]).alias(n) for n in names], F.lit(seq).alias(SEQ), F.lit(True).alias(GONE))
            table.apply(marks, batch_id)

    def graph(self, spark: SparkSession) -> Graph:
        """What is stored; edges without one of their ends are left out."""
        documents, keywords = self.documents.rows(spark), self.keywords.rows(spark)
        edges = self.edges.rows(spark).select("pub_id", F.explode("links").alias("x")).select("pub_id", "x.*")
        return Graph(documents, keywords, with_endpoints(edges, documents, keywords))
