"""An index of three-letter grams for CONTAINS searches.

``build`` numbers the rows, cuts the places into blocks, and writes for every gram and
block the offsets in the block of the rows that have it.  The lists are laid out in
buckets by the first two letters of the gram, sorted by gram; the lower-cased texts lie
apart, a folder a block.  A search reads the buckets of its grams, intersects the
lists block by block, and compares the texts that are left, of their blocks alone.

Texts end with two signs of ``PAD`` here, so that every letter starts a gram and
searches for one or two letters are searches for the grams that begin with them.

Defined results: letters are code points, compared in lower case; null and empty texts
are never found; an id may have several texts and is found once; a search for ``''`` finds
every text that has a letter; an empty table gives an index in which nothing is found.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.ranges import placed
from termweave.sources.scratch import dropped

GRAM, PAD = 3, "\0"
BLOCK = 1 << 16  # rows of a block
BUCKETS = 64
FEW_BLOCKS = 512  # that are named in the plan of a search; more are joined


def _bucket_column(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.substring(gram, 1, 2), "UTF-8")), F.lit(buckets)).cast("int")


def _bucket(gram: str, buckets: int) -> int:
    return zlib.crc32(gram[:2].encode()) % buckets


def grams(text: Column) -> Column:
    """The distinct grams of a lower-cased text, one from every letter."""
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit(PAD * (GRAM - 1))), F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


@dataclass(frozen=True)
class GramIndex:
    folder: str
    buckets: int = BUCKETS
    block: int = BLOCK

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        with_id = {"lists": "gram string, block long, offsets array<int>, bucket int", "texts": f"offset int, id {self.id_type(spark)}, text string, block long"}
        return spark.read.schema(with_id[name]).parquet(f"{self.folder}/{name}")

    def id_type(self, spark: SparkSession) -> str:
        return json.loads(spark.read.text(f"{self.folder}/about").first()[0])["id"]

    def lists(self, spark: SparkSession, query: str) -> DataFrame:
        """The lists a search for a lower-cased query reads."""
        read = self._read(spark, "lists")
        if len(query) >= GRAM:
            asked = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
            return read.filter(F.col("bucket").isin(sorted({_bucket(g, self.buckets) for g in asked}))).filter(F.col("gram").isin(asked))
        some = read.filter(F.col("bucket") == _bucket(query, self.buckets)) if len(query) == 2 else read
        return some.filter(F.col("gram").startswith(query))

    def candidates(self, spark: SparkSession, query: str) -> DataFrame:
        """(block, offset) of the rows that have every gram of the query."""
        lists = self.lists(spark, query)
        if len(query) < GRAM:
            return lists.select("block", F.explode("offsets").alias("offset")).distinct()
        n = len({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
        met = lists.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.size("offsets").alias("n"), "offsets"))).alias("l")).filter(F.size("l") == n)
        common = F.aggregate(F.slice("l", 2, n), F.col("l")[0]["offsets"], lambda a, x: F.array_intersect(a, x["offsets"]))
        return met.select("block", F.explode(common).alias("offset"))

    def ids(self, spark: SparkSession, query: str) -> DataFrame:
        """``id`` of the texts that hold the query, each once."""
        query = query.lower()
        texts = self._read(spark, "texts")
        if query:
            found = self.candidates(spark, query)
            blocks = [r["block"] for r in found.select("block").distinct().limit(FEW_BLOCKS + 1).collect()]
            if len(blocks) <= FEW_BLOCKS:
                texts = texts.filter(F.col("block").isin(blocks))
            texts = texts.join(found, ["block", "offset"], "left_semi").filter(F.col("text").contains(query))
        return texts.select("id").distinct()


def build(texts: DataFrame, folder: str, buckets: int = BUCKETS, block: int = BLOCK) -> GramIndex:
    """Writes the index of (id, text) to a folder."""
    spark = texts.sparkSession
    numbered = placed(texts.select("id", F.lower("text").alias("text")).filter("text <> ''"), [F.col("id")])
    rows = numbered.select((F.col("place") % block).cast("int").alias("offset"), "id", "text", F.floor(F.col("place") / block).alias("block"))
    rows.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/texts")
    postings = rows.select("block", "offset", F.explode(grams(F.col("text"))).alias("gram"))
    lists = postings.groupBy("gram", "block").agg(F.array_sort(F.collect_list("offset")).alias("offsets")).withColumn("bucket", _bucket_column(F.col("gram"), buckets))
    lists.repartitionByRange("bucket", "gram", "block").sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/lists")
    dropped(numbered)
    about = json.dumps({"id": texts.schema["id"].dataType.simpleString()})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    return GramIndex(folder, buckets, block)
