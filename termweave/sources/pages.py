"""Pages of a sorted table that read only what they show.

``write`` lays a table out in ranges of its order, a folder a range, and keeps a directory:
a row a range, with its first key, its number of rows and the rows before it.  A page is
looked up in the directory and read from the one or two ranges it lies in, however deep
it is; the page after a key needs no page number.

Defined results: columns are ascending, nulls last; a column with ``-`` before it is a
number and descends, nulls last too; rows that are equal in all of them come in any order, so the
order should end with an id; pages beyond the end and those of an empty table are empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.ranges import in_ranges, range_sizes


def _fields(order: tuple[str, ...]) -> list[Column]:
    """Columns whose ascending order is the wanted one."""
    out = []
    for name in order:
        c = F.col(name.removeprefix("-"))
        out += [c.isNull(), -c if name.startswith("-") else c]
    return out


def _key(order: tuple[str, ...]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_fields(order))])


@dataclass(frozen=True)
class PagedTable:
    folder: str
    order: tuple[str, ...]
    columns: str  # as DDL

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> PagedTable:
        """A table that was written before."""
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(folder, tuple(about["order"]), about["columns"])

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.columns).parquet(f"{self.folder}/rows")

    def directory(self, spark: SparkSession) -> DataFrame:
        """range_no, range_rows, range_first, first_key and last_key."""
        return spark.read.parquet(f"{self.folder}/directory")

    def total(self, spark: SparkSession) -> int:
        return self.directory(spark).agg(F.coalesce(F.sum("range_rows"), F.lit(0))).first()[0]

    def rows(self, spark: SparkSession, skip: int, size: int) -> DataFrame:
        """The rows at places skip to skip + size, with ``place`` (from 0), sorted; ranges outside aren't read."""
        within = (F.col("range_first") < skip + size) & (F.col("range_first") + F.col("range_rows") > skip)
        ranges = {r["range_no"]: r["range_first"] for r in self.directory(spark).filter(within).select("range_no", "range_first").collect()}  # size at most
        table = self._read(spark)
        first = F.element_at(F.create_map(*[F.lit(x) for pair in ranges.items() for x in pair]), F.col("range_no")) if ranges else F.lit(0)
        found = table.filter(F.col("range_no").isin(list(ranges))).withColumn("place", first + F.col("range_place"))
        return found.filter((F.col("place") >= skip) & (F.col("place") < skip + size)).drop("range_no", "range_place").orderBy("place")

    def listing(self, spark: SparkSession) -> DataFrame:
        """All rows with ``place``; the directory has a row a range and is broadcast."""
        first = F.broadcast(self.directory(spark).select("range_no", "range_first"))
        return self._read(spark).join(first, "range_no").withColumn("place", F.col("range_first") + F.col("range_place")).drop("range_no", "range_place", "range_first")

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1."""
        return self.rows(spark, (number - 1) * size, size)

    def after(self, spark: SparkSession, key: tuple, size: int) -> DataFrame:
        """The ``size`` rows behind a key, which are values of the order's columns."""
        kinds = {f.name: f.dataType for f in self._read(spark).schema.fields}
        names = [name.removeprefix("-") for name in self.order]
        given = spark.createDataFrame([tuple(key)], ", ".join(f"`{n}` {kinds[n].simpleString()}" for n in names)).select(_key(self.order).alias("key")).first()["key"]
        wanted = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(given, self.directory(spark).schema["first_key"].dataType.fields, strict=True)])
        last = self.directory(spark).filter(F.col("first_key") <= wanted).agg(F.max(F.struct("range_no", "range_first")).alias("r")).first()["r"]
        if last is None:
            return self.rows(spark, 0, size)
        passed = self._read(spark).filter(F.col("range_no") == last["range_no"]).filter(_key(self.order) <= wanted).count()
        return self.rows(spark, last["range_first"] + passed, size)


def write(table: DataFrame, folder: str, order: tuple[str, ...], parts: int | None = None) -> PagedTable:
    """Lays the table out in ranges of its order; ``parts`` of them, or as many as Spark shuffles into."""
    spark, laid = table.sparkSession, in_ranges(table, _fields(order), parts)
    laid.write.mode("overwrite").partitionBy("range_no").parquet(f"{folder}/rows")
    about = {"order": list(order), "columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    out = PagedTable.at(spark, folder)
    keys = out._read(spark).groupBy("range_no").agg(F.min(_key(order)).alias("first_key"), F.max(_key(order)).alias("last_key"))
    range_sizes(out._read(spark)).join(keys, "range_no").write.mode("overwrite").parquet(f"{folder}/directory")
    return out
