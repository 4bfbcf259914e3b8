"""Reads that set bad input aside instead of failing or losing it.

A record that can't be read, or lacks its key, goes to a quarantine with its text, its
file and the reason; the others are read as usual.  Files that an index names and
nobody wrote are told too.

Defined results: a JSON line is bad if it isn't an object of the schema's kinds, a CSV row if it has
too few or too many fields or one of another kind; blank JSON lines are no records;
an empty folder has no records; a null in the key column makes a record bad, though it
could be read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.scratch import stored

RECORD = "_record"
UNREADABLE, KEYLESS = "unreadable", "no key"


@dataclass(frozen=True)
class Checked:
    """good has the schema's columns and ``file``; bad is (file, reason, record)."""

    good: DataFrame
    bad: DataFrame

    def counters(self) -> DataFrame:
        """(file, status, n): ok, or the reason."""
        both = self.good.select("file", F.lit("ok").alias("status")).unionByName(self.bad.select("file", F.col("reason").alias("status")))
        return both.groupBy("file", "status").agg(F.count("*").alias("n"))

    def quarantine(self, folder: str, batch: str) -> None:
        """Adds the bad records to a table, under the name of a batch that replaces its like."""
        rows = self.bad.withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def _split(raw: DataFrame, key: str) -> Checked:
    table = stored(raw.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1)).select(*raw.columns, "file"), "checked")
    reason = F.when(F.col(RECORD).isNotNull(), UNREADABLE).when(F.col(key).isNull(), KEYLESS)
    judged = table.withColumn("reason", reason)
    columns = [c for c in raw.columns if c != RECORD]
    record = F.coalesce(F.col(RECORD), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return Checked(judged.filter("reason is null").drop(RECORD, "reason"), judged.filter("reason is not null").select("file", "reason", record.alias("record")))


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> Checked:
    """Objects, one a line."""
    raw = spark.read.schema(f"{schema}, {RECORD} string").options(mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, ignoreMissingFiles=True).json(path)
    return _split(raw, key)


def csv_rows(spark: SparkSession, path: str, schema: str, key: str, header: bool = True) -> Checked:
    """Rows, with a header or without; quotes are doubled."""
    options = {"header": header, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD, "columnPruning": False, "ignoreMissingFiles": True}
    return _split(spark.read.schema(f"{schema}, {RECORD} string").options(**options).csv(path), key)


def missing(index: DataFrame, folder: str, name: str = "filename") -> DataFrame:
    """The entries of an index whose file isn't in the folder."""
    files = index.sparkSession.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias(name))
    return index.join(files, name, "left_anti")
