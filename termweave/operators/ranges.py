"""Places of rows in an order over a whole table, without one task that sees them all.

Rows are dealt in ranges of the order, each range is sorted and numbered by itself,
and what comes before a range is the sum of the sizes of the ranges before it.  Only
those sizes, a row a shuffle partition, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.sources.scratch import stored


def in_ranges(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows sorted in ranges, with ``range_no`` and ``range_place``, from 0 within the range.

    Rows that are equal in the order may lie in two ranges, so a value that many share doesn't fill one.
    Such rows should come from files or a table as it is written: what parts them is their place there,
    which is the same when a task is run again.
    """
    keys = [c.alias(f"_key{i}") for i, c in enumerate([*order, F.monotonically_increasing_id()])]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.select("*", *keys)
    dealt = keyed.repartitionByRange(*([parts] if parts else []), *names).sortWithinPartitions(*names).drop(*names)
    return dealt.withColumn("range_no", F.spark_partition_id()).withColumn("range_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))


def range_sizes(table: DataFrame) -> DataFrame:
    """range_no, range_rows and range_first (the rows before it) of a written table of ``in_ranges``; a row a range."""
    sizes = table.groupBy("range_no").agg(F.count("*").alias("range_rows"))
    return sizes.withColumn("range_first", F.sum("range_rows").over(Window.orderBy("range_no")) - F.col("range_rows"))


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place in the order, from 0; of equal ones any comes first.

    The sizes that are broadcast have a row a shuffle partition.  The table behind the result can be
    given to ``scratch.dropped`` by it.
    """
    table = stored(in_ranges(rows, order), "ranges")
    first = F.broadcast(range_sizes(table).select("range_no", "range_first"))
    out = table.join(first, "range_no").withColumn(name, F.col("range_first") + F.col("range_place")).drop("range_no", "range_place", "range_first")
    out._termweave_path = table._termweave_path
    return out
