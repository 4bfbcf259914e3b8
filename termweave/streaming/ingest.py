"""Incremental ingestion of documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termweave.functions import text as T
from termweave.sources.keyed import KeyedTable


def gated(documents: DataFrame) -> DataFrame:
    """Documents with the share of readable characters, a status, and their length; works on streams."""
    return documents.withColumns({
        "readable": T.readable_share(F.col("text")), "status": F.when(T.is_readable(F.col("text")), "ok").otherwise("skipped"), "text_length": F.length("text"),
    })


def ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Gates files as they arrive and appends them to a Parquet table, each once; ends when none is left."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return gated(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and time window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, folder: str, files: int = 2) -> DataFrame:
    """Events from the files of a folder in the order they came, some a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def into_table(stream: DataFrame, table: KeyedTable, checkpoint: str, reduce: Callable[[DataFrame], DataFrame] = lambda batch: batch, watch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Runs a stream to its end; every micro-batch, reduced, is one batch of the table.

    Rows get the number of their micro-batch as ``seq`` and ``part``.  A micro-batch that is run again
    after a failure brings the same rows under the same keys, so it changes nothing.
    ``watch`` is called with the number of each micro-batch when the table has it.
    """

    def one(batch: DataFrame, number: int) -> None:
        table.apply(reduce(batch).withColumns({"part": F.lit(number).cast("long"), "seq": F.lit(number).cast("long")}), f"{checkpoint} {number}", skip=False)
        if watch:
            watch(number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup(spark: SparkSession, folder: str) -> KeyedTable:
    """Totals by hour and type, a row a micro-batch that had some: late events are just further rows, however late."""
    return KeyedTable(folder, "start timestamp, event_type string, part long, n long, total double", ("start", "event_type", "part"), 16)


def hourly(batch: DataFrame) -> DataFrame:
    return batch.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rolled_up(table: KeyedTable, spark: SparkSession) -> DataFrame:
    """start, event_type, n and total over all micro-batches so far."""
    return table.rows(spark).groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n and total of sessions, each once it can't grow any more; an event that came twice counts once.

    Events later than ``late`` behind the newest are left out.
    """
    once = stream.filter("user_id is not null or event_id is null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    grouped = once.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total").filter("user_id is not null")


def session_table(spark: SparkSession, folder: str) -> KeyedTable:
    return KeyedTable(folder, "user_id long, start timestamp, end timestamp, n long, total double, part long", ("user_id", "start"), 16)


def feed(events: DataFrame, folder: str, parts: int, jitter: int = 0, end: bool = False) -> None:
    """Writes events as files that come one after another, in order of time but for ``jitter`` seconds at most.

    ``end`` adds a last event of nobody, a day behind the others, which closes what is open.
    """
    spark, seconds = events.sparkSession, F.col("ts").cast("double")
    came = seconds + F.pmod(F.xxhash64("event_id"), F.lit(max(jitter, 1)))
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    for k in range(parts if low is not None else 0):
        width = (high + jitter - low) / parts + 1e-3
        of = F.floor((came - low) / width)
        events.filter((of == k) if k < parts - 1 else (of >= k)).coalesce(1).write.mode("append").parquet(folder)
    if end and low is not None:
        spark.createDataFrame([(None, high + 86_400.0, None, None, None)], "event_id long, t double, user_id long, event_type string, value double").select(
            "event_id", F.timestamp_seconds("t").alias("ts"), "user_id", "event_type", "value"
        ).coalesce(1).write.mode("append").parquet(folder)
