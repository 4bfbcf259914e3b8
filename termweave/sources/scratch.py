"""Intermediate tables that several jobs read.

They are Parquet below the folder named by ``spark.checkpoint.dir``, which every
executor and the driver can reach, so a lost executor costs only the tasks it was
running.  What a result still reads can't be deleted by the function that made
it; the folder's own clean-up takes it.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Where none is set, a folder of this machine serves a local master, whose
    executors are this process; any other master is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_termweave_folder", None)
        if not found:
            found = "file://" + tempfile.mkdtemp(prefix="termweave-")
            spark._termweave_folder = found
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


SWEEP = 15.0  # seconds at least between two sweeps
_swept = [0.0]


def sweep(spark: SparkSession) -> None:
    """Lets the driver collect its garbage now and then.

    Spark removes the shuffle files and broadcasts of finished jobs only when the
    driver has collected what refers to them, by itself every half hour; many
    short jobs in a row fill disks and the driver's memory until then.
    """
    if time.monotonic() - _swept[0] >= SWEEP:
        gc.collect()
        spark._jvm.System.gc()
        _swept[0] = time.monotonic()


LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
"""Options of stored() for rows of megabytes: Parquet looks at a row group's size after 100 rows at first, so that such
rows would stay in memory, and be read again, by the hundred."""

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, clean: bool = False, **options: str) -> DataFrame:
    """Writes df to the shared folder and returns a reader of it: lineage ends here.

    clean: its shuffle files go as soon as it is written, not when garbage is collected.
    options: those of the Parquet writer.
    """
    sweep(df.sparkSession)
    path, conf = new_path(df.sparkSession, what), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true" if clean else before)
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._termweave_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    path = getattr(df, "_termweave_path", None)
    if path:
        jvm = df.sparkSession._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
