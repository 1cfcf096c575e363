"""What the operators share: reading tables, the shared folder, Arrow batch limits, word splitting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts are long; the defaults would put thousands of them in one batch.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The driver collects its garbage once its heap has grown to this share of its limit, and to so many times what the last time left.
HEAP_SHARE, HEAP_GROWTH = 0.5, 1.2
_heap_left = [0.0]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The whole table; only the named columns reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bounded_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once small, whatever the length of a text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a private one only in local sessions that name none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-llm-")
        context.setCheckpointDir(named)
    return named


def collect_finished(spark: SparkSession) -> bool:
    """Let the driver give back the memory of steps that have ended, if its heap has grown; whether it had to.

    Plans, metrics and block lists of ended steps stay until the driver happens to collect its garbage. A job of many small steps
    can so grow the heap to its limit for what nobody needs any more. A heap that does not shrink is left alone.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() < max(HEAP_SHARE * runtime.maxMemory(), HEAP_GROWTH * _heap_left[0]):
        return False
    gc.collect()  # frames that Python has not yet dropped hold their plans in the JVM
    spark._jvm.java.lang.System.gc()
    _heap_left[0] = float(runtime.totalMemory())
    return True


class Scratch:
    """A folder of one job's intermediate tables in the shared folder.

    A table that is read more than once, or that would be costly to make again after a lost executor, is written
    here; readers then only depend on its files. ``drop`` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = os.path.join(shared_folder(spark), "tidemark", f"{label}-{uuid.uuid4().hex}")

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and go on from the written table. Spark removes the shuffle files of the write at its end: nothing
        will read them again, and the disks of all executors would else hold every shuffle of a job in many steps."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        collect_finished(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names or ("",):
            path = path_of(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of all documents that no classifier learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))

