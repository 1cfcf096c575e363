"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def build_session(app: str = "tidemark", master: str | None = None, **conf: object) -> SparkSession:
    """A UTC, ANSI, adaptive session. A cluster's own settings win where they exist."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session that names none (a unit test, a laptop) gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_run: ContextVar[str | None] = ContextVar("scratch folder of the run", default=None)


@contextmanager
def scratch_run(spark: SparkSession, label: str) -> Iterator[None]:
    """Put all scratch tables made inside into one folder, and remove it in the end, also after a failure.

    What is made inside must be written or counted inside, too.
    """
    root = os.path.join(shared_folder(spark), "tidemark", f"{label}-{uuid.uuid4().hex}")
    token = _run.set(root)
    try:
        yield
    finally:
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, within the run's own folder if there is one."""
    root = _run.get() or os.path.join(shared_folder(spark), "tidemark")
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage and freezes the rows: a lost executor re-reads files instead of redoing the work. Written with zstd:
    digests in hex, of which there are many, take half the room.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, **totals: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and the number of rows (``rows``) and other totals as the write itself sees them; nothing is read again."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[value.alias(name) for name, value in totals.items()])
    return written(observed, label), seen.get
