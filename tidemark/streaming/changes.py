"""The change feed as a file stream.

Each micro-batch goes through the same plan as a batch file. State lives in the published tables, so there
is no state store to lose and no watermark: a late event leads to a rebuild of its client and is never dropped.
A micro-batch is published under its own id, so one that Spark delivers again is recognised and skipped. It
rewrites the buckets of its own clients, and its scratch tables go with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.numbering import number_file_rows
from ..plans.changes import EMAIL_DOMAIN, apply_feed
from ..plans.publish import Warehouse
from ..session import scratch_run
from ..sources.changes import parse_events


def feed_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New JSON-lines files of the folder, line by line."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
        .where("trim(value) <> ''")
        .select(
            "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_block_start").alias("split_start"),
        )
    )


def start(
    spark: SparkSession, folder: str, root: str, checkpoint: str, name: str = "feed",
    email_domain: str = EMAIL_DOMAIN, max_files: int = 1000,
) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    warehouse = Warehouse(spark, root)

    def process(lines: DataFrame, number: int) -> None:
        batch_id = f"{name}-{number:09d}"
        if warehouse.published(batch_id):
            return
        with scratch_run(spark, batch_id):
            batch = warehouse.begin(batch_id)
            # from 1 in every file, as in a batch, and so the same in every attempt
            arrived = number_file_rows(lines, "arrival_sequence").select("value", "file_name", "arrival_sequence")
            apply_feed(batch, parse_events(arrived), email_domain)
            batch.publish()

    return (
        feed_stream(spark, folder, max_files).writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()
    )
