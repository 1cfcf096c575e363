"""Change feed: JSON lines in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import clock, images
from ..functions.hashing import document_digest
from ..operators.checks import conflicting_lsns
from ..operators.numbering import number_file_rows
from .files import lines


class ConflictingEvents(ValueError):
    """One log position with two different payloads."""


def parse_events(text: DataFrame) -> DataFrame:
    """Events from a column ``value`` of JSON text; the other columns are kept.

    A text must be exactly one object with an lsn, a client_id and a readable commit_ts, or the read fails, naming
    file and place where these are known.
    """
    kept = [c for c in text.columns if c != "value"]
    place = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in kept if c in ("file_name", "arrival_sequence")])

    def stated(value: Column, what: str, kind: str) -> Column:
        return F.coalesce(value, F.raise_error(F.concat(F.lit(f"Change event without {what}: "), place)).cast(kind))

    # a zero behind the object shows whether the text ends with it; as a column, so that a text is parsed once
    text = text.withColumn("items", F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(",0]"))).try_cast("array<variant>"))
    items = F.col("items")
    alone = F.when((F.size(items) == 2) & F.schema_of_variant(items[0]).startswith("OBJECT"), items[0])
    doc = F.coalesce(alone, F.raise_error(F.concat(F.lit("Not one JSON object: "), place)).cast("variant"))
    return text.withColumn("doc", doc).select(
        stated(F.try_variant_get("doc", "$.lsn", "bigint"), "a readable lsn", "bigint").alias("lsn"),
        stated(clock.utc(F.try_variant_get("doc", "$.commit_ts", "string")), "a readable commit_ts", "timestamp_ntz").alias("commit_ts"),
        F.try_variant_get("doc", "$.op", "string").alias("op"),
        stated(F.try_variant_get("doc", "$.client_id", "string"), "a client_id", "string").alias("client_id"),
        images.image(F.col("doc"), "$.before").alias("before"),
        images.image(F.col("doc"), "$.after").alias("after"),
        F.col("value").alias("raw_json"),
        document_digest(F.col("doc")).alias("payload_hash"),
        *kept,
    )


def read_changes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Events of the feed with file_name and arrival_sequence. No file, no events."""
    if not paths:
        empty = spark.createDataFrame([], "value string, file_name string, arrival_sequence long")
        return parse_events(empty)
    numbered = number_file_rows(lines(spark, paths).where("trim(value) <> ''"), "arrival_sequence")
    return parse_events(numbered.select("value", "file_name", "arrival_sequence"))


def refuse_conflicts(events: DataFrame, history: DataFrame, shown: int = 20) -> None:
    """Fail if a log position carries two payloads, within ``events`` or between them and ``history``."""
    pairs = events.select("lsn", "payload_hash").unionByName(
        history.join(events.select("lsn").distinct(), "lsn", "left_semi").select("lsn", "payload_hash")
    )
    conflicts = conflicting_lsns(pairs)
    total = conflicts.count()
    if total:
        first = [r.lsn for r in conflicts.orderBy("lsn").limit(shown).collect()]
        raise ConflictingEvents(f"{total} log positions carry different payloads, the first of them {first}")
