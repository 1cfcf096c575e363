"""Control state: which files and events have been processed, and what a batch did."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clock import stamp
from .keyed import absent_from


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content no successful batch has processed. Names do not matter, content does."""
    done = manifest.where("status = 'SUCCESS'").select("file_hash").distinct()
    return files.join(done, "file_hash", "left_anti")


def rescan(files: DataFrame, manifest: DataFrame, until: Column, days: int = 7) -> DataFrame:
    """What to do with listed files, given that files up to ``until`` have been seen: those that arrived within ``days`` before it
    or later are to be hashed (action ``hash``), as clocks and copies run late; an older one is not read again, but
    reported where no delivery of its name is known (``overlooked``)."""
    horizon = until - F.make_interval(days=F.lit(days))
    recent = F.col("arrived_at") > horizon
    known = manifest.select("file_name", F.lit(True).alias("_known")).distinct()
    marked = files.join(known, "file_name", "left")
    action = F.when(F.coalesce(recent, F.lit(True)), "hash").when(F.col("_known").isNull(), "overlooked")
    return marked.withColumn("action", action).where("action is not null").drop("_known")


def missing_inputs(expected: DataFrame, found: DataFrame, name: str = "file_name") -> DataFrame:
    """Expected names that were not delivered."""
    return expected.join(found.select(name), name, "left_anti")


def manifest_rows(counts: DataFrame, source: str, batch_id: Column, at: Column) -> DataFrame:
    """Manifest rows from per-file counts (file_hash, file_name, rows_landed, rows_staged, rows_quarantined)."""
    return counts.select(
        "file_hash", "file_name", F.lit(source).alias("source"), F.lit("SUCCESS").alias("status"),
        F.col("rows_landed").cast("long").alias("row_count_landed"),
        F.col("rows_staged").cast("long").alias("row_count_staged"),
        F.col("rows_quarantined").cast("long").alias("row_count_quarantined"),
        at.alias("arrived_at"), at.alias("processed_at"), batch_id.alias("batch_id"),
    )


def manifest_after_retry(manifest: DataFrame, settled: DataFrame, at: Column) -> DataFrame:
    """The manifest rows of the files whose rows a retry has settled, with their counts as they are now: ``settled`` has
    file_hash, and verdict and disposition of the second judgement."""
    held = F.col("verdict").isNotNull()
    moved = settled.groupBy("file_hash").agg(F.count_if(~held).alias("_left"), F.count_if(F.col("disposition") == "STAGED").alias("_staged"))
    now = manifest.join(moved, "file_hash").withColumns({
        "row_count_staged": F.col("row_count_staged") + F.col("_staged"),
        "row_count_quarantined": F.col("row_count_quarantined") - F.col("_left"), "processed_at": at,
    })
    return now.select(*manifest.columns)


def unapplied(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events to apply: one row per LSN, none of them in the ledger. Copies within a delivery are equal
    (conflicts are refused before), so any one of them will do."""
    return absent_from(events.dropDuplicates(["lsn"]), ledger, ["lsn"], events)


def _settled(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("outcome") == "APPLIED").alias("applied"),
        F.count_if(F.col("outcome") == "RECONCILED").alias("reconciled"),
        F.count_if(F.col("outcome") == "QUARANTINED").alias("quarantined"),
        F.count("*").alias("settled"),
    )


def feed_counters(seen: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: events seen, applied, reconciled, quarantined and skipped."""
    total = seen.agg(F.count("*").alias("events_seen"))
    return total.crossJoin(_settled(outcomes)).select(
        "events_seen", "applied", "reconciled", "quarantined", (F.col("events_seen") - F.col("settled")).alias("skipped")
    )


def feed_report(events_seen: int, outcomes: DataFrame) -> dict[str, int]:
    """The same where the events were counted when they were written. ``outcomes``: those of the events applied now."""
    done = _settled(outcomes).first().asDict()
    return {"events_seen": events_seen, **{k: n for k, n in done.items() if k != "settled"}, "skipped": events_seen - done["settled"]}


def changed_redeliveries(files: DataFrame) -> DataFrame:
    """File names that were delivered with more than one content."""
    versions = files.groupBy("file_name").agg(
        F.min("file_hash").alias("low"), F.max("file_hash").alias("high"), F.count("*").alias("deliveries")
    )
    return versions.where("low <> high").select("file_name", "deliveries")


def late_deliveries(rows: DataFrame, business_date: str, delivered_on: str) -> DataFrame:
    """Business dates touched by each delivery that were over before it arrived."""
    return (
        rows.where(F.col(business_date) < F.col(delivered_on))
        .groupBy(delivered_on, business_date)
        .agg(F.count("*").alias("late_rows"))
    )


def missing_days(days: DataFrame, delivered: DataFrame, day: str = "date_key") -> DataFrame:
    """Expected delivery days without a delivery."""
    return days.select(day).join(delivered.select(day).distinct(), day, "left_anti")


def lineage(facts: DataFrame, table: str, key: Column) -> DataFrame:
    """Where each row came from: source file, batch, target table and key."""
    return facts.select(F.col("file_name").alias("source_file"), "batch_id", F.lit(table).alias("target_table"), key.alias("target_key"))


def freshness(arrivals: DataFrame, source: str, arrived_at: str, now: dt.datetime, limit_hours: int = 26) -> DataFrame:
    """Last arrival per source, its age, and whether it exceeds the limit. Arrival counts, not the business date."""
    at = stamp(now)
    last = arrivals.groupBy(source).agg(F.max(arrived_at).alias("last_arrival"))

    def seconds(moment: Column) -> Column:
        return F.unix_seconds(moment.cast("timestamp"))

    return last.withColumns({
        "stale": F.col("last_arrival") < at - F.expr(f"interval {limit_hours} hours"),
        "age_seconds": seconds(at) - seconds(F.col("last_arrival")),
    })
