"""The report of a warehouse: counts, invariants and signals, as rows.

One row for each thing counted: ``section``, ``name``, ``detail`` and ``found``. Sections: ``tables`` (rows), ``history``,
``keys``, ``quarantine``, ``deposits``, ``feed``, ``files`` and ``contract``. Invariants and signals appear with 0 where
nothing was found, so that a reader sees that they were looked at; breakdowns have a row for each group there is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import checks, controls, quality
from ..operators.keyed import duplicate_keys
from . import analytics

SUMMARY_TABLES = (
    "dim_client", "fact_deposit", "fact_trade", "fact_client_balance_history",
    "quarantine", "ingestion_file_manifest", "cdc_processing_ledger",
)
KEYS = {"fact_deposit": ("source_system", "deposit_id"), "fact_trade": ("trade_id",), "cdc_processing_ledger": ("lsn",), "dim_client": ("client_sk",)}


def _total(rows: DataFrame, section: str, name: str, found=None) -> DataFrame:
    amount = F.count("*") if found is None else F.coalesce(found, F.lit(0).cast("long"))
    return rows.agg(amount.cast("long").alias("found")).select(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit("").alias("detail"), "found")


def _groups(rows: DataFrame, section: str, name, detail) -> DataFrame:
    named = rows.select(F.lit(section).alias("section"), name.alias("name"), detail.alias("detail"))
    return named.groupBy("section", "name", "detail").agg(F.count("*").alias("found"))


def _lines(read: Callable[[str], DataFrame], now: dt.datetime | None) -> Iterator[DataFrame]:
    dim, deposits, events = read("dim_client"), read("fact_deposit"), read("raw_cdc_events")
    quarantine, manifest = read("quarantine"), read("ingestion_file_manifest")
    yield analytics.table_counts({name: read(name) for name in SUMMARY_TABLES}).select(
        F.lit("tables").alias("section"), F.col("table_name").alias("name"), F.lit("").alias("detail"), F.col("rows").alias("found"))
    versions = checks.ordered_versions(dim)
    yield _total(checks.overlapping_versions(versions), "history", "overlapping versions")
    yield _total(checks.history_gaps(versions), "history", "gaps between versions")
    yield _total(checks.backward_versions(dim), "history", "backward versions")
    for table, keys in KEYS.items():
        yield _total(duplicate_keys(read(table), keys), "keys", table)
    summed = analytics.quarantine_summary(quarantine)
    yield summed.select(F.lit("quarantine").alias("section"), F.col("reason_code").alias("name"), F.col("severity").alias("detail"), F.col("records").alias("found"))
    yield _total(quarantine.where("is_resolved"), "quarantine", "resolved")
    parts = analytics.deposit_breakdown(deposits)
    yield parts.select(F.lit("deposits").alias("section"), F.col("source_system").alias("name"), F.col("reconciliation_status").alias("detail"), F.col("records").alias("found"))
    near = checks.cross_source_candidates(deposits.where("source_system = 'warehouse'"), deposits.where("source_system = 'vendor'"))
    yield _total(near, "deposits", "vendor deposits like a warehouse one")
    yield _total(controls.lineage(deposits, "fact_deposit", F.col("deposit_id")).where("source_file is null or batch_id is null"), "deposits", "without lineage")
    yield _total(checks.log_gaps(events), "feed", "missing positions", F.sum("missing"))
    yield _groups(checks.event_contract_violations(events), "feed", F.lit("contract"), F.col("violation"))
    yield _total(checks.conflicting_inserts(events, dim), "feed", "inserts that contradict the dimension")
    yield _total(controls.changed_redeliveries(manifest), "files", "names delivered with other content")
    landed = F.sum("row_count_landed").alias("landed")
    shares = manifest.groupBy("file_name").agg(landed, F.sum("row_count_quarantined").alias("held")).where(F.col("held") > 0.01 * F.col("landed"))
    yield _total(shares, "files", "below 99 % valid rows")
    if now is not None:
        yield _total(controls.freshness(manifest, "source", "arrived_at", now).where("stale"), "files", "stale sources")
    judged = deposits.withColumn("verdict", quality.first_failure(quality.contract_rules())).where("verdict is not null")
    yield _groups(judged, "contract", F.col("source_system"), F.col("verdict.reason"))


def report(read: Callable[[str], DataFrame], now: dt.datetime | None = None) -> DataFrame:
    """The report over the tables that ``read`` gives by name. With ``now`` sources without an arrival for 26 hours count."""
    return reduce(DataFrame.unionByName, _lines(read, now))
