"""One batch: check inputs, load core snapshots, reconcile the vendor feed, apply changes, publish."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..operators import dims, quality
from ..operators.controls import manifest_after_retry, manifest_rows, rescan, unprocessed
from ..operators.keyed import earliest_by, insert_if_absent, lookup_join, upsert
from ..schemas import SNAPSHOT_FIELDS, SNAPSHOT_KEYS
from ..session import counted, scratch_run, written
from ..sources import files, snapshots, vendor
from ..sources.changes import read_changes
from . import analytics, report
from .changes import EMAIL_DOMAIN, apply_feed
from .publish import BUCKETS, Batch, Warehouse

# Names of the delivered files.
VENDOR_PATTERN = "deposits_vendor_*.csv"
CHANGE_FEED = "client_profile_changes.jsonl"
CORE_PATTERN = "client_*.json"
#: Files that arrived up to so many days before the latest known arrival are looked at again.
RESCAN_DAYS = 7
CORE_FILES = tuple(f"{name}.json" for name in SNAPSHOT_FIELDS)


def new_batch_id() -> str:
    return f"batch_{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:6]}"


def _seen_until(batch: Batch, source: str) -> dt.datetime | None:
    """The latest arrival that earlier batches have seen of a source."""
    seconds = batch.counters.get(f"arrived_until_{source}")
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).replace(tzinfo=None) if seconds else None


def _to_do(batch: Batch, folder: str, pattern: str, source: str) -> tuple[DataFrame, int]:
    """Files not processed yet, and how many; of equal contents only the first by name. Only files that arrived within the
    last ``RESCAN_DAYS`` days before the latest known arrival, or after it, are read for that."""
    until = _seen_until(batch, source)
    since = until - dt.timedelta(days=RESCAN_DAYS) if until else None
    found = unprocessed(files.discover(batch.spark, folder, pattern, since=since), batch.table("ingestion_file_manifest"))
    first = earliest_by(found, ["file_hash"], ["file_name", "file_path"])
    todo, seen = counted(first, f"to-do-{source}", until=F.max(F.unix_seconds("arrived_at")))
    if seen["until"]:
        batch.counters[f"arrived_until_{source}"] = max(seen["until"], batch.counters.get(f"arrived_until_{source}", 0))
    return todo, seen["rows"]


def _overlooked(batch: Batch, folder: str, pattern: str, until: dt.datetime | None, shown: int = 20) -> list[str]:
    """Names of files too old to be looked at, of which no delivery is known; the first of them. They are listed, not read."""
    if until is None:
        return []
    found = rescan(files.listed(batch.spark, folder, pattern), batch.table("ingestion_file_manifest"), F.lit(until), RESCAN_DAYS)
    old = found.where("action = 'overlooked'").select("file_name").orderBy("file_name").limit(shown)
    return [r.file_name for r in old.collect()]


def _land_snapshot(batch: Batch, name: str, file: Row, layout: str) -> tuple[int, DataFrame]:
    """Land and stage one snapshot; returns the number of rows landed and the rows new to staging."""
    key, fields = SNAPSHOT_KEYS[name], SNAPSHOT_FIELDS[name]
    extra = ("credit_card",) if name == "client_deposit" else ()
    rows = snapshots.read_snapshot(batch.spark, [file.file_path], fields, extra, layout)
    if extra:
        rows = snapshots.with_fallback(rows, "payment_method", "credit_card")
    lineage = {"file_hash": F.lit(file.file_hash), "batch_id": batch.id, "landed_at": batch.at}
    landed, seen = counted(rows.withColumns(lineage), f"raw-{name}")
    batch.append(f"raw_{name}", insert_if_absent(batch.table(f"raw_{name}"), landed, ["file_hash", key], ["row_num"]))
    staged = snapshots.typed(landed, name, batch.id, batch.at)
    new = written(insert_if_absent(batch.table(f"stg_{name}"), staged, [key], ["file_name", "row_num"]), f"new-{name}")
    batch.append(f"stg_{name}", new)
    return seen["rows"], new


def load_core(batch: Batch, folder: str, history_start: str = dims.HISTORY_START, layout: str = "lines", opening: bool = False) -> dict[str, int]:
    """Snapshots into raw, staging, dimension and facts. Returns rows landed per snapshot."""
    todo = {file.file_name.removesuffix(".json"): file for file in _to_do(batch, folder, CORE_PATTERN, "warehouse")[0].where(
        F.col("file_name").isin(*CORE_FILES)).collect()}  # four at most
    landed = {name: _land_snapshot(batch, name, todo[name], layout) for name in SNAPSHOT_FIELDS if name in todo}
    audit = {"batch_id": batch.id, "created_at": batch.at}
    if landed:
        counts = [(todo[n].file_hash, todo[n].file_name, rows, rows, 0) for n, (rows, _) in landed.items()]
        names = "file_hash string, file_name string, rows_landed long, rows_staged long, rows_quarantined long"
        manifest = manifest_rows(batch.spark.createDataFrame(counts, names), "warehouse", batch.id, batch.at)
        batch.append("ingestion_file_manifest", manifest)
    if "client_signup" in landed or "client_profile" in landed:
        dim, signup, profile = (batch.table(n) for n in ("dim_client", "stg_client_signup", "stg_client_profile"))
        arrived = dims.known_people(signup, profile).join(dim.where("is_inferred").select("client_id").distinct(), "client_id", "left_semi")
        arrived = written(arrived, "arrived")
        hit = batch.buckets_of(arrived)
        if hit:  # placeholders whose own data has come
            batch.replace_buckets("dim_client", dims.complete_inferred(batch.table("dim_client", hit), arrived), hit)
        first = dims.bootstrap_clients(signup, profile, batch.table("dim_client"), history_start)
        new = batch.append("dim_client", dims.number_clients(first.withColumns(audit), batch.top_key()))
        if opening:
            batch.append("fact_client_balance_history", dims.opening_balances(profile, new).withColumns(audit))
    dim = batch.table("dim_client")
    deposits, trades = (landed[n][1] if n in landed else None for n in ("client_deposit", "client_trades"))
    named = [new.select("client_id") for new in (deposits, trades) if new is not None]
    if named:
        placeholders = dims.inferred_clients(reduce(DataFrame.unionByName, named), dim, history_start)
        batch.append("dim_client", dims.number_clients(placeholders.withColumns(audit), batch.top_key()))
        dim = batch.table("dim_client")
    if deposits is not None:
        facts = dims.with_client_key(deposits, dim).withColumns({
            "source_system": F.lit("warehouse"), "reconciliation_status": F.lit("CANONICAL_WAREHOUSE"), **audit,
        })
        batch.append("fact_deposit", insert_if_absent(
            batch.table("fact_deposit"), facts, ["source_system", "deposit_id"], ["file_name", "row_num"]))
    if trades is not None:
        facts = dims.with_instrument_key(dims.with_client_key(trades, dim), batch.table("dim_instrument")).withColumns(audit)
        batch.append("fact_trade", insert_if_absent(batch.table("fact_trade"), facts, ["trade_id"], ["file_name", "row_num"]))
    return {name: landed[name][0] if name in landed else 0 for name in SNAPSHOT_FIELDS}


def load_vendor(batch: Batch, folder: str) -> dict[str, object]:
    """The vendor files not processed yet. A header that drifted fails the batch, a bad row does not."""
    before = _seen_until(batch, "vendor")
    since = before - dt.timedelta(days=RESCAN_DAYS) if before else None
    todo, count = _to_do(batch, folder, VENDOR_PATTERN, "vendor")
    seen = files.listed(batch.spark, folder, VENDOR_PATTERN).count()
    metrics: dict[str, object] = {
        "files_seen": seen, "files_processed": count, "files_skipped": seen - count,
        "files_overlooked": _overlooked(batch, folder, VENDOR_PATTERN, before),
        "rows_landed": 0, "rows_staged": 0, "rows_quarantined": 0, "duplicates_skipped": 0, "drift_warnings": [],
    }
    if not count:
        return metrics
    table = todo.select("file_hash", "file_name", "file_path")
    rows, warnings = vendor.read_vendor(batch.spark, files.folder_lines(batch.spark, folder, VENDOR_PATTERN, since), chosen=table)
    metrics["drift_warnings"] = [r.warning for r in warnings.orderBy("file_name").limit(100).collect()]
    landed = written(
        lookup_join(rows, table.select("file_path", "file_hash"), ["file_path"], "inner")
        .withColumns({"batch_id": batch.id, "landed_at": batch.at}), "raw-vendor",
    )
    batch.append("raw_vendor_deposit", insert_if_absent(
        batch.table("raw_vendor_deposit"), landed, ["file_hash", "row_num"], ["file_name"]))
    current = batch.table("dim_client").where("is_current")
    staged = batch.table("stg_vendor_deposit").select("deposit_id", F.col("canonical_row_hash").alias("row_hash"))
    is_staged, is_copy = (F.col("disposition") == d for d in (quality.STAGED, quality.DUPLICATE))
    judged, totals = counted(
        quality.judge_vendor_rows(landed, current, staged, hold=written), "judged-vendor", rows_staged=F.count_if(is_staged),
        rows_quarantined=F.count_if(F.col("verdict").isNotNull()), duplicates_skipped=F.count_if(is_copy))
    totals["rows_landed"] = totals.pop("rows")
    good = judged.where(F.col("disposition") == quality.STAGED)
    _accept(batch, good)
    batch.append("quarantine", _held(batch, judged))
    per_file = quality.row_accounting(judged, ["file_hash"]).drop("balanced")
    counts = table.join(per_file, "file_hash", "left").fillna(0)
    batch.append("ingestion_file_manifest", manifest_rows(counts, "vendor", batch.id, batch.at))
    metrics.update(totals)
    return metrics


def _accept(batch: Batch, good: DataFrame) -> None:
    """Judged vendor rows into staging and the fact."""
    batch.append("stg_vendor_deposit", good.withColumns({"canonical_row_hash": F.col("row_hash"), "staged_at": batch.at}))
    batch.append("fact_deposit", insert_if_absent(
        batch.table("fact_deposit"),
        good.withColumns({"source_system": F.lit("vendor"), "reconciliation_status": F.lit("CANONICAL_VENDOR"),
                          "created_at": batch.at}).drop("verdict"),
        ["source_system", "deposit_id"], ["file_name", "row_num"]))


def _held(batch: Batch, judged: DataFrame) -> DataFrame:
    """Quarantine records of the judged vendor rows that no rule let through."""
    return quality.quarantine_records(
        judged.where("verdict is not null"), "vendor", F.col("file_name"), F.col("deposit_id"),
        F.concat_ws(":", "file_hash", "row_num"), F.col("raw_payload"), batch.id, batch.at)


def retry_vendor(batch: Batch) -> dict[str, int]:
    """Judge the vendor rows again that waited for a client who has come since.

    A row that passes now goes where it would have gone, and its record is marked resolved. One that another rule holds
    back gets a record with that reason, and the old one is resolved, too. The manifest of the rows' files says what
    became of them. Quarantine and manifest are rewritten in the buckets of these records and files only.
    """
    current = batch.table("dim_client").where("is_current")
    rows, found = counted(quality.waiting_rows(batch.table("raw_vendor_deposit"), batch.table("quarantine"), current), "retried")
    if not found["rows"]:
        return {"rows_retried": 0, "rows_resolved": 0}
    staged = batch.table("stg_vendor_deposit").select("deposit_id", F.col("canonical_row_hash").alias("row_hash"))
    judged, totals = counted(
        quality.judge_vendor_rows(rows, current, staged, hold=written), "judged-again", passed=F.count_if(F.col("verdict").isNull()))
    _accept(batch, judged.where(F.col("disposition") == quality.STAGED).withColumn("batch_id", batch.id))
    hit = batch.buckets_of(judged, "quarantine_id")
    done = quality.resolved(batch.table("quarantine", hit), judged)
    batch.replace_buckets("quarantine", upsert(batch.table("quarantine", hit), done, ["quarantine_id"], ["is_resolved", "retry_eligible"]), hit)
    batch.append("quarantine", _held(batch, judged))
    files_hit = batch.buckets_of(judged, "file_hash")
    manifest = batch.table("ingestion_file_manifest", files_hit)
    now = manifest_after_retry(manifest, judged, batch.at)
    batch.replace_buckets("ingestion_file_manifest", upsert(
        manifest, now, ["file_hash"], ["row_count_staged", "row_count_quarantined", "processed_at"]), files_hit)
    return {"rows_retried": found["rows"], "rows_resolved": totals["passed"]}


def load_static(batch: Batch) -> None:
    """Calendar and instruments, once."""
    if not batch.parts.get("dim_date"):
        batch.append("dim_date", dims.calendar(batch.spark, dt.date(2024, 1, 1), dt.date(2024, 12, 31)))
    if not batch.parts.get("dim_instrument"):
        batch.append("dim_instrument", dims.default_instruments(batch.spark))


def run(
    spark: SparkSession, root: str, folder: str, batch_id: str | None = None,
    required: tuple[str, ...] = (*CORE_FILES, CHANGE_FEED), email_domain: str = EMAIL_DOMAIN, layout: str = "lines",
    buckets: int = BUCKETS, opening: bool = False,
) -> dict[str, object]:
    """Process what lies in ``folder`` and publish it under ``root``, or raise and publish nothing.

    Safe to repeat: files and events that were processed before are skipped. ``layout`` is that of the snapshots.
    ``buckets`` counts for a new warehouse. With ``opening`` the profile balance of every client who is new becomes its first
    entry in the balance history, with no LSN.
    """
    files.require(spark, folder, required)
    with scratch_run(spark, "ingest"):
        batch = Warehouse(spark, root, buckets).begin(batch_id or new_batch_id())
        load_static(batch)
        core = load_core(batch, folder, layout=layout, opening=opening)
        retried = retry_vendor(batch)
        vendor_metrics = load_vendor(batch, folder)
        feed = files.listed(spark, folder, CHANGE_FEED).select("file_path").collect()
        changes = apply_feed(batch, read_changes(spark, [r.file_path for r in feed]), email_domain)
        batch.publish()
    return {
        "batch_id": batch.batch_id, "core": core, "retried": retried, "vendor": vendor_metrics, "changes": changes,
        "rows_written": batch.rows_written,
    }


def run_summary(warehouse: Warehouse) -> DataFrame:
    """Row counts of the main tables."""
    return analytics.table_counts({name: warehouse.read(name) for name in report.SUMMARY_TABLES})


def run_report(warehouse: Warehouse, now: dt.datetime | None = None) -> DataFrame:
    """Row counts, invariants, breakdowns and signals of the warehouse as published."""
    parts = warehouse.latest()[1]
    return report.report(lambda name: warehouse.read(name, parts.get(name, [])), now)
