"""Applying change events to the tables of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import stable_id
from ..operators import checks, history, replay
from ..operators.controls import feed_report, unapplied
from ..operators.keyed import absent_from, insert_if_absent, lookup_join
from ..operators.numbering import dense_number
from ..operators.quality import ERROR, UNSUPPORTED_OPERATION
from ..session import counted, written
from ..sources.changes import refuse_conflicts
from .publish import Batch

EMAIL_DOMAIN = "cdc.invalid"


class BrokenHistory(AssertionError):
    """The history about to be published breaks an invariant."""


def check_history(dim: DataFrame) -> None:
    found = checks.overlapping_versions(dim).select("client_id").unionByName(
        checks.backward_versions(dim).select("client_id")
    ).distinct()
    some = found.limit(20).collect()
    if some:
        raise BrokenHistory(f"Overlapping or backward intervals for {found.count()} clients, among them {sorted(r.client_id for r in some)}")


def write_history(
    batch: Batch, base: DataFrame, events: DataFrame, old: DataFrame, email_domain: str, buckets: list[int]
) -> history.Applied:
    """Apply ``events`` on ``base``, the dimension's named buckets, and put the result in their place.

    A version keeps the surrogate key it has in ``old`` if the same event opened it there, so a replay
    that changes nothing changes no key either. New versions are numbered in LSN order. Only the histories of the
    events' clients are checked; no other has changed.
    """
    applied = history.apply_events(base, events, hold=written)
    starts = history.describe_starts(applied.starts, base, events, email_domain)
    keys = old.where(F.col("opened_by_lsn").isNotNull()).select("opened_by_lsn", "client_sk")
    keyed = written(starts.join(keys, "opened_by_lsn", "left"), "starts")
    fresh = dense_number(keyed.where("client_sk is null").drop("client_sk"), ["opened_by_lsn"], "client_sk", batch.top_key())
    opened = keyed.where("client_sk is not null").unionByName(fresh).withColumns({"batch_id": batch.id, "created_at": batch.at})
    closed = history.close_current(base, applied.closures)
    dim = batch.replace_buckets("dim_client", closed.unionByName(opened.drop("is_birth")), buckets)
    check_history(lookup_join(dim, events.select("client_id").distinct(), ["client_id"], "left_semi"))
    return applied


def ledger_rows(batch: Batch, outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumns({"batch_id": batch.id, "applied_at": batch.at})


def unsupported_records(batch: Batch, outcomes: DataFrame, raw: DataFrame) -> DataFrame:
    """Quarantine rows for events with an unknown operation."""
    bad = outcomes.where(F.col("outcome") == history.QUARANTINED).select("lsn")
    return raw.dropDuplicates(["lsn"]).join(bad, "lsn", "left_semi").select(
        stable_id(F.lit("cdc"), F.col("lsn"), F.lit(UNSUPPORTED_OPERATION)).alias("quarantine_id"),
        F.lit("cdc").alias("source_system"), F.col("file_name").alias("source_identifier"),
        F.col("lsn").cast("string").alias("record_id"), batch.id.alias("batch_id"), F.col("raw_json").alias("raw_payload"),
        F.lit(UNSUPPORTED_OPERATION).alias("reason_code"), F.lit(ERROR).alias("severity"), batch.at.alias("quarantined_at"),
        F.lit(False).alias("is_resolved"), F.lit(False).alias("retry_eligible"),
    )


def apply_feed(batch: Batch, events: DataFrame, email_domain: str = EMAIL_DOMAIN) -> dict[str, int]:
    """Land ``events`` and apply those not applied before; returns the counters.

    An event that comes in below the applied LSNs of its client is not put on top: the client is rebuilt
    from that point on, out of the raw events. Each client has its own point, so one very late event makes no other
    client's tail longer. Tables are read and rewritten in the buckets of the events' clients only; balances and ledger
    are rewritten in those of late clients, and else appended to.
    """
    seen, total = counted(events, "feed")
    refuse_conflicts(seen, batch.table("raw_cdc_events"))  # a conflicting event may name another client
    touched = batch.buckets_of(seen)
    ledger = batch.table("cdc_processing_ledger", touched)
    landed = seen.withColumns({"batch_id": batch.id, "landed_at": batch.at})
    fresh_raw = insert_if_absent(batch.table("raw_cdc_events", touched), _sortable(landed), ["lsn", "payload_hash"], ["arrival_sequence"])
    batch.append("raw_cdc_events", _images(fresh_raw))
    new = written(unapplied(seen, ledger), "new-events")
    hit = batch.buckets_of(new)
    if not hit:
        return feed_report(total["rows"], ledger.limit(0))

    dim = batch.table("dim_client", hit)
    late = written(replay.late_clients(new, ledger), "late")
    behind = batch.buckets_of(late)
    base, work = dim, new
    if behind:
        raw, applied_before = batch.table("raw_cdc_events", behind), batch.table("cdc_processing_ledger", behind)
        boundaries = written(replay.late_boundaries(raw, late), "boundaries")
        base = written(replay.base_at(dim, boundaries), "base")
        rebuilt = replay.events_to_rebuild(raw, boundaries)
        others = lookup_join(new, late.select("client_id"), ["client_id"], "left_anti")
        work = written(rebuilt.select(*_EVENT).unionByName(others.select(*_EVENT)), "rebuild")
        kept = replay.purge_balances(batch.table("fact_client_balance_history", behind), boundaries)
        batch.replace_buckets("fact_client_balance_history", kept, behind)
        batch.replace_buckets("cdc_processing_ledger", absent_from(applied_before, work, ["lsn"]), behind)

    applied = write_history(batch, base, work, dim, email_domain, hit)
    outcomes = written(applied.outcomes, "outcomes")
    batch.append("fact_client_balance_history", applied.balances.withColumns({"batch_id": batch.id, "created_at": batch.at}))
    batch.append("cdc_processing_ledger", ledger_rows(batch, outcomes))
    fresh = outcomes.join(new.select("lsn"), "lsn", "left_semi")
    held = unsupported_records(batch, fresh, seen)
    batch.append("quarantine", insert_if_absent(batch.table("quarantine"), held, ["quarantine_id"], ["source_identifier"]))
    return feed_report(total["rows"], fresh)


_EVENT = ("lsn", "commit_ts", "op", "client_id", "payload_hash", "before", "after")


def _sortable(events: DataFrame) -> DataFrame:
    """Maps cannot be compared; as JSON text they can travel through a per-key pick."""
    return events.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in ("before", "after")})


def _images(events: DataFrame) -> DataFrame:
    return events.withColumns({c: F.from_json(c, "map<string,string>") for c in ("before", "after")})
