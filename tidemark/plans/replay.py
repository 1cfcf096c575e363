"""Replay of a time window: rebuild the clients it touches and publish the result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from ..functions.clock import window_bounds
from ..operators import replay as steps
from ..operators.keyed import absent_from
from ..session import counted, scratch_run, written
from .changes import EMAIL_DOMAIN, ledger_rows, write_history
from .publish import Warehouse


def replay_window(
    spark: SparkSession, root: str, start: str | dt.datetime, end: str | dt.datetime,
    batch_id: str = "replay_batch", email_domain: str = EMAIL_DOMAIN,
) -> dict[str, object]:
    """Rebuild history and balances of every client with an event in the window, both ends included.

    Only the buckets of these clients are read (but for the search of the window) and written.
    """
    low, high = window_bounds(start, end)
    with scratch_run(spark, "replay"):
        batch = Warehouse(spark, root).begin(batch_id)
        affected, n = counted(steps.affected_clients(batch.table("raw_cdc_events"), low, high), "affected")
        clients = n["rows"]
        if clients == 0:
            return {"replayed_events": 0, "affected_clients": 0, "status": "NOOP"}
        hit = batch.buckets_of(affected)
        boundaries = steps.same_boundary(affected, low)
        dim, ledger = batch.table("dim_client", hit), batch.table("cdc_processing_ledger", hit)
        events, replayed = counted(steps.events_to_rebuild(batch.table("raw_cdc_events", hit), boundaries), "replayed")
        base = written(steps.base_at(dim, boundaries), "base")
        balances = steps.purge_balances(batch.table("fact_client_balance_history", hit), boundaries)
        applied = write_history(batch, base, events, dim, email_domain, hit)
        again = applied.balances.withColumns({"batch_id": batch.id, "created_at": batch.at})
        batch.replace_buckets("fact_client_balance_history", balances.unionByName(again), hit)
        kept = absent_from(ledger, events, ["lsn"])
        batch.replace_buckets("cdc_processing_ledger", kept.unionByName(ledger_rows(batch, applied.outcomes), allowMissingColumns=True), hit)
        batch.publish()
        return {"replayed_events": replayed["rows"], "affected_clients": clients, "status": "SUCCESS", "overlap_count": 0}
