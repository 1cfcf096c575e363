"""Rebuilding history from a boundary on. Every client has a boundary of its own: ``client_id`` and ``from_ts``, one row each.

A replay gives all clients of its window the start of the window; a late event gives its client the time from which
on the client's events have to be applied again. Steps join events, versions and balances to the boundaries by client.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import clock
from .keyed import lookup_join


def window_events(events: DataFrame, low: dt.datetime, high: dt.datetime) -> DataFrame:
    """Events committed within the window, both ends included."""
    return events.where(F.col("commit_ts").between(clock.stamp(low), clock.stamp(high)))


def affected_clients(events: DataFrame, low: dt.datetime, high: dt.datetime) -> DataFrame:
    return window_events(events, low, high).select("client_id").distinct()


def same_boundary(affected: DataFrame, low: dt.datetime) -> DataFrame:
    """The boundaries of a replay: one time for all clients."""
    return affected.select("client_id", clock.stamp(low).alias("from_ts"))


def late_clients(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Clients for whom an event arrived below an LSN that has been applied already, with the lowest such LSN."""
    first_new = events.groupBy("client_id").agg(F.min("lsn").alias("from_lsn"))
    overtaken = lookup_join(ledger.select("client_id", "lsn"), first_new, ["client_id"], "inner").where("lsn > from_lsn")
    return overtaken.select("client_id", "from_lsn").distinct()


def late_boundaries(events: DataFrame, late: DataFrame) -> DataFrame:
    """A boundary for each late client: the earliest commit time among its events from the late one on, which lies before the
    late event's own where commit times ran against the log. ``events``: all that have been landed."""
    tail = lookup_join(events.select("client_id", "lsn", "commit_ts"), late, ["client_id"], "inner").where("lsn >= from_lsn")
    return tail.groupBy("client_id").agg(F.min("commit_ts").alias("from_ts"))


def events_to_rebuild(events: DataFrame, boundaries: DataFrame) -> DataFrame:
    """All events of the clients from their boundary through their latest. Stopping earlier would lose later versions."""
    return lookup_join(events, boundaries, ["client_id"], "inner").where("commit_ts >= from_ts").select(*events.columns)


def purge_balances(balances: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Balances without what the clients' events from the boundary on had added. Opening balances stay: no event made them."""
    gone = F.col("from_ts").isNotNull() & (F.col("observed_at") >= F.col("from_ts")) & F.col("lsn").isNotNull()
    return lookup_join(balances, boundaries, ["client_id"]).where(~gone).select(*balances.columns)


def purge_versions(dim: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The dimension without versions that events from the client's boundary on had opened.

    Bootstrap and inferred versions stay, wherever they start: no event could bring them back.
    """
    gone = F.col("from_ts").isNotNull() & (F.col("valid_from") >= F.col("from_ts")) & F.col("opened_by_lsn").isNotNull()
    return lookup_join(dim, boundaries, ["client_id"]).where(~gone).select(*dim.columns)


def reopen_versions(dim: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The version of each client in force at its boundary, or the one it began with if that starts later: open, current and
    not deleted again."""
    at = F.col("from_ts")
    before = (F.col("valid_from") < at) | F.col("opened_by_lsn").isNull()
    reopened = at.isNotNull() & before & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))
    fresh = {
        "valid_to": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True),
        "is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp_ntz"),
    }
    return lookup_join(dim, boundaries, ["client_id"]).select(
        *[F.when(reopened, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in dim.columns]
    )


def base_at(dim: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The dimension as the rebuild starts from it: purged from the boundaries on, and reopened there."""
    return reopen_versions(purge_versions(dim, boundaries), boundaries)
