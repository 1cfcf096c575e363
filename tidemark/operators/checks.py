"""Invariants of history and keys, and signals about deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keyed import lookup_join
from .numbering import in_order, rank_blocks

_VERSION = ("client_id", "client_sk", "valid_from", "valid_to")


def ordered_versions(dim: DataFrame) -> DataFrame:
    """The versions sorted by client and start, written once, for the checks that look at them in that order."""
    return in_order(dim.select(*_VERSION), ["client_id", "valid_from", "client_sk"])


def _with_earlier(dim: DataFrame, value: Column, best: Callable[[Column | str], Column]) -> DataFrame:
    """Versions with ``earlier``: ``value`` aggregated over all versions of the client that start before.

    The versions are sorted into parts of bounded size. Windows over versions run per (client, part), windows
    per client only over one summary per part, so that no client's history is ever in one task. ``dim`` may be sorted
    already, by ``ordered_versions``.
    """
    versions = dim if "_slot" in dim.columns else ordered_versions(dim)
    sums = versions.groupBy("client_id", "_part").agg(best(value).alias("_sum"))
    before = Window.partitionBy("client_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("client_id", "_part", best("_sum").over(before).alias("_carried"))
    within = Window.partitionBy("client_id", "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    joined = versions.withColumn("_within", best(value).over(within)).join(carried, ["client_id", "_part"])
    return joined.select(*_VERSION, F.greatest("_within", "_carried").alias("earlier"))


def overlapping_versions(dim: DataFrame) -> DataFrame:
    """Versions that start before an earlier-starting version of the client has ended.

    Linear in the number of versions: an overlap exists exactly where a start lies before the latest end so far.
    """
    forever = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    return _with_earlier(dim, F.coalesce("valid_to", forever), F.max).where("earlier > valid_from").select(*_VERSION)


def history_gaps(dim: DataFrame) -> DataFrame:
    """Versions that do not start where the version before them ended."""
    rows = _with_earlier(dim, F.struct("valid_from", "client_sk", "valid_to"), F.max).where("earlier is not null")
    previous = F.col("earlier.valid_to")
    return rows.where(~previous.eqNullSafe(F.col("valid_from"))).select(
        "client_id", "client_sk", previous.alias("previous_end"), "valid_from"
    )


def backward_versions(dim: DataFrame) -> DataFrame:
    """Versions that end before they start: commit times ran against the log order."""
    return dim.where(F.col("valid_to") < F.col("valid_from"))


def conflicting_lsns(events: DataFrame) -> DataFrame:
    """Log positions that came with more than one payload."""
    spread = events.groupBy("lsn").agg(F.min("payload_hash").alias("low"), F.max("payload_hash").alias("high"))
    return spread.where("low <> high").select("lsn")


def log_gaps(events: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Holes in the log: the position before the hole, the one after it and how many are missing.

    Blocks are runs of ``block`` positions that are there, so holes do not make more of them.
    """
    blocked = rank_blocks(events.select("lsn").distinct(), ["lsn"], block)
    ends = blocked.groupBy("block").agg(F.max("lsn").alias("last"))
    carried = ends.select("block", F.lag("last").over(Window.orderBy("block")).alias("carried"))
    within = F.lag("lsn").over(Window.partitionBy("block").orderBy("lsn"))
    return (
        blocked.withColumn("within", within).join(carried, "block")
        .select(F.coalesce("within", "carried").alias("after_lsn"), F.col("lsn").alias("before_lsn"))
        .where("before_lsn - after_lsn > 1")
        .withColumn("missing", F.col("before_lsn") - F.col("after_lsn") - 1)
    )


def event_contract_violations(events: DataFrame) -> DataFrame:
    """Events without the images their operation requires, or with a balance that is not a number."""
    op, before, after = F.col("op"), F.col("before"), F.col("after")
    balance = F.try_element_at(after, F.lit("account_balance_usd"))
    problem = (
        F.when((op == "insert") & after.isNull(), "INSERT_WITHOUT_AFTER")
        .when((op == "update") & after.isNull(), "UPDATE_WITHOUT_AFTER")
        .when((op == "update") & before.isNull(), "UPDATE_WITHOUT_BEFORE")
        .when((op == "delete") & before.isNull(), "DELETE_WITHOUT_BEFORE")
        .when(balance.isNotNull() & balance.try_cast("decimal(18,2)").isNull(), "MALFORMED_BALANCE")
    )
    return events.select("lsn", "client_id", "op", problem.alias("violation")).where("violation is not null")


def conflicting_inserts(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Insert events for known clients that say something else than the current version does."""
    current = dim.where("is_current").select(
        "client_id", F.col("risk_category").alias("known_risk"), F.col("account_status").alias("known_status")
    )
    given = events.where("op = 'insert'").select(
        "lsn", "client_id",
        F.try_element_at("after", F.lit("risk_category")).alias("event_risk"),
        F.try_element_at("after", F.lit("account_status")).alias("event_status"),
    )
    differs = (F.col("event_risk") != F.col("known_risk")) | (F.col("event_status") != F.col("known_status"))
    return lookup_join(given, current, ["client_id"], "inner").where(differs).select(
        "lsn", "client_id", "event_risk", "known_risk", "event_status", "known_status"
    )


def cross_source_candidates(warehouse: DataFrame, vendor: DataFrame) -> DataFrame:
    """Vendor deposits that a warehouse deposit resembles: same client, date, currency and method, and an
    amount within one cent. Reported per vendor deposit, never merged.

    The amount in cents is part of the join key, and the warehouse side is counted per key first, so the
    result has at most one row per vendor deposit however many copies there are.
    """
    match = ["client_id", "deposit_date", "currency_original", "payment_method"]
    cents = (F.col("amount_usd") * 100).cast("long")
    counted = warehouse.groupBy(*match, cents.alias("cents")).agg(
        F.count("*").alias("n"), F.min("deposit_id").alias("low")
    )
    near = vendor.select("deposit_id", *match, F.explode(F.array(cents - 1, cents, cents + 1)).alias("cents"))
    return (
        lookup_join(near, counted, [*match, "cents"], "inner")
        .groupBy("deposit_id")
        .agg(F.sum("n").cast("long").alias("candidates"), F.min("low").alias("first_candidate"))
    )
