"""Change events into a type-2 dimension, an append-only balance fact and a processing ledger.

Events take effect in LSN order. Per client:

* *birth*: a client already in the dimension is born before every event; any other client is born by its
  first insert event. Every other insert is only reconciled.
* *death*: the first delete after birth. A known client without a current version is dead from the start.
* *live* events: the birth event, and the updates between birth and death.

State is carried forward over live events, a version starts where risk or status changes, and it ends
where the next one starts or at death.

**No client is ever one task.** A block is a run of ``BLOCK`` consecutive events of the log, whatever the distance of
their LSNs and however they are spread over clients. All windows over events run per (client, block).
What crosses a block is one summary row per (client, block), and only those summaries are ordered per client.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import images
from .keyed import lookup_join
from .numbering import rank_blocks

BLOCK = 1 << 20

# Defaults of a client first seen in the change feed.
DEFAULT_RISK = "medium"
DEFAULT_STATUS = "active"
FEED_DEFAULTS = {
    "country": "Unknown",
    "account_type": "standard",
    "kyc_status": "approved",
    "referral_source": "cdc_stream",
    "signup_platform": "system",
    "assigned_manager": "UNASSIGNED",
    "preferred_language": "English",
}
# Image keys.
RISK, STATUS, BALANCE = "risk_category", "account_status", "account_balance_usd"
# Ledger outcomes.
APPLIED, RECONCILED, QUARANTINED = "APPLIED", "RECONCILED", "QUARANTINED"

_EVER, _NEVER = -(1 << 62), 1 << 62  # before and after every LSN


@dataclass(frozen=True)
class Applied:
    """What a set of events does to a dimension. Only the events' order has been computed yet."""

    starts: DataFrame    #: new versions: client_id, opened_by_lsn, risk, status, valid_from .. deleted_at
    closures: DataFrame  #: for versions that were current before: client_id, valid_to, is_deleted, deleted_at
    balances: DataFrame  #: lsn, client_id, observed_at, balance_usd
    outcomes: DataFrame  #: one row per event: lsn, payload_hash, client_id, op, outcome


def narrow_events(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """The few typed columns the history needs, taken out of the images before anything is shuffled, and the block.

    The events are sorted by LSN for their blocks, which writes them once.
    """
    before, after = F.col("before"), F.col("after")
    is_insert = F.col("op") == "insert"
    narrow = events.select(
        "client_id", "lsn", "commit_ts", "op", "payload_hash",
        F.when(is_insert, F.struct(images.value_or(after, RISK, DEFAULT_RISK).alias("v")))
        .when(images.present(after, RISK), F.struct(images.value(after, RISK).alias("v"))).alias("risk_set"),
        F.when(is_insert, F.struct(images.value_or(after, STATUS, DEFAULT_STATUS).alias("v")))
        .when(images.present(after, STATUS), F.struct(images.value(after, STATUS).alias("v"))).alias("status_set"),
        images.present(after, BALANCE).alias("has_balance"),
        images.money(before, BALANCE).alias("balance_before"),
        images.money(after, BALANCE).alias("balance_after"),
    )
    return rank_blocks(narrow, ["lsn"], block)


def known_clients(dim: DataFrame) -> DataFrame:
    """One row per client of the dimension, with its current version if there is one."""
    current = F.when(
        F.col("is_current"),
        F.struct(F.struct(F.col(RISK).alias("v")).alias("risk"), F.struct(F.col(STATUS).alias("v")).alias("status")),
    )
    return dim.groupBy("client_id").agg(F.max(current).alias("base")).withColumn("known", F.lit(True))


def _block_summaries(narrow: DataFrame) -> DataFrame:
    """Per (client, block) all that other blocks need to know of it.

    Last values set and first delete come in two readings, over the whole block and after the block's
    first insert, because only the order of the blocks tells which one counts. For each attribute
    ``_first`` is the first value set and ``_turn`` the first event that sets another one: whatever the
    state on entry, the first change in the block is one of the two.
    """
    whole = Window.partitionBy("client_id", "block")
    in_order = whole.orderBy("lsn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_update = F.col("op") == "update"

    def first_set(name: str) -> Column:
        return F.first(F.when(is_update, F.col(f"{name}_set")), ignorenulls=True).over(in_order)

    rows = (
        narrow.where(F.col("op").isin("insert", "update", "delete"))
        .withColumn("ins", F.min(F.when(F.col("op") == "insert", F.col("lsn"))).over(whole))
        .withColumn("risk_1", first_set("risk"))
        .withColumn("status_1", first_set("status"))
    )
    is_delete, is_birth = F.col("op") == "delete", F.col("lsn") == F.col("ins")
    after_insert = F.col("lsn") > F.col("ins")
    place = F.struct("lsn", "commit_ts")

    def readings(name: str) -> list[Column]:
        given = F.col(f"{name}_set")
        update = is_update & given.isNotNull()
        last = F.struct("lsn", given.alias("set"))
        other = ~given["v"].eqNullSafe(F.col(f"{name}_1")["v"])
        return [
            F.max(F.when(update, last))["set"].alias(f"{name}_any"),
            F.max(F.when(is_birth | (update & after_insert), last))["set"].alias(f"{name}_after"),
            F.min(F.when(update, F.struct("lsn", "commit_ts", given.alias("set")))).alias(f"{name}_first"),
            F.min(F.when(update & other, place)).alias(f"{name}_turn"),
        ]

    return rows.groupBy("client_id", "block").agg(
        F.min(F.when(is_birth, place)).alias("ins"),
        F.min(F.when(is_delete, place)).alias("del_any"),
        F.min(F.when(is_delete & after_insert, place)).alias("del_after"),
        *readings("risk"),
        *readings("status"),
    )


def _lives(summaries: DataFrame, known: DataFrame) -> DataFrame:
    """Per (client, block): the client's birth and death, the state on entry, and when the next version
    after this block starts. Ordered per client, but over one row per block."""
    client = Window.partitionBy("client_id")
    earlier = client.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later_blocks = client.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    is_known = F.coalesce(F.col("known"), F.lit(False))
    here = F.col("birth") == F.col("ins.lsn")  # the birth event lies in this block
    later = is_known | (F.col("block") > F.min(F.when(here, F.col("block"))).over(client))
    dead_from_start = is_known & F.col("base").isNull()

    def pick(name: str) -> Column:
        return F.when(F.col("later"), F.col(f"{name}_any")).when(here, F.col(f"{name}_after"))

    def on_entry(name: str) -> Column:
        return F.coalesce(F.last(pick(name), ignorenulls=True).over(earlier), F.col(f"base.{name}"))

    def first_change(name: str) -> Column:
        first = F.col(f"{name}_first")
        differs = ~first["set"]["v"].eqNullSafe(F.col(f"{name}_in")["v"])
        return F.when(first.isNotNull() & differs, F.struct(first["lsn"].alias("lsn"), first["commit_ts"].alias("commit_ts"))).otherwise(
            F.col(f"{name}_turn")
        )

    entered = (
        summaries.join(known, "client_id", "left")
        .withColumn("birth", F.when(is_known, F.lit(_EVER)).otherwise(F.min("ins.lsn").over(client)).cast("long"))
        .withColumn("later", later)
        .withColumn("end", F.min(pick("del")).over(client))
        .withColumn("death", F.when(dead_from_start, F.lit(_EVER)).otherwise(F.coalesce("end.lsn", F.lit(_NEVER))))
        .withColumn("risk_in", on_entry("risk"))
        .withColumn("status_in", on_entry("status"))
    )
    change = F.when(here, F.col("ins")).when(F.col("later"), F.least(first_change("risk"), first_change("status")))
    return entered.withColumn("change", F.when(change["lsn"] < F.col("death"), change)).select(
        "client_id", "block", "birth", "death", "risk_in", "status_in", "change",
        F.col("base").isNotNull().alias("has_base"),
        F.when(~dead_from_start, F.col("end.commit_ts")).alias("death_ts"),
        F.first("change.commit_ts", ignorenulls=True).over(later_blocks).alias("next_block_ts"),
    )


def _live_events(placed: DataFrame) -> DataFrame:
    """Birth events and live updates, each with the state after it and whether that opens a version."""
    is_birth = (F.col("op") == "insert") & (F.col("lsn") == F.col("birth"))
    is_update = (F.col("op") == "update") & (F.col("lsn") > F.col("birth")) & (F.col("lsn") < F.col("death"))
    before = Window.partitionBy("client_id", "block").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str) -> Column:
        return F.coalesce(F.last(f"{name}_set", ignorenulls=True).over(before), F.col(f"{name}_in"))

    def moved(name: str) -> Column:
        now, was = F.col(f"{name}_set"), F.col(f"{name}_was")
        return now.isNotNull() & ~now["v"].eqNullSafe(was["v"])

    return (
        placed.where(is_birth | is_update)
        .withColumn("is_birth", F.col("op") == "insert")
        .withColumn("risk_was", carried("risk"))
        .withColumn("status_was", carried("status"))
        .withColumn("risk", F.coalesce("risk_set", "risk_was")["v"])
        .withColumn("status", F.coalesce("status_set", "status_was")["v"])
        .withColumn("opens", F.col("is_birth") | moved("risk") | moved("status"))
    )


def apply_events(
    dim: DataFrame, events: DataFrame, block: int = BLOCK, hold: Callable[[DataFrame, str], DataFrame] | None = None
) -> Applied:
    """Apply ``events`` (unique by LSN, none applied before) on top of ``dim``.

    ``events``: lsn, commit_ts, op, client_id, payload_hash and the images before and after. A caller that
    needs more than one of the results passes ``hold`` to keep the shared parts, e.g. ``session.written``.
    """
    keep = hold or (lambda df, label: df)
    narrow = narrow_events(events, block)  # written already
    lives = keep(_lives(_block_summaries(narrow), known_clients(dim)), "lives")
    placed = narrow.join(lives, ["client_id", "block"], "left")
    live = keep(_live_events(placed), "live")

    opened = live.where("opens").select(
        "client_id", "block", F.col("lsn").alias("opened_by_lsn"), F.col("commit_ts").alias("valid_from"),
        F.col("risk").alias(RISK), F.col("status").alias(STATUS), "is_birth", "death_ts", "next_block_ts",
    )
    here = Window.partitionBy("client_id", "block").orderBy("opened_by_lsn")
    next_ts = F.coalesce("next_here", "next_block_ts")
    deleted = next_ts.isNull() & F.col("death_ts").isNotNull()
    starts = opened.withColumn("next_here", F.lead("valid_from").over(here)).select(
        "client_id", "opened_by_lsn", RISK, STATUS, "is_birth", "valid_from",
        F.coalesce(next_ts, F.col("death_ts")).alias("valid_to"),
        F.coalesce(next_ts, F.col("death_ts")).isNull().alias("is_current"),
        deleted.alias("is_deleted"),
        F.when(deleted, F.col("death_ts")).alias("deleted_at"),
    )

    first_ts = F.col("first")["commit_ts"]
    closures = (
        lives.where("has_base")
        .groupBy("client_id")
        .agg(F.min("change").alias("first"), F.min("death_ts").alias("death_ts"))
        .select(
            "client_id",
            F.coalesce(first_ts, F.col("death_ts")).alias("valid_to"),
            first_ts.isNull().alias("is_deleted"),
            F.when(first_ts.isNull(), F.col("death_ts")).alias("deleted_at"),
        )
        .where(F.col("valid_to").isNotNull())
    )

    changed = ~F.col("balance_before").eqNullSafe(F.col("balance_after"))
    balances = live.where((F.col("op") == "update") & F.col("has_balance") & changed).select(
        "lsn", "client_id", F.col("commit_ts").alias("observed_at"), F.col("balance_after").alias("balance_usd")
    )
    outcome = (
        F.when((F.col("op") == "insert") & ~F.col("birth").eqNullSafe(F.col("lsn")), RECONCILED)
        .when(F.col("op").isin("insert", "update", "delete"), APPLIED)
        .otherwise(QUARANTINED)
    )
    outcomes = placed.select("lsn", "payload_hash", "client_id", "op", outcome.alias("outcome"))
    return Applied(starts, closures, balances, outcomes)


def feed_identity(events: DataFrame, email_domain: str) -> DataFrame:
    """Descriptive attributes of a client as an insert event gives them, one row per insert event."""
    after = F.col("after")
    given = {
        "full_name": images.value(after, "full_name"),
        "date_of_birth": images.value(after, "date_of_birth").try_cast("date"),
        "email": F.concat(F.lower("client_id"), F.lit("@"), F.lit(email_domain)),
        "nationality": images.value(after, "nationality"),
        "promo_code": F.lit(None).cast("string"),
    }
    fixed = {k: F.lit(v) for k, v in FEED_DEFAULTS.items()}
    fixed["preferred_language"] = images.value_or(after, "preferred_language", FEED_DEFAULTS["preferred_language"])
    return events.where("op = 'insert'").select(
        "client_id", F.col("lsn").alias("opened_by_lsn"), *[c.alias(n) for n, c in {**given, **fixed}.items()]
    )


#: attributes copied from version to version
DESCRIPTIVE = (
    "full_name", "date_of_birth", "email", "country", "nationality", "account_type", "kyc_status",
    "referral_source", "signup_platform", "promo_code", "assigned_manager", "preferred_language",
)


def describe_starts(starts: DataFrame, dim: DataFrame, events: DataFrame, email_domain: str) -> DataFrame:
    """New versions with their descriptive attributes, from the version they follow or from the birth event."""
    born = starts.where("is_birth").select("client_id", "opened_by_lsn")
    from_feed = feed_identity(events, email_domain).join(born, ["client_id", "opened_by_lsn"], "left_semi")
    origin = dim.where("is_current").select("client_id", *DESCRIPTIVE).unionByName(
        from_feed.select("client_id", *DESCRIPTIVE)
    )
    return lookup_join(starts, origin, ["client_id"]).withColumn("is_inferred", F.lit(False))


def close_current(dim: DataFrame, closures: DataFrame) -> DataFrame:
    """``dim`` with the current versions of the closed clients ended or soft-deleted."""
    ends = closures.select(
        "client_id", F.col("valid_to").alias("c_to"), F.col("is_deleted").alias("c_del"), F.col("deleted_at").alias("c_at")
    )
    hit = F.col("is_current") & F.col("c_to").isNotNull()
    return lookup_join(dim, ends, ["client_id"]).select(
        *[
            F.when(hit, new).otherwise(F.col(name)).alias(name) if new is not None else F.col(name)
            for name, new in (
                (c, {"valid_to": F.col("c_to"), "is_current": F.lit(False),
                     "is_deleted": F.col("c_del"), "deleted_at": F.col("c_at")}.get(c))
                for c in dim.columns
            )
        ]
    )
