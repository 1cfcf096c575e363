"""The published business queries, as functions of the curated tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import clock, masking
from ..operators.asof import as_of
from ..operators.keyed import latest_by
from ..schemas import period_of

_MONEY = "decimal(18,2)"


def latest_clients(dim: DataFrame, *columns: str) -> DataFrame:
    """The latest version of every client, deleted ones included."""
    kept = dim.select("client_id", "valid_from", "client_sk", *[c for c in columns if c != "client_sk"])
    return latest_by(kept, ["client_id"], ["valid_from", "client_sk"], ["client_id", *columns])


def latest_balances(balances: DataFrame) -> DataFrame:
    """The last balance observed per client, ties broken by LSN."""
    kept = balances.select("client_id", "observed_at", "lsn", "balance_usd")
    return latest_by(kept, ["client_id"], ["observed_at", "lsn"], ["client_id", "observed_at", "balance_usd"])


def _or_zero(name: str) -> F.Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(_MONEY).alias(name)


def client_value(dim: DataFrame, deposits: DataFrame, trades: DataFrame, balances: DataFrame, top: int = 15) -> DataFrame:
    """Which clients contribute the most value? Each fact is summed per client before anything is joined."""
    completed = F.when(F.col("status") == "completed", F.col("amount_usd"))
    paid = deposits.groupBy("client_id").agg(
        F.sum(completed).alias("completed_deposits_usd"), F.sum("fee_usd").alias("deposit_fees_usd")
    )
    earned = trades.groupBy("client_id").agg(F.sum("pnl_usd").alias("trading_pnl_usd"))
    clients = latest_clients(dim, "country", "account_type", "account_status", "is_deleted")
    return (
        clients.join(paid, "client_id", "left").join(earned, "client_id", "left")
        .join(latest_balances(balances).drop("observed_at"), "client_id", "left")
        .select(
            "client_id", "country", "account_type", "account_status", "is_deleted",
            F.col("balance_usd").alias("latest_cdc_balance_usd"),
            _or_zero("completed_deposits_usd"), _or_zero("deposit_fees_usd"), _or_zero("trading_pnl_usd"),
        )
        .where("completed_deposits_usd > 0 or trading_pnl_usd <> 0")
        .orderBy(F.desc("completed_deposits_usd"), F.desc("trading_pnl_usd"), "client_id")
        .limit(top)
    )


def country_performance(dim: DataFrame, deposits: DataFrame, trades: DataFrame) -> DataFrame:
    """Clients, paid deposits, trades and trading result by country."""
    paid = deposits.where("status = 'completed'").groupBy("client_id").agg(F.sum("amount_usd").alias("deposit_usd"))
    traded = trades.groupBy("client_id").agg(F.count("*").alias("trade_count"), F.sum("pnl_usd").alias("pnl_usd"))
    return (
        latest_clients(dim, "country")
        .join(paid, "client_id", "left").join(traded, "client_id", "left")
        # latest_clients has one row per client, so counting rows counts distinct clients
        .groupBy("country").agg(
            F.count("client_id").alias("clients"),
            F.coalesce(F.sum("deposit_usd"), F.lit(0)).cast(_MONEY).alias("completed_deposits_usd"),
            F.coalesce(F.sum("trade_count"), F.lit(0)).cast("long").alias("trades"),
            F.coalesce(F.sum("pnl_usd"), F.lit(0)).cast(_MONEY).alias("trading_pnl_usd"),
        )
        .orderBy(F.desc("completed_deposits_usd"), F.desc("trading_pnl_usd"), F.asc_nulls_last("country"))
    )


def instrument_performance(trades: DataFrame) -> DataFrame:
    """Which instruments drive activity and profit?"""
    won = F.when(F.col("pnl_usd") > 0, 1).otherwise(0)
    return (
        trades.groupBy("instrument").agg(
            F.count("*").alias("trades"),
            F.sum("volume_lots").cast("decimal(18,4)").alias("total_volume_lots"),
            F.sum("pnl_usd").cast(_MONEY).alias("total_pnl_usd"),
            F.round(F.avg(F.col("pnl_usd").cast("double")), 2).alias("average_pnl_usd"),
            F.round(100.0 * F.avg(won), 1).alias("profitable_trade_pct"),
        )
        .orderBy(F.desc("total_pnl_usd"), F.asc_nulls_last("instrument"))
    )


def deposit_operations(deposits: DataFrame, quarantine: DataFrame) -> DataFrame:
    """What arrived from each source, and what needs attention?"""
    curated = deposits.groupBy("source_system").agg(
        F.count("*").alias("records"), F.sum("amount_usd").cast(_MONEY).alias("amount_usd"),
        F.sum("fee_usd").cast(_MONEY).alias("fee_usd"),
    ).select(F.lit("curated_deposits").alias("record_group"), F.col("source_system").alias("category"),
             "records", "amount_usd", "fee_usd")
    held = quarantine.groupBy("reason_code").agg(F.count("*").alias("records")).select(
        F.lit("quarantine").alias("record_group"), F.col("reason_code").alias("category"), "records",
        F.lit(None).cast(_MONEY).alias("amount_usd"), F.lit(None).cast(_MONEY).alias("fee_usd"),
    )
    return curated.unionByName(held).orderBy("record_group", "category")


def versions_as_of(dim: DataFrame, moment: dt.datetime) -> DataFrame:
    """Versions in force at a moment: started by then and not yet ended."""
    at = clock.stamp(moment)
    return dim.where((F.col("valid_from") <= at) & ((F.col("valid_to") > at) | F.col("valid_to").isNull()))


def client_state_as_of(dim: DataFrame, balances: DataFrame, moment: dt.datetime) -> DataFrame:
    """What was known of each client at a moment: version in force and last balance observed.

    The moment is a literal and not a joined parameter row, so both scans can skip files by it.
    """
    at = clock.stamp(moment)
    known = latest_balances(balances.where(F.col("observed_at") <= at))
    return (
        versions_as_of(dim, moment).join(known, "client_id")
        .select(
            "client_id", "risk_category", "account_status", "is_deleted",
            F.col("balance_usd").alias("latest_cdc_balance_usd"),
            F.col("observed_at").alias("balance_observed_at"), at.alias("as_of_ts"),
        )
        .orderBy("client_id")
    )


def masked_clients(dim: DataFrame) -> DataFrame:
    """The client dimension without personal data, for general use."""
    return dim.select(
        "client_sk", "client_id",
        masking.mask_name(F.col("full_name")).alias("full_name_masked"),
        masking.birth_year(F.col("date_of_birth")).alias("birth_year"),
        masking.mask_email(F.col("email")).alias("email_masked"),
        "country", "nationality", "account_type", "kyc_status", "referral_source", "signup_platform",
        "preferred_language", "risk_category", "account_status", "valid_from", "valid_to", "is_current", "is_deleted",
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, in one DataFrame."""
    counts = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def quarantine_summary(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("reason_code", "severity").agg(F.count("*").alias("records"))


def deposit_breakdown(deposits: DataFrame) -> DataFrame:
    return deposits.groupBy("source_system", "reconciliation_status").agg(F.count("*").alias("records"))


def deposits_by_state(deposits: DataFrame, dim: DataFrame, balances: DataFrame) -> DataFrame:
    """Completed deposits by the client's risk and status when they were made, and by whether a balance was known then.

    The moment of a deposit is the end of its business day: the version valid then, and the latest balance change at or
    before it.
    """
    moment = (F.col("deposit_date") + F.expr("interval 1 day")).cast("timestamp_ntz") - F.expr("interval 1 microsecond")
    made = deposits.where("status = 'completed'").select("client_id", "amount_usd", moment.alias("made_at"))
    states = as_of(made, dim, "client_id", "made_at", "valid_from", ["risk_category", "account_status"], ["client_sk"], until="valid_to")
    known = as_of(states, balances, "client_id", "made_at", "observed_at", ["balance_usd"], ["lsn"])
    return known.groupBy("risk_category", "account_status", F.col("balance_usd").isNotNull().alias("balance_known")).agg(
        F.count("*").alias("deposits"), F.sum("amount_usd").alias("amount_usd")
    )


def deposits_in(deposits: DataFrame, days: DataFrame) -> DataFrame:
    """Completed deposits on the given days of the calendar, by month and source.

    The month is part of the join, so Spark reads only the folders of months that the chosen days fall in. A calendar has a
    few hundred days a year and grows with nothing else, so it may always be broadcast; pruning rests on that.
    """
    chosen = F.broadcast(days.select(F.col("date_key").alias("deposit_date"), period_of("date_key").alias("period")))
    return deposits.where("status = 'completed'").join(chosen, ["period", "deposit_date"]).groupBy("period", "source_system").agg(
        F.count("*").alias("deposits"), F.sum("amount_usd").alias("amount_usd"))
