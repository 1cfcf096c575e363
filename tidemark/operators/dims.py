"""Dimension rows: bootstrap, inferred members, calendar, instruments, key lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .asof import as_of
from .keyed import lookup_join
from .numbering import dense_number

# Start of history, placeholder attributes of an inferred client, first instruments.
HISTORY_START = "2024-01-01 00:00:00"
INFERRED = {
    "country": "Unknown", "nationality": "Unknown", "account_type": "standard", "kyc_status": "pending",
    "referral_source": "organic", "signup_platform": "web", "assigned_manager": "UNASSIGNED",
    "preferred_language": "English", "risk_category": "low", "account_status": "active",
}
INSTRUMENTS = [
    (1, "EUR/USD", "forex"),
    (2, "USD/JPY", "forex"),
    (3, "Gold", "commodities"),
    (4, "BTC/USD", "crypto"),
    (5, "S&P500", "indices"),
]


def top_key(dim: DataFrame, key: str = "client_sk") -> int:
    """The highest surrogate key in use, 0 for an empty table."""
    return dim.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]


def open_version(rows: DataFrame, history_start: str = HISTORY_START, inferred: bool = False) -> DataFrame:
    """Add the columns of a first, open version."""
    return rows.withColumns({
        "valid_from": F.lit(history_start).cast("timestamp_ntz"),
        "valid_to": F.lit(None).cast("timestamp_ntz"),
        "is_current": F.lit(True),
        "is_deleted": F.lit(False),
        "deleted_at": F.lit(None).cast("timestamp_ntz"),
        "is_inferred": F.lit(inferred),
        "opened_by_lsn": F.lit(None).cast("long"),
    })


def known_people(signup: DataFrame, profile: DataFrame) -> DataFrame:
    """The attributes of clients found on both sides."""
    return signup.select(
        "client_id", "email", "country", "account_type", "kyc_status", "referral_source",
        "signup_platform", "promo_code", "assigned_manager",
    ).join(
        profile.select(
            "client_id", "full_name", "date_of_birth", "nationality", "preferred_language",
            "risk_category", "account_status",
        ),
        "client_id",
    )


def bootstrap_clients(signup: DataFrame, profile: DataFrame, dim: DataFrame, history_start: str = HISTORY_START) -> DataFrame:
    """First versions of clients found on both sides and not yet in the dimension, unnumbered."""
    both = known_people(signup, profile)
    return open_version(both.join(dim.select("client_id"), "client_id", "left_anti"), history_start)


def inferred_clients(referenced: DataFrame, dim: DataFrame, history_start: str = HISTORY_START) -> DataFrame:
    """A placeholder version for every client id a trusted fact names and the dimension lacks, unnumbered."""
    missing = (
        referenced.select("client_id").where(F.col("client_id").isNotNull()).distinct()
        .join(dim.select("client_id"), "client_id", "left_anti")
    )
    return open_version(
        missing.withColumns({
            "full_name": F.concat(F.lit("Inferred Client "), F.col("client_id")),
            "date_of_birth": F.lit(None).cast("date"),
            "email": F.concat(F.lower("client_id"), F.lit("@inferred.internal")),
            "promo_code": F.lit(None).cast("string"),
            **{name: F.lit(text) for name, text in INFERRED.items()},
        }),
        history_start,
        inferred=True,
    )


def complete_inferred(dim: DataFrame, arrived: DataFrame) -> DataFrame:
    """Fill placeholder versions from the client's own data once it has arrived."""
    filled = [c for c in arrived.columns if c != "client_id"]
    new = arrived.select("client_id", F.lit(True).alias("_arrived"), *[F.col(c).alias(f"_{c}") for c in filled])
    hit = F.col("is_inferred") & F.coalesce(F.col("_arrived"), F.lit(False))
    return lookup_join(dim, new, ["client_id"]).select(
        *[
            F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in filled
            else (F.col(c) & ~hit).alias(c) if c == "is_inferred" else F.col(c)
            for c in dim.columns
        ]
    )


def opening_balances(profiles: DataFrame, dim: DataFrame, balance: str = "account_balance_usd") -> DataFrame:
    """The profile balance as the first observation of every current client: client_id, observed_at, balance_usd."""
    start = dim.where("is_current").select("client_id", F.col("valid_from").alias("observed_at"))
    found = lookup_join(profiles.select("client_id", F.col(balance).alias("balance_usd")), start, ["client_id"], "inner")
    return found.select("client_id", "observed_at", "balance_usd")


def number_clients(rows: DataFrame, start: int) -> DataFrame:
    """Surrogate keys in client order, after the highest key in use."""
    return dense_number(rows, ["client_id"], "client_sk", start)


def calendar(spark: SparkSession, first: dt.date | Column, last: dt.date | Column, span: DataFrame | None = None) -> DataFrame:
    """One row per date. ``span`` is a one-row DataFrame if the ends are columns."""
    ends = span if span is not None else spark.range(1)
    low, high = (F.lit(e) if isinstance(e, dt.date) else e for e in (first, last))
    days = ends.select(F.explode(F.sequence(low.cast("date"), high.cast("date"), F.expr("interval 1 day"))).alias("date_key"))
    weekday = F.extract(F.lit("DAYOFWEEK_ISO"), F.col("date_key")).cast("int")
    return days.select(
        "date_key",
        F.year("date_key").alias("year"),
        F.quarter("date_key").alias("quarter"),
        F.month("date_key").alias("month"),
        F.dayofmonth("date_key").alias("day"),
        weekday.alias("day_of_week"),
        weekday.isin(6, 7).alias("is_weekend"),
    )


def default_instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, "instrument_sk long, instrument_name string, asset_class string")


def with_client_key(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with the key of the version that is current when they are loaded; null for an unknown client."""
    current = dim.where("is_current").select("client_id", "client_sk")
    return lookup_join(facts, current, ["client_id"])


def with_client_key_as_of(facts: DataFrame, dim: DataFrame, at: str, key: str = "client_sk") -> DataFrame:
    """Facts with the key of the version that was valid at the fact's own time; null before the client's first version,
    after its deletion, and for an unknown client."""
    versions = dim.select("client_id", "valid_from", "valid_to", F.col("client_sk").alias(key))
    return as_of(facts, versions, "client_id", at, "valid_from", [key], [key], until="valid_to")


def with_instrument_key(trades: DataFrame, instruments: DataFrame) -> DataFrame:
    """Trades with their instrument key, null for an unknown instrument."""
    names = instruments.select(F.col("instrument_name").alias("instrument"), "instrument_sk")
    return trades.join(names, "instrument", "left")
