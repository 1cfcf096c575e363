"""The published business queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.keyed import latest_by, lookup_join
from ..plans import analytics
from . import tables as t
from .registry import query
from .rules import _judged, _quarantine

# All customers from the start, and one more version of a user per view event.
t.CTES["versions"] = """
SELECT client_sk, client_id, country, account_type, account_status, false AS is_deleted, TIMESTAMP '1995-01-01 00:00:00' AS valid_from
FROM clients
UNION ALL
SELECT 1000000000000 + lsn, f.client_id, c.country, c.account_type, coalesce(f.status, 'closed'), f.status IS NULL, f.commit_ts
FROM feed f JOIN clients c ON f.client_id = c.client_id WHERE f.event_type = 'view'"""
t.CTES["latest"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY valid_from DESC, client_sk DESC) AS place FROM versions) v WHERE place = 1"""
t.CTES["observed"] = """
SELECT lsn, client_id, commit_ts AS observed_at, balance_after AS balance_usd FROM feed WHERE has_balance"""
t.CTES["latest_balance"] = """
SELECT client_id, observed_at, balance_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY observed_at DESC, lsn DESC) AS place FROM observed) b WHERE place = 1"""


def versions(spark: SparkSession, folder: str) -> DataFrame:
    people = t.clients(spark, folder).select("client_sk", "client_id", "country", "account_type", "account_status")
    first = people.withColumns({"is_deleted": F.lit(False), "valid_from": F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")})
    k = F.get_json_object("props", "$.k").cast("int")
    views = t.table(spark, folder, "events").where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("client_id"), (F.lit(1_000_000_000_000) + F.col("event_id")).alias("client_sk"),
        k.alias("k"), F.col("ts").alias("valid_from"),
    )
    status = F.when(F.col("k") < 50, "active").when(F.col("k") < 90, "under_review").otherwise("closed")
    later = lookup_join(views, people.select("client_id", "country", "account_type"), ["client_id"], "inner").select(
        "client_sk", "client_id", "country", "account_type", status.alias("account_status"),
        (F.col("k") >= 90).alias("is_deleted"), "valid_from",
    )
    return first.unionByName(later)


def observed(spark: SparkSession, folder: str) -> DataFrame:
    events = t.table(spark, folder, "events").where("event_type = 'purchase'")
    return events.select(
        F.col("event_id").alias("lsn"), F.col("user_id").cast("string").alias("client_id"), F.col("ts").alias("observed_at"),
        F.col("value").cast("decimal(18,2)").alias("balance_usd"),
    )


@query("client_value", t.with_("clients feed versions latest deposits client_trades observed latest_balance", """
SELECT c.client_id, c.country, c.account_type, c.account_status, c.is_deleted, b.balance_usd AS latest_cdc_balance_usd,
       CAST(coalesce(d.completed, 0) AS DECIMAL(18,2)) AS completed_deposits_usd, CAST(coalesce(d.fees, 0) AS DECIMAL(18,2)) AS deposit_fees_usd,
       CAST(coalesce(p.pnl, 0) AS DECIMAL(18,2)) AS trading_pnl_usd
FROM latest c
LEFT JOIN (SELECT client_id, sum(amount_usd) FILTER (WHERE status = 'completed') AS completed, sum(fee_usd) AS fees FROM deposits GROUP BY client_id) d ON c.client_id = d.client_id
LEFT JOIN (SELECT client_id, sum(pnl_usd) AS pnl FROM client_trades GROUP BY client_id) p ON c.client_id = p.client_id
LEFT JOIN latest_balance b ON c.client_id = b.client_id
WHERE coalesce(d.completed, 0) > 0 OR coalesce(p.pnl, 0) <> 0
ORDER BY completed_deposits_usd DESC, trading_pnl_usd DESC, c.client_id LIMIT 15"""))
def client_value(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.client_value(
        versions(spark, folder), t.deposits(spark, folder), t.client_trades(spark, folder), observed(spark, folder)
    )


@query("country_performance", t.with_("clients feed versions latest deposits client_trades", """
SELECT c.country, count(DISTINCT c.client_id) AS clients, CAST(sum(coalesce(d.usd, 0)) AS DECIMAL(18,2)) AS completed_deposits_usd,
       CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS trades, CAST(sum(coalesce(p.pnl, 0)) AS DECIMAL(18,2)) AS trading_pnl_usd
FROM latest c
LEFT JOIN (SELECT client_id, sum(amount_usd) AS usd FROM deposits WHERE status = 'completed' GROUP BY client_id) d ON c.client_id = d.client_id
LEFT JOIN (SELECT client_id, count(*) AS n, sum(pnl_usd) AS pnl FROM client_trades GROUP BY client_id) p ON c.client_id = p.client_id
GROUP BY c.country ORDER BY 3 DESC, 5 DESC"""))
def country_performance(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.country_performance(versions(spark, folder), t.deposits(spark, folder), t.client_trades(spark, folder))


@query("instrument_performance", t.with_("instrument_trades", """
SELECT instrument, count(*) AS trades, CAST(sum(volume_lots) AS DECIMAL(18,4)) AS total_volume_lots, CAST(sum(pnl_usd) AS DECIMAL(18,2)) AS total_pnl_usd,
       round(avg(CAST(pnl_usd AS DOUBLE)), 2) AS average_pnl_usd, round(100.0 * avg(CASE WHEN pnl_usd > 0 THEN 1 ELSE 0 END), 1) AS profitable_trade_pct
FROM instrument_trades GROUP BY instrument ORDER BY total_pnl_usd DESC"""))
def instrument_performance(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.instrument_performance(t.instrument_trades(spark, folder))


@query("deposit_operations", t.with_("deposits " + t.VENDOR, """
SELECT 'curated_deposits' AS record_group, source_system AS category, count(*) AS records, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS amount_usd,
       CAST(sum(fee_usd) AS DECIMAL(18,2)) AS fee_usd FROM deposits GROUP BY source_system
UNION ALL
SELECT 'quarantine', disposition, count(*), NULL, NULL FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE') GROUP BY disposition
ORDER BY 1, 2"""))
def deposit_operations(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.deposit_operations(t.deposits(spark, folder), _quarantine(spark, folder))


@query("client_state_as_of", t.with_(t.FULL + " balances", """
SELECT d.client_id, d.risk_category, d.account_status, d.is_deleted, b.balance_usd AS latest_cdc_balance_usd, b.observed_at AS balance_observed_at,
       TIMESTAMP '2024-01-20 12:00:00' AS as_of_ts
FROM dim d JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY observed_at DESC, lsn DESC) AS place
                                FROM balances WHERE observed_at <= TIMESTAMP '2024-01-20 12:00:00') x WHERE place = 1) b ON d.client_id = b.client_id
WHERE d.valid_from <= TIMESTAMP '2024-01-20 12:00:00' AND (d.valid_to > TIMESTAMP '2024-01-20 12:00:00' OR d.valid_to IS NULL)
ORDER BY d.client_id"""))
def client_state_as_of(spark: SparkSession, folder: str) -> DataFrame:
    dim, applied = t.full_dimension(spark, folder)
    return analytics.client_state_as_of(dim, applied.balances, dt.datetime(2024, 1, 20, 12))


@query("latest_version", t.with_("clients feed versions latest", "SELECT client_id, client_sk, account_status, valid_from FROM latest"))
def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    rows = versions(spark, folder).select("client_id", "client_sk", "account_status", "valid_from")
    return latest_by(rows, ["client_id"], ["valid_from", "client_sk"])


@query("latest_balance", t.with_("feed observed latest_balance", "SELECT client_id, observed_at, balance_usd FROM latest_balance"))
def latest_balance(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.latest_balances(observed(spark, folder))


@query("run_summary", t.with_(t.VENDOR + " feed versions deposits observed", """
SELECT 'dim_client' AS table_name, count(*) AS rows FROM versions UNION ALL SELECT 'fact_deposit', count(*) FROM deposits
UNION ALL SELECT 'fact_client_balance_history', count(*) FROM observed
UNION ALL SELECT 'quarantine', count(*) FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE')"""))
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.table_counts({
        "dim_client": versions(spark, folder), "fact_deposit": t.deposits(spark, folder),
        "fact_client_balance_history": observed(spark, folder), "quarantine": _judged(spark, folder).where("verdict is not null"),
    })
