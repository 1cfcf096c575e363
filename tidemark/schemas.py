"""Table schemas. Every table is read and written with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LINEAGE = "file_name string, file_hash string, batch_id string, landed_at timestamp_ntz"
_AUDIT = "batch_id string, created_at timestamp_ntz"

# Names, order and types of the columns of every table.
SNAPSHOT_FIELDS = {
    "client_signup": (
        "client_id", "signup_date", "country", "email", "kyc_status", "account_type",
        "referral_source", "signup_platform", "promo_code", "assigned_manager",
    ),
    "client_profile": (
        "client_id", "full_name", "date_of_birth", "nationality", "risk_category",
        "account_balance_usd", "account_status", "currency", "last_login_date", "preferred_language",
    ),
    "client_deposit": (
        "deposit_id", "client_id", "deposit_date", "amount_usd", "payment_method",
        "currency_original", "exchange_rate", "status", "processing_days", "fee_usd",
    ),
    "client_trades": (
        "trade_id", "client_id", "trade_date", "instrument", "direction", "volume_lots",
        "open_price", "close_price", "pnl_usd", "trade_status",
    ),
}
SNAPSHOT_KEYS = {
    "client_signup": "client_id", "client_profile": "client_id", "client_deposit": "deposit_id", "client_trades": "trade_id",
}
SNAPSHOT_HASHES = {
    "client_signup": ("client_id", "signup_date", "email", "kyc_status"),
    "client_profile": ("client_id", "risk_category", "account_balance_usd", "account_status"),
    "client_deposit": ("deposit_id", "client_id", "amount_usd", "status"),
    "client_trades": ("trade_id", "client_id", "pnl_usd", "trade_status"),
}
#: types of snapshot fields that are not text
TYPES = {
    "signup_date": "date", "date_of_birth": "date", "last_login_date": "date", "deposit_date": "date", "trade_date": "date",
    "account_balance_usd": "decimal(18,2)", "amount_usd": "decimal(18,2)", "fee_usd": "decimal(18,2)", "pnl_usd": "decimal(18,2)",
    "exchange_rate": "decimal(18,4)", "volume_lots": "decimal(18,4)", "open_price": "decimal(18,4)", "close_price": "decimal(18,4)",
    "processing_days": "int",
}


def _columns(fields: tuple[str, ...], typed: bool) -> str:
    return ", ".join(f"{f} {TYPES.get(f, 'string') if typed else 'string'}" for f in fields)


TABLES: dict[str, str] = {
    # control
    "ingestion_file_manifest": "file_hash string, file_name string, source string, status string, row_count_landed long, "
    "row_count_staged long, row_count_quarantined long, arrived_at timestamp_ntz, processed_at timestamp_ntz, batch_id string",
    "cdc_processing_ledger": "lsn long, payload_hash string, batch_id string, client_id string, op string, outcome string, "
    "applied_at timestamp_ntz",
    "quarantine": "quarantine_id string, source_system string, source_identifier string, record_id string, batch_id string, "
    "raw_payload string, reason_code string, severity string, quarantined_at timestamp_ntz, is_resolved boolean, retry_eligible boolean",
    # raw and staged snapshots
    **{
        f"raw_{name}": f"{_columns(fields, False)}, raw_json string, {_LINEAGE}"
        for name, fields in SNAPSHOT_FIELDS.items()
    },
    **{
        f"stg_{name}": f"{_columns(fields, True)}, row_hash string, batch_id string, staged_at timestamp_ntz"
        for name, fields in SNAPSHOT_FIELDS.items()
    },
    # vendor feed and change feed
    "raw_vendor_deposit": f"{_columns(SNAPSHOT_FIELDS['client_deposit'], False)}, raw_payload string, row_num long, {_LINEAGE}",
    "stg_vendor_deposit": f"{_columns(SNAPSHOT_FIELDS['client_deposit'], True)}, canonical_row_hash string, file_name string, "
    "batch_id string, staged_at timestamp_ntz",
    "raw_cdc_events": "lsn long, commit_ts timestamp_ntz, op string, client_id string, before map<string,string>, "
    "after map<string,string>, raw_json string, payload_hash string, file_name string, batch_id string, "
    "arrival_sequence long, landed_at timestamp_ntz",
    # curated
    "dim_client": "client_sk long, client_id string, full_name string, date_of_birth date, email string, country string, "
    "nationality string, account_type string, kyc_status string, referral_source string, signup_platform string, "
    "promo_code string, assigned_manager string, preferred_language string, risk_category string, account_status string, "
    "valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean, is_deleted boolean, deleted_at timestamp_ntz, "
    f"is_inferred boolean, opened_by_lsn long, {_AUDIT}",
    "dim_date": "date_key date, year int, quarter int, month int, day int, day_of_week int, is_weekend boolean",
    "dim_instrument": "instrument_sk long, instrument_name string, asset_class string",
    "fact_deposit": "source_system string, deposit_id string, client_sk long, client_id string, deposit_date date, "
    "amount_usd decimal(18,2), payment_method string, currency_original string, exchange_rate decimal(18,4), status string, "
    f"processing_days int, fee_usd decimal(18,2), reconciliation_status string, file_name string, {_AUDIT}",
    "fact_trade": "trade_id string, client_sk long, client_id string, trade_date date, instrument_sk long, instrument string, "
    "direction string, volume_lots decimal(18,4), open_price decimal(18,4), close_price decimal(18,4), pnl_usd decimal(18,2), "
    f"trade_status string, file_name string, {_AUDIT}",
    "fact_client_balance_history": f"lsn long, client_id string, observed_at timestamp_ntz, balance_usd decimal(18,2), {_AUDIT}",
}

#: business columns by which large tables are clustered on disk, so that date and key filters skip files
CLUSTERING = {
    "fact_deposit": ("deposit_date", "client_id", "deposit_id"),
    "fact_trade": ("trade_date", "client_id", "trade_id"),
    "fact_client_balance_history": ("observed_at", "lsn"),
    "raw_cdc_events": ("commit_ts", "lsn"),
}

#: tables cut into buckets by a hash of the named column, so that a batch rewrites only the buckets it touches
BUCKETED = {
    "dim_client": "client_id", "fact_client_balance_history": "client_id", "cdc_processing_ledger": "client_id",
    "raw_cdc_events": "client_id", "quarantine": "quarantine_id", "ingestion_file_manifest": "file_hash",
}
#: facts with a folder per month of the named date, as column ``period``: a filter on months, also one that only a join
#: brings in, leaves the other folders unread
PERIODS = {"fact_deposit": "deposit_date", "fact_trade": "trade_date"}
#: columns whose highest value the writes keep count of
COUNTERS = {"dim_client": ("client_sk",)}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table] + (", period string" if table in PERIODS else ""))


def period_of(day: Column | str) -> Column:
    """The month of a date, as the folders of facts name it."""
    return F.date_format(day, "yyyy-MM")


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table``: missing ones null, others dropped.

    Also how a file written before a column was added is read under the newer schema.
    """
    want = df.sparkSession.createDataFrame([], TABLES[table]).schema
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    )
