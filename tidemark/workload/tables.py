"""The warehouse's tables as they are read off the benchmark tables.

Each stand-in exists twice: as a DataFrame for the Spark side and as a common table expression for the SQL
side. Customers are clients, orders are deposits, line items are trades, events are the change feed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import history
from ..session import written


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A benchmark table. Its schema is looked up in the file once per session, not once per use."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def with_(names: str, body: str) -> str:
    """``body`` behind the named common table expressions, in order."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split()) + "\n" + body


CTES: dict[str, str] = {}

# --- clients ---------------------------------------------------------------------------------------------

CTES["clients"] = """
SELECT CAST(c_custkey AS VARCHAR) AS client_id, c_custkey + 1 AS client_sk, c_name AS full_name,
       lower(replace(c_name, '#', '.')) || '@example.com' AS email,
       DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INTEGER) AS date_of_birth,
       n_name AS country, n_name AS nationality, c_mktsegment AS account_type,
       CASE WHEN c_acctbal < 0 THEN 'pending' ELSE 'approved' END AS kyc_status,
       CASE WHEN c_acctbal < 0 THEN 'high' WHEN c_acctbal < 5000 THEN 'medium' ELSE 'low' END AS risk_category,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'suspended' ELSE 'active' END AS account_status,
       CAST(c_acctbal AS DECIMAL(18,2)) AS account_balance_usd
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _people(customers: DataFrame, *others: str) -> DataFrame:
    """Client attributes that a customer row gives by itself, and the named other columns."""
    balance = F.col("c_acctbal")
    return customers.select(
        F.col("c_custkey").cast("string").alias("client_id"),
        (F.col("c_custkey") + 1).alias("client_sk"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 37 % 18000).cast("int")).alias("date_of_birth"),
        F.col("c_mktsegment").alias("account_type"),
        F.when(balance < 0, "pending").otherwise("approved").alias("kyc_status"),
        F.when(balance < 0, "high").when(balance < 5000, "medium").otherwise("low").alias("risk_category"),
        F.when(F.col("c_mktsegment") == "BUILDING", "suspended").otherwise("active").alias("account_status"),
        balance.cast("decimal(18,2)").alias("account_balance_usd"),
        *others,
    )


def clients(spark: SparkSession, folder: str) -> DataFrame:
    """Signup and profile of every customer."""
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    people = _people(table(spark, folder, "customer"), "c_nationkey").join(nation, "c_nationkey").drop("c_nationkey")
    return people.withColumn("nationality", F.col("country"))


# The dimension before any event: MACHINERY customers are not in it, FURNITURE customers in debt left in 2023.
CTES["base"] = """
SELECT client_sk, client_id, risk_category, account_status,
       CASE WHEN gone THEN TIMESTAMP '2023-01-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS valid_from,
       CASE WHEN gone THEN TIMESTAMP '2023-12-31 00:00:00' END AS valid_to,
       NOT gone AS is_current, gone AS is_deleted,
       CASE WHEN gone THEN TIMESTAMP '2023-12-31 00:00:00' END AS deleted_at
FROM (SELECT *, account_type = 'FURNITURE' AND account_balance_usd < 0 AS gone
      FROM clients WHERE account_type <> 'MACHINERY') c"""


def base_dimension(spark: SparkSession, folder: str) -> DataFrame:
    people = _people(table(spark, folder, "customer")).where("account_type <> 'MACHINERY'")
    gone = (F.col("account_type") == "FURNITURE") & (F.col("account_balance_usd") < 0)
    end = F.when(gone, F.lit("2023-12-31 00:00:00")).cast("timestamp_ntz")
    return people.select(
        "client_sk", "client_id", "risk_category", "account_status",
        F.when(gone, "2023-01-01 00:00:00").otherwise("2024-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"),
        end.alias("valid_to"), (~gone).alias("is_current"), gone.alias("is_deleted"), end.alias("deleted_at"),
    )


# --- change feed -----------------------------------------------------------------------------------------

CTES["feed"] = """
SELECT event_id AS lsn, ts AS commit_ts, CAST(user_id AS VARCHAR) AS client_id, event_type, value, k,
       CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type <> 'error' THEN 'update'
            WHEN k < 3 THEN 'delete' WHEN k < 10 THEN 'truncate' ELSE 'update' END AS op,
       event_type = 'click' OR (event_type = 'signup' AND k >= 50) AS has_risk,
       CASE WHEN event_type = 'signup' THEN 'low' WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS risk,
       event_type = 'view' AS has_status,
       CASE WHEN k < 50 THEN 'active' WHEN k < 90 THEN 'under_review' END AS status,
       event_type = 'purchase' AS has_balance,
       CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS balance_after,
       CASE WHEN event_type = 'purchase' THEN
         CASE WHEN k < 30 THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(CAST(value AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2)) END
       END AS balance_before
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e"""


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Change events with partial images, one per row of ``events``; a missing image is null."""
    events = table(spark, folder, "events").withColumns({
        "k": F.get_json_object("props", "$.k").cast("int"),
        "amount": F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")),
    })
    k, kind, value, amount = F.col("k"), F.col("event_type"), F.col("value"), F.col("amount")
    risk = F.when(value < 5, "low").when(value < 20, "medium").otherwise("high")
    status = F.when(k < 50, "active").when(k < 90, "under_review")

    def image(key: str, what: F.Column) -> F.Column:
        return F.create_map(F.lit(key), what.cast("string"))

    nothing = F.create_map().cast("map<string,string>")
    op = (
        F.when(kind == "signup", "insert").when(kind != "error", "update")
        .when(k < 3, "delete").when(k < 10, "truncate").otherwise("update")
    )
    after = (
        F.when(kind == "click", image(history.RISK, risk))
        .when(kind == "view", image(history.STATUS, status))
        .when(kind == "purchase", image(history.BALANCE, amount))
        .when((kind == "signup") & (k >= 50), image(history.RISK, F.lit("low")))
        .when((kind == "signup") | (k >= 10), nothing)
    )
    before = F.when(
        kind == "purchase", image(history.BALANCE, F.when(k < 30, amount).otherwise((amount + 1).cast("decimal(18,2)")))
    ).when(op == "update", nothing)
    return events.select(
        F.col("event_id").alias("lsn"), F.col("ts").alias("commit_ts"), op.alias("op"),
        F.col("user_id").cast("string").alias("client_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("payload_hash"),
        before.alias("before"), after.alias("after"),
    )


# The history rules once more, as one window per client: risk and status are carried as text in which a
# present null ('n') differs from an absent key (NULL).
CTES["lives"] = """
SELECT f.client_id, CASE WHEN b.client_id IS NOT NULL THEN -1 ELSE f.first_insert END AS birth,
       b.is_current, 'v' || b.risk_category AS risk0, 'v' || b.account_status AS status0
FROM (SELECT client_id, min(lsn) FILTER (WHERE op = 'insert') AS first_insert FROM feed GROUP BY client_id) f
LEFT JOIN base b ON f.client_id = b.client_id"""
CTES["deaths"] = """
SELECT f.client_id, min(f.lsn) AS death, min(f.commit_ts) AS death_ts
FROM feed f JOIN lives l ON f.client_id = l.client_id
WHERE f.op = 'delete' AND f.lsn > l.birth AND l.is_current IS DISTINCT FROM FALSE GROUP BY f.client_id"""
CTES["live"] = """
SELECT f.*, f.op = 'insert' AS is_birth, l.risk0, l.status0, d.death_ts,
       CASE WHEN f.op = 'insert' THEN CASE WHEN has_risk THEN 'v' || risk ELSE 'vmedium' END
            WHEN has_risk THEN coalesce('v' || risk, 'n') END AS rset,
       CASE WHEN f.op = 'insert' THEN 'vactive' WHEN has_status THEN coalesce('v' || status, 'n') END AS sset
FROM feed f JOIN lives l ON f.client_id = l.client_id LEFT JOIN deaths d ON f.client_id = d.client_id
WHERE (f.op = 'insert' AND f.lsn = l.birth)
   OR (f.op = 'update' AND f.lsn > l.birth AND f.lsn < coalesce(d.death, 9223372036854775807)
       AND l.is_current IS DISTINCT FROM FALSE)"""
CTES["states"] = """
SELECT *, coalesce(last_value(rset IGNORE NULLS) OVER upto, risk0) AS r1, coalesce(last_value(rset IGNORE NULLS) OVER prior, risk0) AS r0,
       coalesce(last_value(sset IGNORE NULLS) OVER upto, status0) AS s1, coalesce(last_value(sset IGNORE NULLS) OVER prior, status0) AS s0
FROM live
WINDOW upto AS (PARTITION BY client_id ORDER BY lsn ROWS UNBOUNDED PRECEDING),
       prior AS (PARTITION BY client_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
CTES["starts"] = """
SELECT client_id, lsn AS opened_by_lsn, CASE WHEN r1 <> 'n' THEN substr(r1, 2) END AS risk_category,
       CASE WHEN s1 <> 'n' THEN substr(s1, 2) END AS account_status, commit_ts AS valid_from,
       coalesce(next_ts, death_ts) AS valid_to, coalesce(next_ts, death_ts) IS NULL AS is_current,
       next_ts IS NULL AND death_ts IS NOT NULL AS is_deleted,
       CASE WHEN next_ts IS NULL THEN death_ts END AS deleted_at
FROM (SELECT *, lead(commit_ts) OVER (PARTITION BY client_id ORDER BY lsn) AS next_ts
      FROM states WHERE is_birth OR r1 <> r0 OR s1 <> s0) v"""
CTES["closed"] = """
SELECT b.client_sk, b.client_id, CAST(NULL AS BIGINT) AS opened_by_lsn, b.risk_category, b.account_status, b.valid_from,
       CASE WHEN b.is_current THEN coalesce(s.first_ts, d.death_ts) ELSE b.valid_to END AS valid_to,
       b.is_current AND s.first_ts IS NULL AND d.death_ts IS NULL AS is_current,
       b.is_deleted OR (b.is_current AND s.first_ts IS NULL AND d.death_ts IS NOT NULL) AS is_deleted,
       CASE WHEN b.is_current AND s.first_ts IS NULL THEN d.death_ts ELSE b.deleted_at END AS deleted_at
FROM base b
LEFT JOIN (SELECT client_id, min(valid_from) AS first_ts FROM starts GROUP BY client_id) s ON b.client_id = s.client_id
LEFT JOIN deaths d ON b.client_id = d.client_id"""
CTES["dim"] = """
SELECT * FROM closed UNION ALL
SELECT 1000000000000 + opened_by_lsn AS client_sk, client_id, opened_by_lsn, risk_category, account_status,
       valid_from, valid_to, is_current, is_deleted, deleted_at FROM starts"""
CTES["balances"] = """
SELECT lsn, client_id, commit_ts AS observed_at, balance_after AS balance_usd FROM live
WHERE op = 'update' AND has_balance AND balance_before IS DISTINCT FROM balance_after"""

# The views of each client's first days, two to eleven of them, arrive after all else; where a client's history begins again.
_IS_LATE = "(event_type = 'view' AND commit_ts < TIMESTAMP '2024-01-03 00:00:00' + to_days(CAST(CAST(f.client_id AS BIGINT) % 10 AS INTEGER)))"
CTES["late"] = f"SELECT client_id, min(lsn) AS from_lsn FROM feed f WHERE {_IS_LATE} GROUP BY client_id"
CTES["overtaken"] = f"""
SELECT DISTINCT l.client_id, from_lsn FROM late l JOIN feed f ON f.client_id = l.client_id WHERE NOT {_IS_LATE} AND f.lsn > from_lsn"""
CTES["boundaries"] = """
SELECT f.client_id, min(commit_ts) AS from_ts FROM feed f JOIN overtaken o ON f.client_id = o.client_id WHERE f.lsn >= from_lsn GROUP BY f.client_id"""

HISTORY = "clients base feed lives deaths live states starts"
FULL = HISTORY + " closed dim"

VERSION_COLUMNS = (
    "client_sk", "client_id", "opened_by_lsn", "risk_category", "account_status",
    "valid_from", "valid_to", "is_current", "is_deleted", "deleted_at",
)


def keyed_starts(starts: DataFrame) -> DataFrame:
    """New versions with a surrogate key in LSN order that needs no numbering pass."""
    return starts.withColumn("client_sk", F.lit(1_000_000_000_000).cast("long") + F.col("opened_by_lsn")).select(*VERSION_COLUMNS)


def dimension_after(base: DataFrame, applied: history.Applied) -> DataFrame:
    """Closed base versions and new versions together."""
    old = base if "opened_by_lsn" in base.columns else base.withColumn("opened_by_lsn", F.lit(None).cast("long"))
    return history.close_current(old, applied.closures).select(*VERSION_COLUMNS).unionByName(keyed_starts(applied.starts))


def full_dimension(spark: SparkSession, folder: str) -> tuple[DataFrame, history.Applied]:
    """The dimension after the whole feed. Typed events and block summaries are written once and shared."""
    base = base_dimension(spark, folder)
    applied = history.apply_events(base, feed(spark, folder), hold=written)
    return dimension_after(base, applied), applied


# --- deposits and trades ---------------------------------------------------------------------------------

CTES["deposits"] = """
SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'vendor' ELSE 'warehouse' END AS source_system,
       CAST(o_orderkey AS VARCHAR) AS deposit_id, CAST(o_custkey AS VARCHAR) AS client_id,
       CAST(o_orderdate AS DATE) AS deposit_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_usd,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS fee_usd,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
       o_orderpriority AS payment_method, 'USD' AS currency_original
FROM orders"""


def deposits(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "vendor").otherwise("warehouse").alias("source_system"),
        F.col("o_orderkey").cast("string").alias("deposit_id"), F.col("o_custkey").cast("string").alias("client_id"),
        F.col("o_orderdate").cast("date").alias("deposit_date"), amount.alias("amount_usd"),
        (amount * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("fee_usd"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.col("o_orderpriority").alias("payment_method"), F.lit("USD").alias("currency_original"),
    )


_PNL = """CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(0.5 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)) * 10) AS DECIMAL(18,2)) AS pnl_usd"""
CTES["client_trades"] = f"SELECT CAST(o_custkey AS VARCHAR) AS client_id, {_PNL} FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
CTES["instrument_trades"] = f"SELECT p_brand AS instrument, CAST(l_quantity AS DECIMAL(18,4)) AS volume_lots, {_PNL} FROM lineitem JOIN part ON l_partkey = p_partkey"


def _pnl() -> F.Column:
    share = F.lit("0.5").cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)") * F.lit(10)
    return (F.col("l_extendedprice").cast("decimal(18,2)") * share).cast("decimal(18,2)").alias("pnl_usd")


def client_trades(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("client_id")
    )
    return table(spark, folder, "lineitem").join(owners, "l_orderkey").select("client_id", _pnl())


def instrument_trades(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("instrument"))
    return table(spark, folder, "lineitem").join(parts, "l_partkey").select(
        "instrument", F.col("l_quantity").cast("decimal(18,4)").alias("volume_lots"), _pnl()
    )


# Vendor rows as delivered, all text. Failed orders come again unchanged, urgent pending ones with another amount.
CTES["delivered"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS deposit_id, CAST(o_custkey AS VARCHAR) AS client_id,
       CASE WHEN o_totalprice > 480000 THEN 'not-a-date' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS deposit_date,
       CASE WHEN o_totalprice < 10000 THEN 'n/a' WHEN o_totalprice < 20000 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
            ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) + bump AS DECIMAL(18,2)) AS VARCHAR) END AS amount_usd,
       o_orderpriority AS payment_method, 'USD' AS currency_original, '1.0' AS exchange_rate,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
       '2' AS processing_days, '0.50' AS fee_usd,
       'deposits_vendor_' || strftime(o_orderdate, '%Y%m') || suffix AS file_name, o_orderkey AS row_num
FROM (SELECT *, 0 AS bump, '_a.csv' AS suffix FROM orders
      UNION ALL SELECT *, 0, '_b.csv' FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT *, 1, '_c.csv' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') d"""


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")

    def copy(df: DataFrame, bump: int, suffix: str) -> DataFrame:
        return df.withColumn("bump", F.lit(bump)).withColumn("suffix", F.lit(suffix))

    rows = copy(orders, 0, "_a.csv").unionByName(copy(orders.where("o_orderstatus = 'P'"), 0, "_b.csv")).unionByName(
        copy(orders.where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"), 1, "_c.csv")
    )
    price = F.col("o_totalprice")
    amount = price.cast("decimal(18,2)")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("deposit_id"), F.col("o_custkey").cast("string").alias("client_id"),
        F.when(price > 480000, "not-a-date").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("deposit_date"),
        F.when(price < 10000, "n/a").when(price < 20000, F.concat(F.lit("-"), amount.cast("string")))
        .otherwise((amount + F.col("bump")).cast("decimal(18,2)").cast("string")).alias("amount_usd"),
        F.col("o_orderpriority").alias("payment_method"), F.lit("USD").alias("currency_original"), F.lit("1.0").alias("exchange_rate"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.lit("2").alias("processing_days"), F.lit("0.50").alias("fee_usd"),
        F.concat(F.lit("deposits_vendor_"), F.date_format("o_orderdate", "yyyyMM"), F.col("suffix")).alias("file_name"),
        F.col("o_orderkey").alias("row_num"),
    )


# The vendor rules once more: the first failing rule decides, then the first valid row of a deposit wins.
CTES["ruled"] = """
SELECT d.*, TRY_CAST(amount_usd AS DECIMAL(18,2)) AS t_amount, TRY_CAST(deposit_date AS DATE) AS t_date,
       CASE WHEN TRY_CAST(amount_usd AS DECIMAL(18,2)) IS NULL THEN 'MALFORMED_NUMERIC'
            WHEN TRY_CAST(deposit_date AS DATE) IS NULL THEN 'MALFORMED_DATE'
            WHEN TRY_CAST(amount_usd AS DECIMAL(18,2)) < 0 THEN 'NEGATIVE_AMOUNT'
            WHEN b.client_id IS NULL THEN 'ORPHAN_CLIENT' END AS reason
FROM delivered d LEFT JOIN (SELECT client_id FROM base WHERE is_current) b ON d.client_id = b.client_id"""
CTES["judged"] = """
SELECT r.*, CASE WHEN reason IS NOT NULL THEN reason WHEN place = 1 THEN 'STAGED'
                 WHEN t_amount = won_amount THEN 'DUPLICATE' ELSE 'DUPLICATE_CONFLICT' END AS disposition
FROM (SELECT *, row_number() OVER w AS place, first_value(t_amount) OVER w AS won_amount FROM ruled
      WINDOW w AS (PARTITION BY deposit_id, reason IS NULL ORDER BY file_name, row_num)) r"""
VENDOR = "clients base delivered ruled judged"
