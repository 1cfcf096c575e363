"""Sources, sinks and control state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing
from ..operators import controls, dims, keyed, numbering
from ..plans import analytics
from ..plans.publish import Warehouse
from ..schemas import SNAPSHOT_FIELDS, TYPES
from ..session import scratch_path
from ..sources import changes, files, snapshots, vendor
from . import tables as t
from .registry import query



def _paths(spark: SparkSession, folder: str, pattern: str = "part-*") -> list[str]:
    """Files below a folder that a query has just written."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return [r.path for r in listing.load(folder).select("path").collect()]


# --- sources ---------------------------------------------------------------------------------------------


@query("land_snapshot", t.with_("deposits", """
SELECT deposit_id, client_id, deposit_date, amount_usd, payment_method, currency_original, CAST(1.5 AS DECIMAL(18,4)) AS exchange_rate,
       status, 3 AS processing_days, fee_usd FROM deposits"""))
def land_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Deposits written as JSON arrays of up to a hundred objects per line, and landed one by one."""
    path, fields = scratch_path(spark, "snapshot"), SNAPSHOT_FIELDS["client_deposit"]
    rows = t.deposits(spark, folder).withColumns({"exchange_rate": F.lit(1.5), "processing_days": F.lit(3)})
    hundred = F.expr("cast(deposit_id as bigint) div 100")
    rows.groupBy(hundred.alias("h")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("value")).select("value").write.text(path)
    landed = snapshots.read_snapshot(spark, [path], fields)
    return landed.select(*[F.col(f).cast(TYPES.get(f, "string")).alias(f) for f in fields])


@query("land_vendor_csv", t.with_("delivered", """
SELECT deposit_id, client_id, deposit_date, amount_usd, payment_method, status, processing_days, fee_usd, fee_usd AS delivered_fee FROM delivered"""))
def land_vendor_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor rows written as CSV files with two header layouts, and landed under one."""
    landed = _land_vendor(spark, folder)
    return landed.select(
        "deposit_id", "client_id", "deposit_date", "amount_usd", "payment_method", "status", "processing_days", "fee_usd",
        F.get_json_object("raw_payload", "$.fee_usd").alias("delivered_fee"),
    )


def _land_vendor(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "vendor")
    rows = t.delivered(spark, folder).select(*vendor.EXPECTED, "file_name")
    first = F.col("file_name").endswith("_a.csv")
    rows.where(first).drop("file_name").write.option("header", True).csv(f"{path}/plain")
    rows.where(~first).drop("file_name").withColumnRenamed("payment_method", "method").write.option("header", True).csv(f"{path}/alias")
    return vendor.read_vendor(spark, [p for part in ("plain", "alias") for p in _paths(spark, f"{path}/{part}")])[0]


@query("schema_alias", t.with_("delivered", """
SELECT deposit_id, payment_method, CASE WHEN file_name NOT LIKE '%_a.csv' THEN payment_method END AS delivered_as_alias FROM delivered"""))
def schema_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Rows delivered under either name of the method column, landed under one; the payload keeps the delivered name."""
    return _land_vendor(spark, folder).select(
        "deposit_id", "payment_method", F.get_json_object("raw_payload", "$.method").alias("delivered_as_alias"))


def _keys_by_year(spark: SparkSession, folder: str, path: str) -> None:
    orders = t.table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey")
    orders.repartition("year").sortWithinPartitions("year", "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("value"), "year"
    ).write.partitionBy("year").text(path)


def _write_feed(spark: SparkSession, folder: str, label: str) -> str:
    path = scratch_path(spark, label)
    events = t.feed(spark, folder)
    document = F.struct(
        "lsn", F.concat(F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("commit_ts"),
        "op", "client_id", "before", "after",
    )
    events.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


@query("land_cdc_jsonl", t.with_("feed", """
SELECT lsn, commit_ts, op, client_id, balance_before, balance_after, has_balance FROM feed"""))
def land_cdc_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """The change feed written as JSON lines and read back: stamps in UTC, images as maps."""
    events = changes.read_changes(spark, [_write_feed(spark, folder, "feed")])
    balance = "account_balance_usd"
    return events.select(
        "lsn", "commit_ts", "op", "client_id",
        F.try_element_at("before", F.lit(balance)).cast("decimal(18,2)").alias("balance_before"),
        F.try_element_at("after", F.lit(balance)).cast("decimal(18,2)").alias("balance_after"),
        F.coalesce(F.map_contains_key("after", F.lit(balance)), F.lit(False)).alias("has_balance"),
    )


def _piece(at: int) -> str:
    return f"sum(CAST(CAST('0x' || substr(d, {at}, 15) AS BIGINT) AS HUGEINT))"


@query("discover_files", f"""
WITH ordered AS (
    SELECT year(o_orderdate) AS y, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS n FROM orders
), hashed AS (SELECT y, value, sha256(n || ':' || value) AS d FROM ordered),
sums AS (SELECT y, count(*) AS n, sum(length(value) + 1) AS bytes, {_piece(1)} AS a, {_piece(16)} AS b, {_piece(31)} AS c, {_piece(46)} AS e FROM hashed GROUP BY y)
SELECT CAST(y AS VARCHAR) AS delivery, CAST(bytes AS BIGINT) AS length, sha256(n || '|' || a || '|' || b || '|' || c || '|' || e || '|' || bytes) AS file_hash FROM sums""")
def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file of order keys per year, found by pattern and fingerprinted."""
    path = scratch_path(spark, "discover")
    _keys_by_year(spark, folder, path)
    found = files.discover(spark, path, "part-*", recursive=True)
    return found.select(F.regexp_extract("file_path", r"year=(\d+)", 1).alias("delivery"), "length", "file_hash")


@query("missing_inputs", """
SELECT 'profile_' || n_name || '.json' AS file_name FROM nation
WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def missing_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """One profile file is expected per nation; nations with a wealthy customer delivered theirs."""
    def named(df: DataFrame) -> DataFrame:
        return df.select(F.concat(F.lit("profile_"), F.col("n_name"), F.lit(".json")).alias("file_name"))

    nation = t.table(spark, folder, "nation")
    rich = t.table(spark, folder, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return controls.missing_inputs(named(nation), named(nation.join(rich, "n_nationkey")))


@query("file_row_numbers", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS delivery, o_orderkey,
       row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS row_num
FROM orders""")
def file_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """One text file per year, its lines numbered in file order."""
    path = scratch_path(spark, "numbered")
    _keys_by_year(spark, folder, path)
    lines = files.lines(spark, _paths(spark, path))
    return numbering.number_file_rows(lines).select(
        F.regexp_extract("file_path", r"year=(\d+)", 1).alias("delivery"), F.col("value").cast("long").alias("o_orderkey"), "row_num"
    )


@query("cdc_empty_input", "SELECT count(*) AS events_seen, 0 AS applied, 0 AS reconciled, 0 AS quarantined, 0 AS skipped FROM events WHERE event_type = 'heartbeat'")
def cdc_empty_input(spark: SparkSession, folder: str) -> DataFrame:
    """A feed without events of interest, delivered as files without a line, gives zero counters and no error."""
    path = scratch_path(spark, "quiet")
    t.table(spark, folder, "events").where("event_type = 'heartbeat'").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    quiet = changes.read_changes(spark, _paths(spark, path))
    counters = controls.feed_counters(quiet, quiet.select("lsn", F.lit("APPLIED").alias("outcome")))
    return counters.select("events_seen", *[F.col(c).cast("int").alias(c) for c in ("applied", "reconciled", "quarantined", "skipped")])


# --- sinks -----------------------------------------------------------------------------------------------


@query("raw_append_idempotent", t.with_("delivered", """
SELECT file_name, row_num, deposit_id, amount_usd FROM delivered WHERE file_name NOT LIKE '%a.csv'"""))
def raw_append_idempotent(spark: SparkSession, folder: str) -> DataFrame:
    """What a second landing of all files appends when the ``_a`` files are already there."""
    rows = t.delivered(spark, folder).select("file_name", "row_num", "deposit_id", "amount_usd")
    return keyed.insert_if_absent(rows.where(F.col("file_name").endswith("a.csv")), rows, ["file_name", "row_num"], ["deposit_id"])


@query("insert_if_absent", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place
  FROM lineitem) f
WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = f.l_orderkey AND o.o_orderstatus = 'F' AND f.l_linenumber = 1)""")
def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """First writer of every line key, unless the target holds the key: lines 1 of finished orders."""
    target = t.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber")
    )
    lines = t.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return keyed.insert_if_absent(
        target, lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    ).drop("l_extendedprice")


@query("upsert_manifest", """
SELECT coalesce(o.file_hash, n.file_hash) AS file_hash,
       coalesce(n.status, o.status) AS status, coalesce(o.rows, n.rows) AS rows
FROM (SELECT sha256(url) AS file_hash, 'FAILED' AS status, length(html) AS rows FROM pages WHERE length(html) < 4000) o
FULL OUTER JOIN (SELECT sha256(url) AS file_hash, 'SUCCESS' AS status, 2 * length(html) AS rows FROM pages WHERE length(html) > 2000) n
ON o.file_hash = n.file_hash""")
def upsert_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Status is updated on a match, counts keep their first value, new files are added."""
    size = F.length("html")
    pages = t.table(spark, folder, "pages").select("url", size.cast("long").alias("size"))
    key = hashing.content_digest("url").alias("file_hash")
    old = pages.where("size < 4000").select(key, F.lit("FAILED").alias("status"), F.col("size").alias("rows"))
    new = pages.where("size > 2000").select(key, F.lit("SUCCESS").alias("status"), (F.col("size") * 2).alias("rows"))
    return keyed.upsert(old, new, ["file_hash"], ["status"])


@query("publish_snapshot", t.with_("deposits", "SELECT source_system, deposit_id, client_id, deposit_date, amount_usd, status FROM deposits"))
def publish_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Two published batches and one that fails: readers see the first two, whole, and nothing of the third."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    rows = t.deposits(spark, folder)
    for source in ("warehouse", "vendor"):
        batch = warehouse.begin(f"batch-{source}")
        batch.append("fact_deposit", rows.where(F.col("source_system") == source))
        batch.publish()
    failing = warehouse.begin("batch-failing")
    failing.append("fact_deposit", rows)  # written, never published
    return warehouse.read("fact_deposit").select("source_system", "deposit_id", "client_id", "deposit_date", "amount_usd", "status")


@query("additive_schema", """
SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE props END AS props FROM events""")
def additive_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written before a column existed, read together with rows written after."""
    events = t.table(spark, folder, "events")
    early = events.where("event_type in ('click', 'view')").select("event_id", "event_type")
    late = events.where("event_type not in ('click', 'view')").select("event_id", "event_type", "props")
    return late.unionByName(early, allowMissingColumns=True)


# --- control state ---------------------------------------------------------------------------------------


@query("content_hash", "SELECT page_id, sha256(html) AS file_hash FROM pages")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "pages").select("page_id", hashing.content_digest("html").alias("file_hash"))


@query("manifest_skip", """
SELECT doc_id, sha256(text) AS file_hash FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE n_chars < 500)""")
def manifest_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose content is not among the short ones, which are processed already."""
    found = t.table(spark, folder, "documents").select("doc_id", "n_chars", hashing.content_digest("text").alias("file_hash"))
    manifest = found.select("file_hash", F.when(F.col("n_chars") < 500, "SUCCESS").otherwise("FAILED").alias("status"))
    return controls.unprocessed(found, manifest).select("doc_id", "file_hash")


@query("changed_redelivery", """
SELECT source AS file_name, count(*) AS deliveries FROM documents GROUP BY source HAVING count(DISTINCT sha256(text)) > 1""")
def changed_redelivery(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that delivered more than one content under one name."""
    return controls.changed_redeliveries(
        t.table(spark, folder, "documents").select(F.col("source").alias("file_name"), hashing.content_digest("text").alias("file_hash"))
    )


@query("ledger_skip", t.with_("feed", """
SELECT lsn, op FROM feed WHERE commit_ts >= TIMESTAMP '2024-01-11 00:00:00'"""))
def ledger_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Events left to apply when all are delivered twice and those of the first ten days are in the ledger."""
    events = t.feed(spark, folder).select("lsn", "op", "commit_ts")
    ledger = events.where("commit_ts < timestamp_ntz'2024-01-11 00:00:00'")
    return controls.unapplied(events.unionByName(events), ledger).select("lsn", "op")


@query("dim_date", """
SELECT CAST(d AS DATE) AS date_key, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
       CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, CAST(isodow(d) AS INTEGER) AS day_of_week,
       isodow(d) IN (6, 7) AS is_weekend
FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS d FROM orders) s""")
def dim_date(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar over all order dates."""
    span = t.table(spark, folder, "orders").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"))
    return dims.calendar(spark, F.col("low"), F.col("high"), span)


@query("dim_instrument", """
SELECT row_number() OVER (ORDER BY instrument_name) AS instrument_sk, instrument_name, asset_class
FROM (SELECT p_brand AS instrument_name, min(p_type) AS asset_class FROM part GROUP BY p_brand) b""")
def dim_instrument(spark: SparkSession, folder: str) -> DataFrame:
    """One numbered instrument per brand."""
    brands = t.table(spark, folder, "part").groupBy(F.col("p_brand").alias("instrument_name")).agg(F.min("p_type").alias("asset_class"))
    return numbering.dense_number(brands, ["instrument_name"], "instrument_sk").select("instrument_sk", "instrument_name", "asset_class")


@query("lineage", t.with_("delivered", """
SELECT file_name AS source_file, 'b1' AS batch_id, 'fact_deposit' AS target_table, deposit_id AS target_key FROM delivered
UNION ALL SELECT 'events', 'b1', 'cdc_processing_ledger', CAST(event_id AS VARCHAR) FROM events"""))
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """From which file and batch each row of two tables came."""
    batch = F.lit("b1")
    deposits = t.delivered(spark, folder).withColumn("batch_id", batch)
    events = t.table(spark, folder, "events").select("event_id", F.lit("events").alias("file_name"), batch.alias("batch_id"))
    return controls.lineage(deposits, "fact_deposit", F.col("deposit_id")).unionByName(
        controls.lineage(events, "cdc_processing_ledger", F.col("event_id").cast("string"))
    )


@query("rescan_worklist", """
SELECT CAST(o_orderkey AS VARCHAR) AS file_name,
       CASE WHEN o_orderdate > TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 7 DAY THEN 'hash' ELSE 'overlooked' END AS action
FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 7 DAY OR o_orderstatus = 'P'""")
def rescan_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a file that arrived on its date; all but partial ones are in the manifest, and files up to 1996 have been
    seen. Those of the last seven days are hashed again, older ones that nobody knows are reported."""
    orders = t.table(spark, folder, "orders")
    named = orders.select(F.col("o_orderkey").cast("string").alias("file_name"), F.col("o_orderdate").cast("timestamp_ntz").alias("arrived_at"))
    manifest = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("file_name"))
    until = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    return controls.rescan(named, manifest, until).select("file_name", "action")


@query("deposits_in_months", t.with_("deposits", """
SELECT strftime(deposit_date, '%Y-%m') AS period, source_system, count(*) AS deposits, sum(amount_usd) AS amount_usd
FROM deposits WHERE status = 'completed' AND year(deposit_date) = 1996 AND quarter(deposit_date) = 2 AND isodow(deposit_date) NOT IN (6, 7) GROUP BY 1, 2"""))
def deposits_in_months(spark: SparkSession, folder: str) -> DataFrame:
    """Published deposits of the working days of a quarter: the calendar decides which months' folders are read."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    batch = warehouse.begin("deposits")
    batch.append("fact_deposit", t.deposits(spark, folder))
    batch.append("dim_date", dims.calendar(spark, dt.date(1992, 1, 1), dt.date(1998, 12, 31)))
    batch.publish()
    days = warehouse.read("dim_date").where("year = 1996 and quarter = 2 and not is_weekend")
    return analytics.deposits_in(warehouse.read("fact_deposit"), days)
