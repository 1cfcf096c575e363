"""Row rules, duplicates, quarantine, expressions over rows, keys and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clock, hashing, images, masking
from ..operators import checks, controls, dims, keyed, numbering, quality
from ..plans import analytics
from ..session import written
from ..sources import snapshots, vendor
from . import tables as t
from .registry import query


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return t.base_dimension(spark, folder).where("is_current").select("client_id", "client_sk")


def _judged(spark: SparkSession, folder: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    return quality.judge_vendor_rows(t.delivered(spark, folder), _current(spark, folder), hold=written, keep=keep)


# --- dispositions ----------------------------------------------------------------------------------------


@query("vendor_disposition", t.with_(t.VENDOR, "SELECT deposit_id, file_name, row_num, disposition FROM judged"))
def vendor_disposition(spark: SparkSession, folder: str) -> DataFrame:
    """Every landed row with what became of it."""
    return _judged(spark, folder).select("deposit_id", "file_name", "row_num", "disposition")


@query("row_accounting", t.with_(t.VENDOR, """
SELECT count(*) AS rows_landed, count(*) FILTER (WHERE disposition = 'STAGED') AS rows_staged,
       count(*) FILTER (WHERE disposition NOT IN ('STAGED', 'DUPLICATE')) AS rows_quarantined,
       count(*) FILTER (WHERE disposition = 'DUPLICATE') AS duplicates_skipped, true AS balanced
FROM judged"""))
def row_accounting(spark: SparkSession, folder: str) -> DataFrame:
    return quality.row_accounting(_judged(spark, folder))


@query("manifest_counts", t.with_(t.VENDOR, """
SELECT sha256(file_name) AS file_hash, file_name, 'vendor' AS source, 'SUCCESS' AS status, count(*) AS row_count_landed,
       count(*) FILTER (WHERE disposition = 'STAGED') AS row_count_staged,
       count(*) FILTER (WHERE disposition NOT IN ('STAGED', 'DUPLICATE')) AS row_count_quarantined, 'b1' AS batch_id
FROM judged GROUP BY file_name"""))
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest row per vendor file."""
    return _manifest(_judged(spark, folder, keep=()))


def _manifest(judged: DataFrame) -> DataFrame:
    counts = quality.row_accounting(judged, ["file_name"]).withColumn("file_hash", hashing.content_digest("file_name"))
    at = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    return controls.manifest_rows(counts, "vendor", F.lit("b1"), at).drop("arrived_at", "processed_at")


@query("malformed_numeric", t.with_("delivered", """
SELECT deposit_id, file_name, amount_usd FROM delivered WHERE TRY_CAST(amount_usd AS DECIMAL(18,2)) IS NULL"""))
def malformed_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose numbers do not parse. They are set apart and fail nothing."""
    typed = quality.type_vendor_rows(t.delivered(spark, folder))
    rule = next(r for r in quality.vendor_rules() if r.reason == quality.MALFORMED_NUMERIC)
    return typed.where(rule.failed).select("deposit_id", "file_name", "amount_usd")


@query("negative_amounts", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def negative_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts that break the rule on negative amounts."""
    accounts = t.table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("t_amount_usd"))
    rule = next(r for r in quality.vendor_rules() if r.reason == quality.NEGATIVE_AMOUNT)
    return accounts.where(rule.failed).select("c_custkey", "c_acctbal")


@query("orphan_rows", t.with_("clients base deposits", """
SELECT deposit_id, client_id FROM deposits WHERE client_id NOT IN (SELECT client_id FROM base WHERE is_current)"""))
def orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Deposits without a current client."""
    rows = t.deposits(spark, folder).select("deposit_id", "client_id")
    return keyed.lookup_join(rows, _current(spark, folder).select("client_id"), ["client_id"], "left_anti")


@query("dedup_identical", t.with_(t.VENDOR, """
SELECT deposit_id, count(*) AS copies FROM judged WHERE disposition = 'DUPLICATE' GROUP BY deposit_id"""))
def dedup_identical(spark: SparkSession, folder: str) -> DataFrame:
    """Unchanged repeats: dropped and counted."""
    copies = _judged(spark, folder).where(F.col("disposition") == quality.DUPLICATE)
    return copies.groupBy("deposit_id").agg(F.count("*").alias("copies"))


@query("dedup_conflict", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, first_value(l_partkey) OVER w AS p, first_value(l_suppkey) OVER w AS s, first_value(l_extendedprice) OVER w AS e
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice)) f
WHERE l_partkey <> p OR l_suppkey <> s OR l_extendedprice <> e""")
def dedup_conflict(spark: SparkSession, folder: str) -> DataFrame:
    """Line items that repeat a key with another content than its first one. The values are at hand, so they
    are compared as they are; hashes stand in for them only where rows of different batches meet."""
    keys, content = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]
    lines = t.table(spark, folder, "lineitem").select(*keys, *content)
    first = keyed.earliest_by(lines, keys, content)
    winners = first.select(*keys, F.struct(*content).alias("won"))
    return keyed.lookup_join(lines, winners, keys).where(F.struct(*content) != F.col("won")).select(*keys, *content)


@query("quarantine_records", t.with_(t.VENDOR, """
SELECT sha256(concat_ws('|', 'vendor', file_name, CAST(row_num AS VARCHAR), disposition)) AS quarantine_id, 'vendor' AS source_system,
       file_name AS source_identifier, deposit_id AS record_id, disposition AS reason_code,
       '{"deposit_id":' || coalesce('"' || deposit_id || '"', 'null') || ',"client_id":' || coalesce('"' || client_id || '"', 'null') || ',"amount_usd":"' || amount_usd || '"}' AS raw_payload,
       CASE WHEN disposition IN ('ORPHAN_CLIENT', 'DUPLICATE_CONFLICT') THEN 'ERROR' ELSE 'CRITICAL' END AS severity,
       false AS is_resolved, disposition = 'ORPHAN_CLIENT' AS retry_eligible
FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE')"""))
def quarantine_records(spark: SparkSession, folder: str) -> DataFrame:
    """The rejected rows as quarantine records with repeatable ids."""
    return _quarantine(spark, folder).select(
        "quarantine_id", "source_system", "source_identifier", "record_id", "reason_code", "raw_payload", "severity", "is_resolved", "retry_eligible"
    )


def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_vendor_rows(_landed(spark, folder), _current(spark, folder), hold=written)
    return _records(judged, F.col("row_num"))


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    """Delivered rows with their payload as delivered, and the file's hash."""
    return t.delivered(spark, folder).withColumns({"raw_payload": _payload("amount_usd"), "file_hash": hashing.content_digest("file_name")})


def _payload(amount: str) -> F.Column:
    return F.to_json(F.struct("deposit_id", "client_id", F.col(amount).alias("amount_usd")), {"ignoreNullFields": "false"})


def _records(judged: DataFrame, occurrence: F.Column) -> DataFrame:
    return quality.quarantine_records(
        judged.where("verdict is not null"), "vendor", F.col("file_name"), F.col("deposit_id"), occurrence, F.col("raw_payload"),
        F.lit("b1"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"),
    )


@query("quarantine_summary", t.with_(t.VENDOR, """
SELECT disposition AS reason_code, CASE WHEN disposition IN ('ORPHAN_CLIENT', 'DUPLICATE_CONFLICT') THEN 'ERROR' ELSE 'CRITICAL' END AS severity,
       count(*) AS records
FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE') GROUP BY 1, 2"""))
def quarantine_summary(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.quarantine_summary(_quarantine(spark, folder))


@query("quarantine_retry", t.with_(t.VENDOR, """
SELECT record_id, client_id FROM (SELECT deposit_id AS record_id, client_id FROM judged WHERE disposition = 'ORPHAN_CLIENT') q
WHERE client_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)"""))
def quarantine_retry(spark: SparkSession, folder: str) -> DataFrame:
    """Records that may be tried again, now that customers in credit have become clients."""
    waiting = _judged(spark, folder).where("verdict.retry").select(F.col("deposit_id").alias("record_id"), "client_id")
    arrived = t.clients(spark, folder).where("account_balance_usd > 0").select("client_id")
    return keyed.lookup_join(waiting, arrived, ["client_id"], "left_semi").select("record_id", "client_id")


_ARRIVED = "disposition = 'ORPHAN_CLIENT' AND client_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)"


def _retried(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First judgement, quarantine, and the second judgement of the rows whose clients (customers in credit) have come."""
    landed, first = _landed(spark, folder), _current(spark, folder)

    def judge(rows: DataFrame, clients: DataFrame, staged: DataFrame | None, label: str, *keep: str) -> DataFrame:
        # the hash of a file and the payload follow from other columns here: they are added at the end, neither shuffled nor written
        # with every row; the rest of a payload goes with the rows that have a verdict, the row hash with those staged
        rows = rows.drop("file_hash", "raw_payload").withColumn("delivered_amount", F.col("amount_usd"))
        found = quality.judge_vendor_rows(rows, clients, staged, hold=written, keep=("client_id", "delivered_amount", *keep))
        failed, is_staged = F.col("verdict").isNotNull(), F.col("disposition") == quality.STAGED
        found = found.withColumns({c: F.when(failed, F.col(c)) for c in ("client_id", "delivered_amount")})
        found = found.withColumn("row_hash", F.when(is_staged, F.unhex("row_hash")))
        found = written(found, label).withColumns({"row_hash": F.lower(F.hex("row_hash")), "file_hash": hashing.content_digest("file_name")})
        return found.withColumn("raw_payload", F.when(failed, _payload("delivered_amount")))

    judged = judge(landed, first, None, "judged")
    records = written(_records(judged, F.concat_ws(":", "file_hash", "row_num")), "records")
    arrived = t.clients(spark, folder).where("account_balance_usd > 0").select("client_id", "client_sk")
    now = first.unionByName(arrived.join(first, "client_id", "left_anti"))
    staged = judged.where(F.col("disposition") == quality.STAGED).select("deposit_id", "row_hash")
    waiting = written(quality.waiting_rows(landed, records, now).drop("file_hash"), "waiting")
    again = judge(waiting, now, staged, "again", "quarantine_id")
    return judged, records, again


@query("quarantine_resolution", t.with_(t.VENDOR, f"""
SELECT deposit_id AS record_id, file_name AS source_identifier, disposition AS reason_code, {_ARRIVED} AS is_resolved,
       disposition = 'ORPHAN_CLIENT' AND NOT ({_ARRIVED}) AS retry_eligible
FROM judged WHERE disposition NOT IN ('STAGED', 'DUPLICATE') UNION ALL
SELECT deposit_id, file_name, 'DUPLICATE_CONFLICT', false, false FROM (
  SELECT *, first_value(t_amount) OVER (PARTITION BY deposit_id ORDER BY file_name, row_num) AS won FROM judged WHERE {_ARRIVED}) r
WHERE t_amount <> won"""))
def quarantine_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The quarantine after a retry: records dealt with are resolved, and rows that another rule holds back now have one for it."""
    _, records, again = _retried(spark, folder)
    done = keyed.upsert(records, quality.resolved(records, again), ["quarantine_id"], ["is_resolved", "retry_eligible"])
    fresh = _records(again, F.concat_ws(":", "file_hash", "row_num"))
    return done.unionByName(fresh).select("record_id", "source_identifier", "reason_code", "is_resolved", "retry_eligible")


@query("manifest_after_retry", t.with_(t.VENDOR, f"""
SELECT file_name, sum(first_staged) + sum(CASE WHEN arrived AND place2 = 1 THEN 1 ELSE 0 END) AS row_count_staged,
       sum(first_held) - sum(CASE WHEN arrived AND t_amount = won THEN 1 ELSE 0 END) AS row_count_quarantined
FROM (SELECT file_name, t_amount, arrived, CASE WHEN disposition = 'STAGED' THEN 1 ELSE 0 END AS first_staged,
             CASE WHEN disposition NOT IN ('STAGED', 'DUPLICATE') THEN 1 ELSE 0 END AS first_held,
             row_number() OVER w AS place2, first_value(t_amount) OVER w AS won
      FROM (SELECT *, {_ARRIVED} AS arrived FROM judged) j WINDOW w AS (PARTITION BY deposit_id, arrived ORDER BY file_name, row_num)) f
GROUP BY file_name"""))
def manifest_after_retry(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of every file once its waiting rows have been tried again, as an upsert of the counts that changed."""
    judged, _, again = _retried(spark, folder)
    at = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    counts = quality.row_accounting(judged, ["file_name", "file_hash"])
    manifest = written(controls.manifest_rows(counts, "vendor", F.lit("b1"), at), "manifest")
    now = controls.manifest_after_retry(manifest, again, at)
    after = keyed.upsert(manifest, now, ["file_hash"], ["row_count_staged", "row_count_quarantined", "processed_at"])
    return after.select("file_name", "row_count_staged", "row_count_quarantined")


@query("validity_ratio", t.with_(t.VENDOR, """
SELECT file_name, round(avg(CASE WHEN disposition IN ('STAGED', 'DUPLICATE') THEN 1.0 ELSE 0.0 END), 6) AS valid_ratio,
       avg(CASE WHEN disposition IN ('STAGED', 'DUPLICATE') THEN 1.0 ELSE 0.0 END) >= 0.99 AS within_target
FROM judged GROUP BY file_name"""))
def validity_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of valid rows per file, against a target of 99 %."""
    return quality.validity(_judged(spark, folder), ["file_name"])


@query("row_contract_violations", t.with_("deposits", """
SELECT deposit_id, CASE WHEN amount_usd < 20000 THEN 'BLANK_ID' WHEN status = 'failed' AND amount_usd > 150000 THEN 'UNKNOWN_STATUS'
       ELSE 'UNKNOWN_METHOD' END AS reason
FROM deposits WHERE amount_usd < 20000 OR (status = 'failed' AND amount_usd > 150000) OR payment_method NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"""))
def row_contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Deposits with a blank client id (the small ones), an unknown status (large failed ones) or an unknown method."""
    method = F.when(F.col("payment_method") == "1-URGENT", "bank_transfer").when(F.col("payment_method") == "2-HIGH", "credit_card")
    rows = t.deposits(spark, folder).withColumns({
        "client_id": F.when(F.col("amount_usd") < 20000, "  ").otherwise(F.col("client_id")),
        "status": F.when((F.col("status") == "failed") & (F.col("amount_usd") > 150000), "lost").otherwise(F.col("status")),
        "payment_method": method.when(F.col("payment_method") == "3-MEDIUM", "e_wallet").otherwise(F.col("payment_method")),
    })
    judged = rows.withColumn("verdict", quality.first_failure(quality.contract_rules()))
    return judged.where("verdict is not null").select("deposit_id", F.col("verdict.reason").alias("reason"))


@query("schema_drift_report", """
SELECT file_name, missing, unexpected, alias_used, missing = '' AND unexpected = '' AS approved FROM (
SELECT CAST(o_orderkey AS VARCHAR) AS file_name,
       CASE WHEN o_orderstatus = 'F' THEN 'fee_usd' ELSE '' END AS missing,
       CASE WHEN o_orderstatus = 'P' THEN 'bonus' ELSE '' END AS unexpected,
       o_orderpriority = '1-URGENT' AS alias_used
FROM orders) h""")
def schema_drift_report(spark: SparkSession, folder: str) -> DataFrame:
    """One delivered header per order: some with the alias, some short of a field, some with one too many."""
    names = F.transform(F.array(*[F.lit(f) for f in vendor.EXPECTED]), lambda f: F.when(
        (f == "payment_method") & (F.col("o_orderpriority") == "1-URGENT"), F.lit("method")).otherwise(f))
    header = (
        F.when(F.col("o_orderstatus") == "F", F.array_remove(names, "fee_usd"))
        .when(F.col("o_orderstatus") == "P", F.array_append(names, "bonus")).otherwise(names)
    )
    heads = t.table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("file_name"), header.alias("header"))
    return vendor.drift_report(heads)


@query("column_fallback", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '5-LOW' THEN 'card' ELSE o_orderpriority END AS payment_method FROM orders""")
def column_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A missing or empty method falls back to the misnamed column."""
    method = F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))
    rows = t.table(spark, folder, "orders").select("o_orderkey", method.alias("payment_method"), F.lit("card").alias("credit_card"))
    return snapshots.with_fallback(rows, "payment_method", "credit_card")


@query("typed_staging", t.with_("deposits", """
SELECT deposit_id, client_id, deposit_date, amount_usd, payment_method, currency_original, CAST(1.5 AS DECIMAL(18,4)) AS exchange_rate,
       status, 3 AS processing_days, fee_usd,
       sha256(concat_ws('|', deposit_id, client_id, CAST(CAST(amount_usd AS DECIMAL(38,4)) AS VARCHAR), status)) AS row_hash
FROM deposits"""))
def typed_staging(spark: SparkSession, folder: str) -> DataFrame:
    """Text columns cast strictly to their types, with the row hash."""
    rows = t.deposits(spark, folder).withColumns({"exchange_rate": F.lit("1.50"), "processing_days": F.lit("3")})
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    return snapshots.typed(text, "client_deposit", F.lit("b1"), F.lit(None).cast("timestamp_ntz")).drop("batch_id", "staged_at")


@query("canonical_deposits", t.with_("deposits", """
SELECT source_system, deposit_id, client_id, amount_usd,
       CASE source_system WHEN 'vendor' THEN 'CANONICAL_VENDOR' ELSE 'CANONICAL_WAREHOUSE' END AS reconciliation_status FROM deposits"""))
def canonical_deposits(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources under one key, which includes the source; neither overwrites the other."""
    rows = t.deposits(spark, folder).select("source_system", "deposit_id", "client_id", "amount_usd")
    return _canonical(rows)


def _canonical(rows: DataFrame) -> DataFrame:
    tagged = [
        rows.where(F.col("source_system") == source).withColumn("reconciliation_status", F.lit(status))
        for source, status in (("warehouse", "CANONICAL_WAREHOUSE"), ("vendor", "CANONICAL_VENDOR"))
    ]
    return tagged[0].unionByName(tagged[1])


@query("deposit_breakdown", t.with_("deposits", """
SELECT source_system, CASE source_system WHEN 'vendor' THEN 'CANONICAL_VENDOR' ELSE 'CANONICAL_WAREHOUSE' END AS reconciliation_status,
       count(*) AS records FROM deposits GROUP BY source_system"""))
def deposit_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.deposit_breakdown(_canonical(t.deposits(spark, folder)))


@query("uniqueness_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def uniqueness_violations(spark: SparkSession, folder: str) -> DataFrame:
    return keyed.duplicate_keys(t.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("cross_source_matches", """
SELECT v.deposit_id, count(*) AS candidates, min(w.deposit_id) AS first_candidate
FROM (SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) || '-' || CAST(min(l_suppkey) AS VARCHAR) AS deposit_id, l_partkey AS client_id,
             CAST(l_shipdate AS DATE) AS deposit_date, l_returnflag AS payment_method, CAST(CAST(l_quantity AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS amount
      FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag, l_quantity) v
JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS deposit_id, l_partkey AS client_id, CAST(l_shipdate AS DATE) AS deposit_date, l_returnflag AS payment_method,
             CAST(CAST(l_quantity AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_linestatus = 'F') w
ON v.client_id = w.client_id AND v.deposit_date = w.deposit_date AND v.payment_method = w.payment_method AND abs(v.amount - w.amount) <= 0.01
GROUP BY v.deposit_id""")
def cross_source_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Open line items as vendor deposits, finished ones as warehouse deposits: which look alike?"""
    amount = (F.col("l_quantity").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    rows = t.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", F.col("l_partkey").alias("client_id"),
        F.col("l_shipdate").cast("date").alias("deposit_date"), F.col("l_returnflag").alias("payment_method"),
        F.lit("USD").alias("currency_original"), amount.alias("amount_usd"),
    )
    match = ["client_id", "deposit_date", "payment_method", "currency_original", "amount_usd"]
    vendor_rows = rows.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber", *match).agg(F.min("l_suppkey").alias("s")).withColumn(
        "deposit_id", F.concat_ws("-", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), F.col("s").cast("string"))
    )
    warehouse_rows = rows.where("l_linestatus = 'F'").withColumn("deposit_id", F.col("l_orderkey").cast("string"))
    return checks.cross_source_candidates(warehouse_rows, vendor_rows)


# --- expressions -----------------------------------------------------------------------------------------


@query("row_hash", t.with_("deposits", """
SELECT deposit_id, sha256(concat_ws('|', client_id, CAST(deposit_date AS VARCHAR), CAST(CAST(amount_usd AS DECIMAL(38,4)) AS VARCHAR),
       payment_method, coalesce(CASE WHEN status <> 'failed' THEN status END, 'NULL'))) AS row_hash FROM deposits"""))
def row_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.deposits(spark, folder).withColumn("status", F.when(F.col("status") != "failed", F.concat(F.lit(" "), "status", F.lit(" "))))
    fields = ["client_id", "deposit_date", "amount_usd", "payment_method", "status"]
    return rows.select("deposit_id", hashing.row_digest(rows, fields).alias("row_hash"))


@query("payload_hash", """
SELECT event_id, sha256('{"client_id":' || user_id || ',"op":"' || event_type || '","props":' || replace(props, ' ', '') || '}') AS payload_hash FROM events""")
def payload_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of a JSON event, independent of key order and spacing."""
    line = F.format_string('{"op": "%s",  "props": %s, "client_id": %d}', "event_type", "props", "user_id")
    return t.table(spark, folder, "events").select("event_id", hashing.payload_digest(line).alias("payload_hash"))


@query("json_images", t.with_("feed", """
SELECT lsn, has_status AS status_given, CASE WHEN has_status THEN status ELSE 'unchanged' END AS status,
       CASE WHEN has_risk THEN risk ELSE 'unchanged' END AS risk FROM feed"""))
def json_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images out of JSON text: an absent key takes the default, a present null stays null."""
    after = F.col("after")
    events = t.feed(spark, folder)
    text = events.select("lsn", F.to_json(F.struct("after"), {"ignoreNullFields": "false"}).alias("line"))
    parsed = text.select("lsn", images.image(F.parse_json("line"), "$.after").alias("after"))
    return parsed.select(
        "lsn", images.present(after, "account_status").alias("status_given"),
        images.value_or(after, "account_status", "unchanged").alias("status"),
        images.value_or(after, "risk_category", "unchanged").alias("risk"),
    )


@query("iso_timestamps", "SELECT event_id, CASE WHEN event_type = 'click' THEN ts - INTERVAL 8 HOUR ELSE ts END AS commit_ts FROM events")
def iso_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """ISO text with Z, with an offset and with none, as UTC."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    suffix = F.when(F.col("event_type") == "click", "+08:00").when(F.col("event_type") == "view", "").otherwise("Z")
    return t.table(spark, folder, "events").select("event_id", clock.utc(F.concat(iso, suffix)).alias("commit_ts"))


@query("client_masked", t.with_("clients", r"""
SELECT client_sk, client_id, regexp_replace(full_name, '(^.).*(.)$', '\1***\2') AS full_name_masked,
       CAST(date_trunc('year', date_of_birth) AS DATE) AS birth_year, regexp_replace(email, '(^.).*(@.*)$', '\1***\2') AS email_masked,
       country, nationality, account_type, kyc_status, risk_category, account_status
FROM clients"""))
def client_masked(spark: SparkSession, folder: str) -> DataFrame:
    """The masked view, without the columns that are constant here."""
    dim = dims.open_version(t.clients(spark, folder)).withColumns(
        {c: F.lit(None).cast("string") for c in ("referral_source", "signup_platform", "preferred_language")}
    )
    return analytics.masked_clients(dim).select(
        "client_sk", "client_id", "full_name_masked", "birth_year", "email_masked", "country", "nationality",
        "account_type", "kyc_status", "risk_category", "account_status",
    )


@query("pii_tokens", "SELECT c_custkey, sha256('pepper|' || c_name) AS name_token FROM customer")
def pii_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "customer").select("c_custkey", masking.pseudonym(F.col("c_name"), "pepper").alias("name_token"))


# --- dimension rows and keys -----------------------------------------------------------------------------


@query("scd2_bootstrap", t.with_("clients base", """
SELECT 10 + row_number() OVER (ORDER BY client_id) AS client_sk, client_id, full_name, email, country, risk_category, account_status,
       TIMESTAMP '2024-01-01 00:00:00' AS valid_from, true AS is_current, false AS is_deleted, false AS is_inferred
FROM clients WHERE kyc_status = 'approved' AND client_id NOT IN (SELECT client_id FROM base WHERE is_deleted)"""))
def scd2_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """First versions of clients with both signup (all) and profile (approved), numbered on from key 10."""
    people = t.clients(spark, folder).withColumns(
        {c: F.lit(None).cast("string") for c in ("referral_source", "signup_platform", "promo_code", "assigned_manager", "preferred_language")}
    )
    known = t.base_dimension(spark, folder).where("is_deleted")
    first = dims.bootstrap_clients(people, people.where("kyc_status = 'approved'"), known)
    return dims.number_clients(first, 10).select(
        "client_sk", "client_id", "full_name", "email", "country", "risk_category", "account_status",
        "valid_from", "is_current", "is_deleted", "is_inferred",
    )


@query("inferred_members", t.with_("clients base deposits", """
SELECT DISTINCT client_id, 'Inferred Client ' || client_id AS full_name, client_id || '@inferred.internal' AS email,
       'low' AS risk_category, 'pending' AS kyc_status, true AS is_inferred
FROM deposits WHERE client_id NOT IN (SELECT client_id FROM base)"""))
def inferred_members(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders for clients that deposits name and the dimension lacks."""
    made = dims.inferred_clients(t.deposits(spark, folder), t.base_dimension(spark, folder))
    return made.select("client_id", "full_name", "email", "risk_category", "kyc_status", "is_inferred")


@query("inferred_completion", t.with_("clients", """
SELECT client_id, CASE WHEN kyc_status = 'approved' THEN full_name ELSE 'Inferred Client ' || client_id END AS full_name,
       CASE WHEN kyc_status = 'approved' THEN country ELSE 'Unknown' END AS country, kyc_status <> 'approved' AS is_inferred FROM clients"""))
def inferred_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Placeholders of all clients, completed for those whose own data has arrived (the approved ones)."""
    people = t.clients(spark, folder)
    dim = dims.inferred_clients(people, people.limit(0))
    arrived = people.where("kyc_status = 'approved'").select("client_id", "full_name", "country")
    return dims.complete_inferred(dim, arrived).select("client_id", "full_name", "country", "is_inferred")


@query("type1_overwrite", t.with_("clients base", """
SELECT c.client_id, c.full_name, CASE WHEN b.client_id IS NULL THEN c.email ELSE c.email || '.new' END AS email
FROM clients c LEFT JOIN base b ON c.client_id = b.client_id"""))
def type1_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptive fields corrected in place for the clients that sent a correction."""
    people = t.clients(spark, folder).select("client_id", "full_name", "email")
    sent = people.join(t.base_dimension(spark, folder).select("client_id"), "client_id", "left_semi").select(
        "client_id", F.lit("ignored").alias("full_name"), F.concat("email", F.lit(".new")).alias("email")
    )
    return keyed.upsert(people, sent, ["client_id"], ["email"])


@query("opening_balances", t.with_("clients base", """
SELECT c.client_id, b.valid_from AS observed_at, c.account_balance_usd AS balance_usd
FROM clients c JOIN base b ON c.client_id = b.client_id WHERE b.is_current"""))
def opening_balances(spark: SparkSession, folder: str) -> DataFrame:
    """The profile balance as the first observation of every current client."""
    return dims.opening_balances(t.clients(spark, folder), t.base_dimension(spark, folder))


@query("current_clients", t.with_("clients base", "SELECT client_sk, client_id, risk_category FROM base WHERE is_current"))
def current_clients(spark: SparkSession, folder: str) -> DataFrame:
    return t.base_dimension(spark, folder).where("is_current").select("client_sk", "client_id", "risk_category")


@query("fact_key_lookup", t.with_("clients base deposits", """
SELECT d.deposit_id, d.client_id, b.client_sk FROM deposits d LEFT JOIN (SELECT * FROM base WHERE is_current) b ON d.client_id = b.client_id"""))
def fact_key_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Deposits with the key of the current version, null where there is none."""
    return dims.with_client_key(t.deposits(spark, folder).select("deposit_id", "client_id"), t.base_dimension(spark, folder))


@query("trade_instrument_lookup", """
SELECT b.instrument_sk, count(*) AS trades
FROM lineitem JOIN part ON l_partkey = p_partkey
LEFT JOIN (SELECT p_brand, min(p_partkey) AS instrument_sk FROM part WHERE p_size > 45 AND p_brand < 'Brand#4' GROUP BY p_brand) b ON part.p_brand = b.p_brand
GROUP BY b.instrument_sk""")
def trade_instrument_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Trades by instrument key; brands outside the dimension have none."""
    part = t.table(spark, folder, "part")
    instruments = part.where("p_size > 45 and p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("instrument_name")).agg(
        F.min("p_partkey").alias("instrument_sk"))
    trades = t.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(
        part.select("p_partkey", F.col("p_brand").alias("instrument")), "p_partkey")
    return dims.with_instrument_key(trades, instruments).groupBy("instrument_sk").agg(F.count("*").alias("trades"))


@query("surrogate_keys", t.with_("feed", """
SELECT lsn, 1000 + row_number() OVER (ORDER BY lsn) AS client_sk FROM feed WHERE op = 'insert'"""))
def surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Dense keys for insert events in LSN order, on from 1000."""
    return numbering.dense_number(t.feed(spark, folder).where("op = 'insert'").select("lsn"), ["lsn"], "client_sk", 1000)
