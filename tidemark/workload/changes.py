"""Change application, history, replay and their checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import asof, checks, compare, controls, dims, history, replay
from ..plans import analytics, changes as change_plan
from ..plans.publish import Warehouse
from ..session import scratch_path, written
from ..streaming import changes as streaming
from . import tables as t
from .registry import query

# The window that is replayed, and the same as SQL.
LOW, HIGH = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12)
_LOW, _HIGH = f"TIMESTAMP '{LOW}'", f"TIMESTAMP '{HIGH}'"
_AFFECTED = f"(SELECT client_id FROM feed WHERE commit_ts BETWEEN {_LOW} AND {_HIGH})"
_VERSION = "client_sk, client_id, opened_by_lsn, risk_category, account_status, valid_from, valid_to, is_current, is_deleted, deleted_at"


@query("scd2_apply", t.with_(t.FULL, f"SELECT {_VERSION} FROM dim"))
def scd2_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The whole feed on top of the base dimension: all versions, closed and open."""
    return t.full_dimension(spark, folder)[0]


@query("soft_delete", t.with_(t.FULL, "SELECT client_id, client_sk, valid_to, deleted_at FROM dim WHERE is_deleted"))
def soft_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Clients that were deleted: their last version is kept, ended and marked."""
    return t.full_dimension(spark, folder)[0].where("is_deleted").select("client_id", "client_sk", "valid_to", "deleted_at")


@query("balance_changes", t.with_(t.HISTORY + " balances", "SELECT lsn, client_id, observed_at, balance_usd FROM balances"))
def balance_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Balances that really changed, of clients that were current at the time."""
    return history.apply_events(t.base_dimension(spark, folder), t.feed(spark, folder)).balances


@query("cdc_outcomes", t.with_("clients base feed lives", """
SELECT f.lsn, f.client_id, f.op, CASE WHEN f.op = 'truncate' THEN 'QUARANTINED'
       WHEN f.op = 'insert' AND f.lsn IS DISTINCT FROM l.birth THEN 'RECONCILED' ELSE 'APPLIED' END AS outcome
FROM feed f JOIN lives l ON f.client_id = l.client_id"""))
def cdc_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger entry of every event."""
    applied = history.apply_events(t.base_dimension(spark, folder), t.feed(spark, folder))
    return applied.outcomes.select("lsn", "client_id", "op", "outcome")


@query("cdc_unsupported_ops", t.with_("feed", """
SELECT sha256(concat_ws('|', 'cdc', CAST(lsn AS VARCHAR), 'UNSUPPORTED_OPERATION')) AS quarantine_id, CAST(lsn AS VARCHAR) AS record_id,
       op AS raw_payload, 'UNSUPPORTED_OPERATION' AS reason_code, 'ERROR' AS severity, false AS retry_eligible
FROM feed WHERE op NOT IN ('insert', 'update', 'delete')"""))
def cdc_unsupported_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine records of the events whose operation is unknown; the payload here is the operation."""
    events, batch = t.feed(spark, folder), Warehouse(spark, scratch_path(spark, "warehouse")).begin("b1")
    outcomes = history.apply_events(t.base_dimension(spark, folder), events, hold=written).outcomes
    raw = events.select("lsn", F.col("op").alias("raw_json"), F.lit("feed").alias("file_name"))
    held = change_plan.unsupported_records(batch, outcomes, raw)
    return held.select("quarantine_id", "record_id", "raw_payload", "reason_code", "severity", "retry_eligible")


@query("lsn_conflicts", """
SELECT user_id AS lsn FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def lsn_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Positions that came with different payloads, if users were log positions and event types payloads."""
    return checks.conflicting_lsns(
        t.table(spark, folder, "events").select(F.col("user_id").alias("lsn"), F.col("event_type").alias("payload_hash"))
    )


@query("lsn_gaps", t.with_("feed", """
SELECT after_lsn, lsn AS before_lsn, lsn - after_lsn - 1 AS missing
FROM (SELECT lsn, lag(lsn) OVER (ORDER BY lsn) AS after_lsn FROM feed WHERE op = 'update') g WHERE lsn - after_lsn > 1"""))
def lsn_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Holes in the log when only updates are delivered."""
    return checks.log_gaps(t.feed(spark, folder).where("op = 'update'"))


@query("cdc_contract_violations", t.with_("feed", """
SELECT lsn, client_id, op, CASE WHEN op = 'insert' THEN 'INSERT_WITHOUT_AFTER' WHEN op = 'delete' THEN 'DELETE_WITHOUT_BEFORE'
       WHEN lsn % 11 = 0 THEN 'UPDATE_WITHOUT_AFTER' WHEN lsn % 11 = 1 THEN 'UPDATE_WITHOUT_BEFORE' ELSE 'MALFORMED_BALANCE' END AS violation
FROM feed WHERE (op = 'insert' AND lsn % 3 = 0) OR op = 'delete' OR (op = 'update' AND lsn % 11 IN (0, 1)) OR (has_balance AND lsn % 11 = 2)"""))
def cdc_contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Events without the images their operation needs: images are taken from some events, deletes have none anyway."""
    lost, place = F.lit(None).cast("map<string,string>"), F.col("lsn") % 11
    insert, update = F.col("op") == "insert", F.col("op") == "update"
    balance = F.create_map(F.lit(history.BALANCE), F.lit("n/a"))
    has_balance = F.coalesce(F.map_contains_key("after", F.lit(history.BALANCE)), F.lit(False))
    faulty = t.feed(spark, folder).withColumns({
        "after": F.when((insert & (F.col("lsn") % 3 == 0)) | (update & (place == 0)), lost)
        .when(has_balance & (place == 2), balance).otherwise(F.col("after")),
        "before": F.when(update & (place == 1), lost).otherwise(F.col("before")),
    })
    return checks.event_contract_violations(faulty)


@query("conflicting_inserts", t.with_("clients base feed", """
SELECT f.lsn, f.client_id, 'low' AS event_risk, b.risk_category AS known_risk, CAST(NULL AS VARCHAR) AS event_status, b.account_status AS known_status
FROM feed f JOIN base b ON f.client_id = b.client_id WHERE f.op = 'insert' AND b.is_current AND f.has_risk AND b.risk_category <> 'low'"""))
def conflicting_inserts(spark: SparkSession, folder: str) -> DataFrame:
    return checks.conflicting_inserts(t.feed(spark, folder), t.base_dimension(spark, folder))


# --- invariants ------------------------------------------------------------------------------------------


def _orders_as_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A dimension with faults: every order is a version of its client, in force for up to 50 days."""
    start = F.col("o_orderdate").cast("timestamp_ntz")
    days = (F.col("o_totalprice").cast("int") % 50).cast("int")
    return t.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("client_id"), F.col("o_orderkey").alias("client_sk"), start.alias("valid_from"),
        F.date_add(F.col("o_orderdate").cast("date"), days).cast("timestamp_ntz").alias("valid_to"),
    )


_ORDER_VERSIONS = """
WITH v AS (SELECT CAST(o_custkey AS VARCHAR) AS client_id, o_orderkey AS client_sk, o_orderdate AS valid_from,
  CAST(CAST(o_orderdate AS DATE) + CAST(CAST(floor(o_totalprice) AS INTEGER) % 50 AS INTEGER) AS TIMESTAMP) AS valid_to FROM orders)
"""


@query("scd2_overlaps", _ORDER_VERSIONS + """
SELECT client_id, client_sk, valid_from, valid_to FROM (
  SELECT *, max(valid_to) OVER (PARTITION BY client_id ORDER BY valid_from, client_sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v) o
WHERE reach > valid_from""")
def scd2_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that begin while an earlier one of the client is in force, in a history full of them."""
    return checks.overlapping_versions(_orders_as_versions(spark, folder))


@query("scd2_gaps", _ORDER_VERSIONS + """
SELECT client_id, client_sk, previous_end, valid_from FROM (
  SELECT *, lag(valid_to) OVER (PARTITION BY client_id ORDER BY valid_from, client_sk) AS previous_end FROM v) g
WHERE previous_end <> valid_from""")
def scd2_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that do not begin where the one before ended."""
    return checks.history_gaps(_orders_as_versions(spark, folder))


# --- replay ----------------------------------------------------------------------------------------------


@query("replay_window", t.with_("feed", f"SELECT lsn, commit_ts, client_id, op FROM feed WHERE commit_ts BETWEEN {_LOW} AND {_HIGH}"))
def replay_window(spark: SparkSession, folder: str) -> DataFrame:
    return replay.window_events(t.feed(spark, folder), LOW, HIGH).select("lsn", "commit_ts", "client_id", "op")


@query("replay_affected", t.with_("feed", f"SELECT DISTINCT client_id FROM feed WHERE commit_ts BETWEEN {_LOW} AND {_HIGH}"))
def replay_affected(spark: SparkSession, folder: str) -> DataFrame:
    return replay.affected_clients(t.feed(spark, folder), LOW, HIGH)


@query("replay_events", t.with_("feed", f"SELECT lsn, client_id, op FROM feed WHERE commit_ts >= {_LOW} AND client_id IN {_AFFECTED}"))
def replay_events(spark: SparkSession, folder: str) -> DataFrame:
    """Affected clients' events from the boundary through their latest."""
    events = t.feed(spark, folder)
    return replay.events_to_rebuild(events, replay.same_boundary(replay.affected_clients(events, LOW, HIGH), LOW)).select("lsn", "client_id", "op")


def _before_replay(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = t.feed(spark, folder)
    boundaries = replay.same_boundary(replay.affected_clients(events, LOW, HIGH), LOW)
    return events, boundaries, written(t.full_dimension(spark, folder)[0], "dim")


@query("replay_purge", t.with_(t.FULL, f"SELECT {_VERSION} FROM dim WHERE NOT (valid_from >= {_LOW} AND client_id IN {_AFFECTED})"))
def replay_purge(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension without the affected clients' versions from the boundary on."""
    _, boundaries, dim = _before_replay(spark, folder)
    return replay.purge_versions(dim, boundaries)


_OPENED = f"valid_from < {_LOW} AND (valid_to IS NULL OR valid_to >= {_LOW}) AND client_id IN {_AFFECTED}"


@query("replay_reopen", t.with_(t.FULL, f"""
SELECT client_sk, client_id, opened_by_lsn, risk_category, account_status, valid_from,
       CASE WHEN {_OPENED} THEN NULL ELSE valid_to END AS valid_to, is_current OR ({_OPENED}) AS is_current,
       is_deleted AND NOT ({_OPENED}) AS is_deleted, CASE WHEN {_OPENED} THEN NULL ELSE deleted_at END AS deleted_at
FROM dim WHERE NOT (valid_from >= {_LOW} AND client_id IN {_AFFECTED})"""))
def replay_reopen(spark: SparkSession, folder: str) -> DataFrame:
    """The base a replay starts from: purged, and the version in force at the boundary open again."""
    _, boundaries, dim = _before_replay(spark, folder)
    return replay.base_at(dim, boundaries)


def _replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events, boundaries, dim = _before_replay(spark, folder)
    base = written(replay.base_at(dim, boundaries), "base")
    again = history.apply_events(base, replay.events_to_rebuild(events, boundaries))
    return dim, t.dimension_after(base, again)


@query("replay_rebuild", t.with_(t.FULL, f"SELECT {_VERSION} FROM dim"))
def replay_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension after three days of events were replayed: what it was before."""
    return _replayed(spark, folder)[1]


@query("replay_from_start", t.with_(t.FULL, f"SELECT {_VERSION} FROM dim"))
def replay_from_start(spark: SparkSession, folder: str) -> DataFrame:
    """A replay whose window begins where the bootstrap versions do, before all events: the dimension stays what it was.

    (Clients that the stand-in base deletes earlier, without an event, lie before the window.)"""
    early = dt.datetime(2024, 1, 1)
    events = t.feed(spark, folder)
    dim = written(t.full_dimension(spark, folder)[0], "dim")
    boundaries = replay.same_boundary(replay.affected_clients(events, early, HIGH), early)
    base = written(replay.base_at(dim, boundaries), "base")
    again = history.apply_events(base, replay.events_to_rebuild(events, boundaries), hold=written)
    return t.dimension_after(base, again)


_DIFF = "CAST(client_id AS BIGINT) % 16"


@query("replay_noop_diff", t.with_(t.FULL, f"""
SELECT c.trial, b.bucket, b.n AS rows_before, b.n AS rows_after, c.trial = 'replay' OR b.bucket <> p.bucket AS equal,
       CASE WHEN c.trial = 'planted' AND b.bucket = p.bucket THEN 2 ELSE 0 END AS differing
FROM (SELECT {_DIFF} AS bucket, count(*) AS n FROM dim GROUP BY 1) b,
     (SELECT {_DIFF} AS bucket FROM dim ORDER BY client_sk DESC LIMIT 1) p, (VALUES ('replay'), ('planted')) c(trial)"""))
def replay_noop_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The dimension before and after a replay, bucket by bucket: nothing differs. With one version changed on purpose,
    its bucket does, by the row that is gone and the one that has come."""
    before, after = _replayed(spark, folder)
    after = written(after, "after")
    top = after.agg(F.max("client_sk").alias("top")).first().top
    planted = after.withColumn("risk_category", F.when(F.col("client_sk") == top, "planted").otherwise(F.col("risk_category")))
    bucket = (F.col("client_id").cast("long") % 16).cast("long")
    found = []
    for trial, now in (("replay", after), ("planted", planted)):
        compared = written(compare.compared_buckets(before, now, bucket), trial)
        differing = compare.differing_rows(before, now, bucket, compared).groupBy("bucket").agg(F.sum("times").alias("differing"))
        joined = compared.join(differing, "bucket", "left").withColumn("trial", F.lit(trial)).fillna(0, ["differing"])
        found.append(joined.select("trial", "bucket", "rows_before", "rows_after", "equal", "differing"))
    return found[0].unionByName(found[1])


def _late_views(events: DataFrame) -> DataFrame:
    """The views of each client's first days, between two and eleven of them, which arrive after all else."""
    views = F.map_contains_key(F.coalesce("after", F.create_map().cast("map<string,string>")), F.lit(history.STATUS))
    until = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("client_id").cast("long") % 10).cast("int"))
    return views & (F.col("commit_ts") < until)


def _late_boundaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The feed, its part in time, its late part, and where each client's history has to begin again."""
    events = t.feed(spark, folder)
    is_late = _late_views(events)
    first, second = events.where(~is_late), events.where(is_late)
    late = written(replay.late_clients(second, first), "late")
    return events, first, second, written(replay.late_boundaries(events, late), "boundaries")


@query("late_rebuilt_events", t.with_("feed late overtaken boundaries", """
SELECT f.lsn, f.client_id, b.from_ts FROM feed f JOIN boundaries b ON f.client_id = b.client_id WHERE commit_ts >= from_ts"""))
def late_rebuilt_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events that late arrivals cause to be applied again: of each late client, its own tail and no more."""
    events, _, _, boundaries = _late_boundaries(spark, folder)
    rebuilt = replay.events_to_rebuild(events, boundaries)
    return rebuilt.join(boundaries, "client_id").select("lsn", "client_id", "from_ts")


@query("late_lsn_rebuild", t.with_(t.FULL, f"SELECT {_VERSION} FROM dim"))
def late_lsn_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """Late views of very different age. Each client is rebuilt from its own first late event on; the end is what it would
    have been in order."""
    events, first, second, boundaries = _late_boundaries(spark, folder)
    base = t.base_dimension(spark, folder)
    dim = written(t.dimension_after(base, history.apply_events(base, first)), "dim")
    other = second.join(boundaries, "client_id", "left_anti")
    work = replay.events_to_rebuild(events, boundaries).unionByName(other)
    rebuilt = written(replay.base_at(dim, boundaries), "base")
    return t.dimension_after(rebuilt, history.apply_events(rebuilt, work))


@query("stream_apply", t.with_(t.FULL, """
SELECT client_id, opened_by_lsn, risk_category, account_status, valid_from, valid_to, is_current, is_deleted, deleted_at FROM dim"""))
def stream_apply(spark: SparkSession, folder: str) -> DataFrame:
    """The feed as a file stream into a published warehouse, in several micro-batches."""
    source, root = scratch_path(spark, "stream"), scratch_path(spark, "warehouse")
    document = F.struct(
        "lsn", F.concat(F.date_format("commit_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("commit_ts"),
        "op", "client_id", "before", "after",
    )
    lines = t.feed(spark, folder).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value"), "lsn")
    lines.repartitionByRange(2, "lsn").select("value").write.text(source)
    warehouse = Warehouse(spark, root, buckets=4)
    batch = warehouse.begin("base")
    batch.append("dim_client", t.base_dimension(spark, folder))
    batch.publish()
    streaming.start(spark, source, root, scratch_path(spark, "checkpoint"), max_files=1).awaitTermination()
    return warehouse.read("dim_client").select(
        "client_id", "opened_by_lsn", "risk_category", "account_status", "valid_from", "valid_to", "is_current", "is_deleted", "deleted_at"
    )


# --- points in time ---------------------------------------------------------------------------------------


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a fact of its client, at its own time; some of them before the client's first version or after its last."""
    return t.feed(spark, folder).select("lsn", "client_id", "commit_ts")


_AT_FACT = """
SELECT f.lsn, f.client_id, {columns} FROM feed f LEFT JOIN (
  SELECT f.lsn, {inner} FROM feed f JOIN {table} s ON f.client_id = s.client_id AND s.{since} <= f.commit_ts
  QUALIFY row_number() OVER (PARTITION BY f.lsn ORDER BY s.{since} DESC, s.{order} DESC) = 1) v ON f.lsn = v.lsn"""


@query("fact_key_as_of", t.with_(t.FULL, _AT_FACT.format(
    columns="v.client_sk", table="dim", since="valid_from", order="client_sk",
    inner="CASE WHEN s.valid_to IS NULL OR s.valid_to > f.commit_ts THEN s.client_sk END AS client_sk")))
def fact_key_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The key of the version that was valid at each fact's own time."""
    return dims.with_client_key_as_of(_facts(spark, folder), t.full_dimension(spark, folder)[0], "commit_ts").drop("commit_ts")


@query("fact_balance_as_of", t.with_(t.HISTORY + " balances", _AT_FACT.format(
    columns="v.balance_usd", table="balances", since="observed_at", order="lsn", inner="s.balance_usd")))
def fact_balance_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The latest balance change at or before each fact's own time."""
    balances = t.full_dimension(spark, folder)[1].balances
    return asof.as_of(_facts(spark, folder), balances, "client_id", "commit_ts", "observed_at", ["balance_usd"], ["lsn"]).drop("commit_ts")


@query("deposits_by_state", t.with_(t.FULL + " balances", """
SELECT risk_category, account_status, balance_known, count(*) AS deposits, sum(amount_usd) AS amount_usd FROM (
  SELECT f.lsn, f.amount_usd,
    (SELECT max({'a': valid_from, 'b': client_sk, 'r': CASE WHEN valid_to IS NULL OR valid_to > made THEN risk_category END}) FROM dim d WHERE d.client_id = f.client_id AND valid_from <= made).r AS risk_category,
    (SELECT max({'a': valid_from, 'b': client_sk, 'r': CASE WHEN valid_to IS NULL OR valid_to > made THEN account_status END}) FROM dim d WHERE d.client_id = f.client_id AND valid_from <= made).r AS account_status,
    EXISTS (SELECT 1 FROM balances b WHERE b.client_id = f.client_id AND observed_at <= made) AS balance_known
  FROM (SELECT lsn, client_id, CAST(value AS DECIMAL(18,2)) AS amount_usd,
               CAST(CAST(commit_ts AS DATE) + 1 AS TIMESTAMP) - INTERVAL 1 MICROSECOND AS made FROM feed WHERE event_type = 'purchase') f
) g GROUP BY ALL"""))
def deposits_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as deposits, by the state of their client at the end of the day."""
    dim, applied = t.full_dimension(spark, folder)
    purchases = t.table(spark, folder, "events").where("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("date").alias("deposit_date"),
        F.col("value").cast("decimal(18,2)").alias("amount_usd"), F.lit("completed").alias("status"))
    return analytics.deposits_by_state(purchases, dim, applied.balances)


# --- deliveries ------------------------------------------------------------------------------------------


@query("late_files", """
SELECT strftime(o_orderdate, '%Y-%m') AS delivered_on, substr(CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 AS INTEGER) AS VARCHAR), 1, 7) AS business_date,
       count(*) AS late_rows
FROM orders
WHERE substr(CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 60 AS INTEGER) AS VARCHAR), 1, 7) < strftime(o_orderdate, '%Y-%m') GROUP BY 1, 2""")
def late_files(spark: SparkSession, folder: str) -> DataFrame:
    """Business months that monthly deliveries still added to after they were over."""
    rows = t.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("delivered_on"),
        F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")), "yyyy-MM").alias("business_date"),
    )
    return controls.late_deliveries(rows, "business_date", "delivered_on")


@query("missing_deliveries", """
SELECT CAST(d AS DATE) AS date_key
FROM (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)), INTERVAL 1 DAY)) AS d FROM lineitem) s
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R')""")
def missing_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the calendar without a large return."""
    lines = t.table(spark, folder, "lineitem")
    span = lines.agg(F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
    days = dims.calendar(spark, F.col("low"), F.col("high"), span)
    delivered = lines.where("l_quantity > 49 and l_returnflag = 'R'").select(F.col("l_shipdate").cast("date").alias("date_key"))
    return controls.missing_days(days, delivered)


@query("freshness", """
SELECT event_type AS source, max(ts) AS last_arrival, max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 26 HOUR AS stale,
       epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000000 - epoch_us(max(ts)) // 1000000 AS age_seconds FROM events GROUP BY event_type""")
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Last arrival per source and whether it is older than 26 hours at a given time."""
    return controls.freshness(t.table(spark, folder, "events").withColumnRenamed("event_type", "source"), "source", "ts", dt.datetime(2024, 1, 31))
