"""Row rules, dispositions and quarantine records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import row_digest, stable_id
from .keyed import lookup_join

# Reason codes, severities, outcomes.
CRITICAL, ERROR = "CRITICAL", "ERROR"
MALFORMED_NUMERIC, MALFORMED_DATE = "MALFORMED_NUMERIC", "MALFORMED_DATE"
NEGATIVE_AMOUNT, ORPHAN_CLIENT = "NEGATIVE_AMOUNT", "ORPHAN_CLIENT"
DUPLICATE_CONFLICT, UNSUPPORTED_OPERATION = "DUPLICATE_CONFLICT", "UNSUPPORTED_OPERATION"
STAGED, DUPLICATE = "STAGED", "DUPLICATE"
VENDOR_HASH_FIELDS = (
    "client_id", "deposit_date", "amount_usd", "payment_method", "currency_original",
    "exchange_rate", "status", "processing_days", "fee_usd",
)
KNOWN_STATUSES = ("completed", "pending", "failed")
KNOWN_METHODS = ("bank_transfer", "credit_card", "e_wallet")

#: column -> type of the numeric vendor fields
VENDOR_NUMBERS = {
    "amount_usd": "decimal(18,2)", "exchange_rate": "decimal(18,4)",
    "processing_days": "int", "fee_usd": "decimal(18,2)",
}


@dataclass(frozen=True)
class Rule:
    """A row fails the rule where ``failed`` is true. Null counts as passed."""

    reason: str
    severity: str
    retry: bool
    failed: Column


def first_failure(rules: Sequence[Rule]) -> Column:
    """A struct (reason, severity, retry) of the first failing rule, null if all pass."""
    verdict = F.lit(None).cast("struct<reason:string,severity:string,retry:boolean>")
    for rule in reversed(rules):
        mark = F.struct(
            F.lit(rule.reason).alias("reason"), F.lit(rule.severity).alias("severity"), F.lit(rule.retry).alias("retry")
        )
        verdict = F.when(rule.failed, mark).otherwise(verdict)
    return verdict


def type_vendor_rows(raw: DataFrame) -> DataFrame:
    """Typed copies ``t_*`` of the text columns; a value that does not parse becomes null and never fails the job."""
    typed = {f"t_{c}": F.col(c).try_cast(t) for c, t in VENDOR_NUMBERS.items()}
    typed["t_deposit_date"] = F.col("deposit_date").try_cast("date")
    return raw.withColumns(typed)


def vendor_rules() -> list[Rule]:
    """Rules that need nothing but the row, in the order in which they decide."""
    unparsed = [F.col(f"t_{c}").isNull() for c in VENDOR_NUMBERS]
    any_unparsed = unparsed[0]
    for test in unparsed[1:]:
        any_unparsed = any_unparsed | test
    return [
        Rule(MALFORMED_NUMERIC, CRITICAL, False, any_unparsed),
        Rule(MALFORMED_DATE, CRITICAL, False, F.col("t_deposit_date").isNull()),
        Rule(NEGATIVE_AMOUNT, CRITICAL, False, F.col("t_amount_usd") < 0),
    ]


def typed_vendor_columns(df: DataFrame) -> DataFrame:
    """Replace the text columns by their typed copies."""
    names = [c[2:] for c in df.columns if c.startswith("t_")]
    return df.drop(*names).withColumnsRenamed({f"t_{c}": c for c in names})


def judge_vendor_rows(
    raw: DataFrame, current_clients: DataFrame, staged: DataFrame | None = None, hold: Callable[[DataFrame, str], DataFrame] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every landed vendor row with its ``disposition``: STAGED, DUPLICATE or a quarantine reason.

    ``raw`` holds the text columns plus file_name and row_num, ``current_clients`` client_id (unique) and
    client_sk, ``staged`` deposit_id and row_hash accepted by earlier batches.
    The first valid row of a deposit wins; rows that fail a rule never compete. The winner is found by an
    aggregate and joined back, so copies of one deposit are combined before they are shuffled. Typed, looked-up and
    hashed rows are read twice for that; ``hold``, e.g. ``session.written``, keeps them instead. A caller that needs
    few columns names them in ``keep``: beside them only deposit_id, file_name, row_num, row_hash, verdict and disposition
    come back, and are held and shuffled.
    """
    typed = type_vendor_rows(raw).withColumn("verdict", first_failure(vendor_rules()))
    clients = current_clients.select("client_id", "client_sk")
    seen = lookup_join(typed, clients, ["client_id"]).withColumn(
        "verdict",
        F.coalesce("verdict", first_failure([Rule(ORPHAN_CLIENT, ERROR, True, F.col("client_sk").isNull())])),
    )
    canonical = seen.drop(*VENDOR_NUMBERS, "deposit_date").withColumnsRenamed(
        {f"t_{c}": c for c in [*VENDOR_NUMBERS, "deposit_date"]}
    )
    # as bytes, half as long as the text, until all rows are where they belong
    hashed = canonical.withColumn("row_hash", F.unhex(row_digest(canonical, VENDOR_HASH_FIELDS)))
    if keep is not None:
        kept = {*keep, "deposit_id", "file_name", "row_num", "row_hash", "verdict"}
        hashed = hashed.select(*[c for c in hashed.columns if c in kept])
    if staged is not None:  # only the deposits that came again matter
        staged = staged.join(raw.select("deposit_id").distinct(), "deposit_id", "left_semi")
    return _settle_duplicates(hold(hashed, "hashed") if hold else hashed, staged)


def _settle_duplicates(rows: DataFrame, staged: DataFrame | None) -> DataFrame:
    place = F.struct("file_name", "row_num")
    entrants = rows.where(F.col("verdict").isNull()).select("deposit_id", F.struct(
        F.lit(1).alias("rank"), place.alias("place"), F.col("row_hash").alias("hash")).alias("entry"))
    if staged is not None:
        nowhere = F.struct(F.lit("").alias("file_name"), F.lit(0).cast("long").alias("row_num"))
        entrants = entrants.unionByName(staged.select("deposit_id", F.struct(
            F.lit(0).alias("rank"), nowhere.alias("place"), F.unhex("row_hash").alias("hash")).alias("entry")))
    winners = entrants.groupBy("deposit_id").agg(F.min("entry").alias("winner"), F.count("*").alias("n"))
    contested = winners.where("n > 1 or winner.rank = 0").drop("n")  # who is alone has won and need not be told
    judged = lookup_join(rows, contested, ["deposit_id"])
    won = F.when(F.col("winner").isNull(), F.col("deposit_id").isNotNull()).otherwise(
        (F.col("winner.rank") == 1) & (F.col("winner.place") == place))
    conflict = first_failure([Rule(DUPLICATE_CONFLICT, ERROR, False, F.col("winner.hash") != F.col("row_hash"))])
    verdict = F.coalesce("verdict", F.when(~won, conflict))
    return (
        judged.withColumn("verdict", verdict)
        .withColumn("disposition", F.coalesce(F.col("verdict.reason"), F.when(won, STAGED).otherwise(DUPLICATE)))
        .withColumn("row_hash", F.lower(F.hex("row_hash")))
        .drop("winner")
    )


def contract_rules() -> list[Rule]:
    """The row contract beyond the vendor rules: ids filled, status and method from the known lists."""
    blank = (F.trim(F.coalesce("deposit_id", F.lit(""))) == "") | (F.trim(F.coalesce("client_id", F.lit(""))) == "")
    return [
        Rule("BLANK_ID", ERROR, False, blank),
        Rule("UNKNOWN_STATUS", ERROR, False, ~F.coalesce("status", F.lit("")).isin(*KNOWN_STATUSES)),
        Rule("UNKNOWN_METHOD", ERROR, False, ~F.coalesce("payment_method", F.lit("")).isin(*KNOWN_METHODS)),
    ]


def quarantine_records(
    failed: DataFrame, source_system: str, identifier: Column, record_id: Column, occurrence: Column,
    payload: Column, batch_id: Column, at: Column, verdict: str = "verdict",
) -> DataFrame:
    """Quarantine rows for ``failed``. The id depends on the delivered row only, so a rerun repeats it."""
    reason = F.col(f"{verdict}.reason")
    return failed.select(
        stable_id(F.lit(source_system), identifier, occurrence, reason).alias("quarantine_id"),
        F.lit(source_system).alias("source_system"),
        identifier.alias("source_identifier"),
        record_id.cast("string").alias("record_id"),
        batch_id.alias("batch_id"),
        payload.alias("raw_payload"),
        reason.alias("reason_code"),
        F.col(f"{verdict}.severity").alias("severity"),
        at.alias("quarantined_at"),
        F.lit(False).alias("is_resolved"),
        F.col(f"{verdict}.retry").alias("retry_eligible"),
    )


def waiting_rows(raw: DataFrame, quarantine: DataFrame, current_clients: DataFrame) -> DataFrame:
    """Landed vendor rows, with their ``quarantine_id``, that wait for a client who is there now.

    The client is named in the record's payload, so that only records with a chance are looked up. A row is found by the
    id of its record, which depends on the row alone; ids meet as bytes, as all of ``raw`` may have to be shuffled by them.
    """
    waiting = quarantine.where((F.col("source_system") == "vendor") & (F.col("reason_code") == ORPHAN_CLIENT) & F.col("retry_eligible") & ~F.col("is_resolved"))
    named = waiting.select("quarantine_id", F.get_json_object("raw_payload", "$.client_id").alias("client_id"))
    ready = lookup_join(named, current_clients.select("client_id"), ["client_id"], "left_semi").select(F.unhex("quarantine_id").alias("quarantine_id"))
    record = stable_id(F.lit("vendor"), F.col("file_name"), F.concat_ws(":", "file_hash", "row_num"), F.lit(ORPHAN_CLIENT))
    found = raw.withColumn("quarantine_id", F.unhex(record)).join(ready, "quarantine_id", "left_semi")
    return found.withColumn("quarantine_id", F.lower(F.hex("quarantine_id")))


def resolved(quarantine: DataFrame, settled: DataFrame) -> DataFrame:
    """The quarantine rows of ``settled`` (their ids) as they are once the retry has dealt with them."""
    done = quarantine.join(settled.select("quarantine_id").distinct(), "quarantine_id", "left_semi")
    return done.withColumns({"is_resolved": F.lit(True), "retry_eligible": F.lit(False)})


def validity(judged: DataFrame, by: Sequence[str], target: float = 0.99) -> DataFrame:
    """Share of rows that no rule rejects, per group, and whether it reaches the target."""
    ratio = F.avg(F.when(F.col("verdict").isNull(), 1.0).otherwise(0.0))
    shares = judged.groupBy(*by).agg(ratio.alias("ratio"))
    return shares.select(*by, F.round("ratio", 6).alias("valid_ratio"), (F.col("ratio") >= target).alias("within_target"))


def row_accounting(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Landed, staged, quarantined and duplicate rows in one pass, and whether they add up."""
    is_staged, is_copy = F.col("disposition") == STAGED, F.col("disposition") == DUPLICATE
    counts = judged.groupBy(*by).agg(
        F.count("*").alias("rows_landed"),
        F.count_if(is_staged).alias("rows_staged"),
        F.count_if(F.col("verdict").isNotNull()).alias("rows_quarantined"),
        F.count_if(is_copy).alias("duplicates_skipped"),
    )
    total = F.col("rows_staged") + F.col("rows_quarantined") + F.col("duplicates_skipped")
    return counts.withColumn("balanced", F.col("rows_landed") == total)
