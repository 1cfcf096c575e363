"""Whole runs over small deliveries."""

import datetime as dt
import json
import os
import shutil
from decimal import Decimal

import deliveries
import pytest

from tidemark.operators import checks, keyed
from tidemark.plans import analytics, ingest, replay
from tidemark.plans.publish import Overtaken, Warehouse
from tidemark.session import shared_folder
from tidemark.sources.changes import ConflictingEvents
from tidemark.sources.vendor import SchemaDrift

STATE = ("client_sk", "client_id", "risk_category", "account_status", "valid_from", "valid_to", "is_current", "is_deleted", "deleted_at")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("deliveries") / "in")
    deliveries.write(path)
    return path


@pytest.fixture(scope="module")
def first_run(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse") / "first")
    return root, ingest.run(spark, root, folder, "batch-1", buckets=4)


@pytest.fixture
def copy_of(first_run, tmp_path):
    """A private copy of the warehouse after the first run."""
    root = str(tmp_path / "copy")
    shutil.copytree(first_run[0], root)
    return root


def counts(spark, root):
    return {r.table_name: r.rows for r in ingest.run_summary(Warehouse(spark, root)).collect()}


def state(spark, root):
    return sorted(tuple(map(str, r)) for r in Warehouse(spark, root).read("dim_client").select(*STATE).collect())


EXPECTED = {
    "dim_client": 36, "fact_deposit": 40, "fact_trade": 20, "fact_client_balance_history": 5,
    "quarantine": 2, "ingestion_file_manifest": 7, "cdc_processing_ledger": 12,
}


def test_first_run(spark, first_run):
    root, report = first_run
    assert counts(spark, root) == EXPECTED
    assert report["vendor"] | {"drift_warnings": 0} == {
        "files_seen": 3, "files_processed": 3, "files_skipped": 0, "rows_landed": 24, "rows_staged": 20,
        "rows_quarantined": 2, "duplicates_skipped": 2, "drift_warnings": 0, "files_overlooked": []}
    assert len(report["vendor"]["drift_warnings"]) == 1
    assert report["changes"] == {"events_seen": 12, "applied": 11, "reconciled": 1, "quarantined": 0, "skipped": 0}
    assert report["core"] == {"client_signup": 30, "client_profile": 30, "client_deposit": 20, "client_trades": 20}


def test_contents(spark, first_run):
    read = Warehouse(spark, first_run[0]).read
    dim, deposits = read("dim_client"), read("fact_deposit")
    # log order, not arrival order
    mine = dim.where("client_id = 'K001'").orderBy("valid_from").collect()
    assert [(v.risk_category, v.account_status, v.is_current) for v in mine] == [
        ("medium", "active", False), ("high", "active", False), ("high", "under_review", True)]
    assert mine[1].valid_from == dt.datetime(2024, 11, 15, 10) and mine[1].valid_to == dt.datetime(2024, 11, 15, 14)
    assert [v.full_name for v in mine] == ["Person 1"] * 3
    # soft delete keeps the client and its facts
    gone = dim.where("client_id = 'K012'").collect()
    assert len(gone) == 1 and gone[0].is_deleted and gone[0].deleted_at == dt.datetime(2024, 11, 21, 14)
    assert deposits.where("client_id = 'K012'").count() == 2
    # inferred member, key density, key of the version current at load
    assert dim.where("client_id = 'K031'").first().is_inferred
    assert sorted(r.client_sk for r in dim.collect()) == list(range(1, 37))
    assert deposits.where("client_sk is null").count() == 0
    # alias, fallback, namespaces
    assert deposits.where("deposit_id = 'V010'").first().payment_method == "e_wallet"
    assert deposits.where("deposit_id = 'D012'").first().payment_method == "credit_card"
    assert {r.source_system: r.records for r in analytics.deposit_breakdown(deposits).collect()} == {"warehouse": 20, "vendor": 20}
    assert keyed.duplicate_keys(deposits, ["source_system", "deposit_id"]).isEmpty()
    # only real balance changes
    balances = read("fact_client_balance_history")
    assert sorted(r.lsn for r in balances.collect()) == [505, 508, 512, 515, 518]
    assert balances.where("lsn = 505").first().balance_usd == Decimal("1850.00")
    # quarantine
    held = {r.record_id: (r.reason_code, r.severity, r.retry_eligible, r.is_resolved) for r in read("quarantine").collect()}
    assert held == {"V001": ("NEGATIVE_AMOUNT", "CRITICAL", False, False), "V020": ("ORPHAN_CLIENT", "ERROR", True, False)}
    assert checks.overlapping_versions(dim).isEmpty()
    assert read("raw_vendor_deposit").where("deposit_id = 'V002'").count() == 2
    assert read("dim_date").count() == 366 and read("dim_instrument").count() == 5


def test_questions_answer(spark, first_run):
    read = Warehouse(spark, first_run[0]).read
    dim, deposits, trades, balances = (read(n) for n in ("dim_client", "fact_deposit", "fact_trade", "fact_client_balance_history"))
    assert analytics.client_value(dim, deposits, trades, balances).count() == 15
    assert not analytics.country_performance(dim, deposits, trades).isEmpty()
    assert analytics.instrument_performance(trades).count() == 5
    assert analytics.deposit_operations(deposits, read("quarantine")).count() == 4
    as_of = analytics.client_state_as_of(dim, balances, dt.datetime(2024, 11, 20, 12)).collect()
    assert [(r.client_id, r.account_status, r.latest_cdc_balance_usd) for r in as_of] == [
        ("K001", "under_review", Decimal("1850.00")), ("K014", "active", Decimal("9.00"))]
    masked = analytics.masked_clients(dim).where("client_id = 'K002'").first()
    assert (masked.full_name_masked, masked.email_masked, str(masked.birth_year)) == ("P***2", "k***@example.com", "1962-01-01")
    assert not {"full_name", "email", "assigned_manager", "promo_code"} & set(analytics.masked_clients(dim).columns)


def test_second_run_changes_nothing(spark, folder, copy_of):
    before = state(spark, copy_of)
    report = ingest.run(spark, copy_of, folder, "batch-2")
    assert counts(spark, copy_of) == EXPECTED
    assert state(spark, copy_of) == before
    assert report["changes"]["skipped"] == 12 and report["vendor"]["files_skipped"] == 3


def test_replay_is_deterministic(spark, copy_of):
    before = state(spark, copy_of)
    result = replay.replay_window(spark, copy_of, "2024-11-03", "2024-11-30")
    assert (result["replayed_events"], result["affected_clients"], result["status"]) == (11, 8, "SUCCESS")
    assert state(spark, copy_of) == before
    assert counts(spark, copy_of) == EXPECTED
    day = replay.replay_window(spark, copy_of, "2024-11-20", "2024-11-20", "one-day")
    assert day["affected_clients"] == 1  # the end day counts as a whole
    assert state(spark, copy_of) == before
    whole = replay.replay_window(spark, copy_of, "2023-12-01", "2024-12-31", "from-the-start")
    assert whole["status"] == "SUCCESS" and state(spark, copy_of) == before  # bootstrap and inferred versions stay
    assert replay.replay_window(spark, copy_of, "2023-01-01", "2023-01-02")["status"] == "NOOP"
    with pytest.raises(ValueError, match="must not be after"):
        replay.replay_window(spark, copy_of, "2024-12-01", "2024-11-01")


def test_later_and_late_events(spark, folder, copy_of, tmp_path):
    """A later event survives a replay of an earlier window; an event below the applied ones is put in its place."""
    later = dict(deliveries.event(521, 30, 9, "update", 1, deliveries.image("high", 1850.0), deliveries.image("low", 1900.0)))
    late = deliveries.event(507, 15, 16, "update", 1, deliveries.image("high", 1850.0), deliveries.image("medium", 1700.0, "closed"))
    feed = [*deliveries.events(), later]
    inbox = str(tmp_path / "in")
    shutil.copytree(folder, inbox)
    deliveries.write_feed(inbox, feed)
    ingest.run(spark, copy_of, inbox, "batch-later")
    replay.replay_window(spark, copy_of, "2024-11-01", "2024-11-20")
    current = Warehouse(spark, copy_of).read("dim_client").where("client_id = 'K001' and is_current").first()
    assert (current.risk_category, current.account_status, current.valid_from) == ("low", "active", dt.datetime(2024, 11, 30, 9))

    deliveries.write_feed(inbox, [*feed, late])
    report = ingest.run(spark, copy_of, inbox, "batch-late")
    assert report["changes"]["applied"] == 1 and report["changes"]["skipped"] == 13
    mine = Warehouse(spark, copy_of).read("dim_client").where("client_id = 'K001'").orderBy("valid_from").collect()
    assert [(v.risk_category, v.account_status) for v in mine] == [
        ("medium", "active"), ("high", "active"), ("high", "under_review"), ("medium", "closed"), ("low", "active")]
    assert [v.valid_to for v in mine[:-1]] == [v.valid_from for v in mine[1:]] and mine[-1].is_current
    ledger = Warehouse(spark, copy_of).read("cdc_processing_ledger")
    assert ledger.count() == 14 and keyed.duplicate_keys(ledger, ["lsn"]).isEmpty()
    balances = Warehouse(spark, copy_of).read("fact_client_balance_history")
    assert sorted(r.lsn for r in balances.where("client_id = 'K001'").collect()) == [505, 507, 521]


def test_placeholder_is_completed_on_arrival(spark, folder, copy_of, tmp_path):
    inbox = str(tmp_path / "in")
    shutil.copytree(folder, inbox)
    for name, rows in (("client_signup", deliveries.signup()), ("client_profile", deliveries.profile())):
        late = rows[-1] | {"client_id": "K031"} | ({"full_name": "Late Person"} if name == "client_profile" else {})
        with open(f"{inbox}/{name}.json", "w") as out:
            json.dump([*rows, late], out)  # the whole array on one line
    before = Warehouse(spark, copy_of).read("dim_client").where("client_id = 'K031'").first()
    report = ingest.run(spark, copy_of, inbox, "batch-31")
    assert report["core"]["client_signup"] == 31
    after = Warehouse(spark, copy_of).read("dim_client").where("client_id = 'K031'").collect()
    assert before.is_inferred and [(r.client_sk, r.full_name, r.is_inferred) for r in after] == [(before.client_sk, "Late Person", False)]
    assert counts(spark, copy_of)["dim_client"] == EXPECTED["dim_client"]


def test_second_writer_is_refused(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    first, second = warehouse.begin("one"), warehouse.begin("two")
    rows = spark.createDataFrame([(1, "X", "fx")], "instrument_sk long, instrument_name string, asset_class string")
    for batch in (first, second):
        batch.replace("dim_instrument", rows)
    first.publish()
    with pytest.raises(Overtaken):
        second.publish()
    assert warehouse.read("dim_instrument").count() == 1 and not warehouse.published("two")


def test_nothing_is_left_in_the_shared_folder(spark, folder, tmp_path):
    at = os.path.join(shared_folder(spark).removeprefix("file://"), "tidemark")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    ingest.run(spark, str(tmp_path / "w"), folder, "clean", buckets=4)
    assert set(os.listdir(at)) <= before


def test_failed_run_leaves_nothing(spark, folder, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "warehouse")
    shutil.copytree(folder, inbox)
    name = f"{inbox}/deposits_vendor_20240301.csv"
    text = open(name).read()
    with open(name, "w") as out:
        out.write(text.replace("fee_usd\n", "fee_usd,surprise\n", 1))
    with pytest.raises(SchemaDrift, match="Unapproved schema drift in deposits_vendor_20240301.csv.*surprise"):
        ingest.run(spark, root, inbox, "batch-bad")
    assert set(counts(spark, root).values()) == {0}
    os.remove(f"{inbox}/client_trades.json")
    with pytest.raises(FileNotFoundError, match="client_trades.json"):
        ingest.run(spark, root, inbox, "batch-missing")


def test_conflicting_event_fails(spark, folder, copy_of, tmp_path):
    inbox = str(tmp_path / "in")
    shutil.copytree(folder, inbox)
    deliveries.write_feed(inbox, [deliveries.event(505, 15, 11, "update", 1, None, deliveries.image("low", 1.0))])
    with pytest.raises(ConflictingEvents, match="505"):
        ingest.run(spark, copy_of, inbox, "batch-conflict")
    assert counts(spark, copy_of) == EXPECTED
