"""What a batch writes, boundaries per client, retries, points in time, comparisons and the report."""

import datetime as dt
import json
import os
import random
import shutil

import deliveries
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, compare, history, replay
from tidemark.plans import ingest
from tidemark.plans.publish import Warehouse, bucket_of
from tidemark.streaming import changes as streaming
from test_history import DIM, EVENTS, T0, fold, random_case

BUCKETED = ("dim_client", "fact_client_balance_history", "cdc_processing_ledger")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("deliveries") / "in")
    deliveries.write(path)
    return path


@pytest.fixture(scope="module")
def first_run(spark, folder, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse") / "first")
    ingest.run(spark, root, folder, "batch-1", buckets=8)
    return root


@pytest.fixture
def copy_of(first_run, tmp_path):
    root = str(tmp_path / "copy")
    shutil.copytree(first_run, root)
    return root


@pytest.fixture
def inbox(folder, tmp_path):
    path = str(tmp_path / "in")
    shutil.copytree(folder, path)
    return path


def changes_of(spark, root, batch_id):
    rows = Warehouse(spark, root)._publications().where(F.col("batch_id") == batch_id).select(F.explode("changes").alias("c")).select("c.*").collect()
    return {(r.table_name, r.bucket) for r in rows if r.table_name in BUCKETED}


def buckets_of(spark, clients, n=8):
    return {r.b for r in spark.createDataFrame([(c,) for c in clients], "c string").select(bucket_of("c", n).alias("b")).collect()}


def test_a_batch_of_one_client_writes_one_bucket(spark, copy_of, inbox):
    before = {t: {tuple(p) for p in ps} for t, ps in Warehouse(spark, copy_of).latest()[1].items()}
    later = deliveries.event(530, 25, 9, "update", 7, deliveries.image("low", 1.0), deliveries.image("high", 2.0))
    deliveries.write_feed(inbox, [*deliveries.events(), later])
    report = ingest.run(spark, copy_of, inbox, "one-client")
    (bucket,) = buckets_of(spark, [deliveries.client(7)])
    assert {b for _, b in changes_of(spark, copy_of, "one-client")} == {bucket}
    after = {t: {tuple(p) for p in ps} for t, ps in Warehouse(spark, copy_of).latest()[1].items()}
    gone = {(t, p) for t in BUCKETED for p in before[t] - after[t]}
    assert {t for t, _ in gone} == {"dim_client"} and {p[1] for _, p in gone} == {bucket}
    # rewritten: the versions of the bucket's clients, and one more
    dim = Warehouse(spark, copy_of).read("dim_client")
    assert report["rows_written"]["dim_client"] == dim.where(bucket_of("client_id", 8) == bucket).count()
    assert report["rows_written"]["cdc_processing_ledger"] == report["rows_written"]["fact_client_balance_history"] == 1
    assert dim.groupBy("client_sk").count().where("count > 1").isEmpty() and dim.agg(F.max("client_sk")).first()[0] == 37


def test_a_late_client_rewrites_its_own_bucket_only(spark, copy_of, inbox):
    late = deliveries.event(502, 13, 9, "update", 1, deliveries.image("medium", 1250.0), deliveries.image("medium", 1240.0))
    other = deliveries.event(540, 28, 9, "update", 2, deliveries.image("high", 9200.0), deliveries.image("low", 9300.0))
    deliveries.write_feed(inbox, [*deliveries.events(), late, other])
    warehouse = Warehouse(spark, copy_of)
    before = warehouse.latest()[1]
    ingest.run(spark, copy_of, inbox, "late")
    after = warehouse.latest()[1]
    (behind,), hit = buckets_of(spark, ["K001"]), buckets_of(spark, ["K001", "K002"])
    assert {p.bucket for p in set(before["cdc_processing_ledger"]) - set(after["cdc_processing_ledger"])} == {behind}
    assert {p.bucket for p in set(before["dim_client"]) - set(after["dim_client"])} == hit
    assert sorted(r.lsn for r in warehouse.read("fact_client_balance_history").where("client_id = 'K001'").collect()) == [502, 505]
    assert warehouse.read("cdc_processing_ledger").count() == 14


def test_number_of_buckets_stays(spark, copy_of):
    assert Warehouse(spark, copy_of, buckets=99).begin("again").buckets == 8


def test_strangers_and_emptied_buckets(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"), buckets=4)
    rows = spark.createDataFrame([(i, f"c{i}", "h") for i in range(20)], "lsn long, client_id string, payload_hash string")
    batch = warehouse.begin("one")
    batch.append("cdc_processing_ledger", rows)
    batch.publish()
    batch = warehouse.begin("two")
    mine = rows.where(bucket_of("client_id", 4) == 2)
    with pytest.raises(ValueError, match="not part of what is replaced"):
        warehouse.begin("wrong").replace_buckets("cdc_processing_ledger", rows, [2])
    batch.replace_buckets("cdc_processing_ledger", mine.limit(0), [2])
    batch.publish()
    left = {r.client_id for r in warehouse.read("cdc_processing_ledger").collect()}
    assert left == {r.client_id for r in rows.where(bucket_of("client_id", 4) != 2).collect()} and mine.count() > 0


def test_an_older_table_is_given_buckets(spark, tmp_path):
    """Parts without a bucket, as an older version wrote them: rewritten once, then handled by bucket."""
    warehouse = Warehouse(spark, str(tmp_path / "w"), buckets=4)
    rows = spark.createDataFrame([(i, f"c{i}", "h") for i in range(20)], "lsn long, client_id string, payload_hash string")
    from tidemark.plans.publish import Part
    from tidemark.schemas import conform

    conform(rows, "cdc_processing_ledger").write.parquet(f"{warehouse.root}/cdc_processing_ledger/old")
    batch = warehouse.begin("old")
    batch.parts["cdc_processing_ledger"] = batch.added["cdc_processing_ledger"] = [Part("old")]
    batch.publish()
    assert warehouse.read("cdc_processing_ledger").count() == 20
    batch = warehouse.begin("new")
    some = batch.table("cdc_processing_ledger", [1])
    batch.replace_buckets("cdc_processing_ledger", some.limit(0), [1])
    batch.publish()
    assert warehouse.read("cdc_processing_ledger").count() == rows.where(bucket_of("client_id", 4) != 1).count()


def test_stream_leaves_nothing_and_numbers_lines(spark, copy_of, tmp_path):
    from tidemark.session import shared_folder

    at = os.path.join(shared_folder(spark).removeprefix("file://"), "tidemark")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    source = str(tmp_path / "feed")
    os.makedirs(source)
    for k, (lsn, who) in enumerate(((550, 3), (551, 4))):
        rows = [deliveries.event(lsn + 10 * j, 26, 9 + j, "update", who, deliveries.image("low", 1.0), deliveries.image("high", 2.0 + j)) for j in (0, 1)]
        with open(f"{source}/{k}.jsonl", "w") as out:
            out.write("\n".join(map(json.dumps, rows)) + "\n")
    streaming.start(spark, source, copy_of, str(tmp_path / "checkpoint"), max_files=1).awaitTermination()
    raw = Warehouse(spark, copy_of).read("raw_cdc_events").where("lsn >= 550").collect()
    assert sorted((r.lsn, r.arrival_sequence) for r in raw) == [(550, 1), (551, 1), (560, 2), (561, 2)]
    assert (set(os.listdir(at)) if os.path.isdir(at) else set()) <= before


# --- boundaries


@pytest.mark.parametrize("seed", [1, 2])
def test_late_events_of_different_age(spark, seed):
    """The rest of a random feed arrives late, for each client from another point on; the end is that of the feed in order."""
    base, events = random_case(seed, n=300, clients=12)
    rng = random.Random(seed)
    late_from = {f"c{c}": rng.randint(0, 300) for c in range(40)}
    first = [e for k, e in enumerate(events) if rng.random() < 0.7 or k < late_from.get(e[3], 100)]
    second = [e for e in events if e not in first]
    frame = lambda rows: spark.createDataFrame(rows, EVENTS)
    columns = ["client_id", "risk_category", "account_status", "valid_from", "valid_to", "is_current", "is_deleted", "deleted_at"]
    dim = spark.createDataFrame([tuple(v[c] for c in columns) for v in base], DIM).withColumn("opened_by_lsn", F.lit(None).cast("long"))

    def applied(old, rows):
        done = history.apply_events(old, rows)
        return history.close_current(old, done.closures).select(*columns, "opened_by_lsn").unionByName(done.starts.select(*columns, "opened_by_lsn"))

    before = applied(dim, frame(first)).cache()
    late = replay.late_clients(frame(second), frame(first))
    boundaries = replay.late_boundaries(frame(events), late).cache()
    again = replay.events_to_rebuild(frame(events), boundaries)
    others = frame(second).join(boundaries, "client_id", "left_anti")
    rebuilt = replay.base_at(before, boundaries).cache()
    got = applied(rebuilt, again.unionByName(others))
    want = [tuple(v[c] for c in columns) for v in fold(base, events)[0]]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)
    # nothing in front of a client's own boundary is applied again
    starts = {r.client_id: r.from_ts for r in boundaries.collect()}
    tails = {e[0] for e in events if e[3] in starts and e[1] >= starts[e[3]]}
    assert {r.lsn for r in again.collect()} == tails and len(tails) < len(events)


# --- retry


def test_waiting_rows_are_tried_again(spark, copy_of, inbox):
    """The client of an orphan row comes: the row becomes a fact, its record is resolved, its file's counts follow."""
    for name, rows in (("client_signup", deliveries.signup()), ("client_profile", deliveries.profile())):
        with open(f"{inbox}/{name}.json", "w") as out:
            json.dump([*rows, rows[-1] | {"client_id": "K099"}], out)
    report = ingest.run(spark, copy_of, inbox, "retry")
    assert report["retried"] == {"rows_retried": 1, "rows_resolved": 1}
    read = Warehouse(spark, copy_of).read
    fact = read("fact_deposit").where("deposit_id = 'V020'").collect()
    assert [(r.client_id, r.source_system, r.batch_id) for r in fact] == [("K099", "vendor", "retry")] and fact[0].client_sk == 37
    held = {r.record_id: (r.is_resolved, r.retry_eligible) for r in read("quarantine").collect()}
    assert held == {"V001": (False, False), "V020": (True, False)}
    files = {r.file_name: (r.row_count_landed, r.row_count_staged, r.row_count_quarantined) for r in read("ingestion_file_manifest").where("source = 'vendor'").collect()}
    assert files["deposits_vendor_20240303.csv"] == (6, 6, 0) and files["deposits_vendor_20240301.csv"] == (9, 8, 1)
    assert read("ingestion_file_manifest").count() == 9  # the two snapshots came with other content
    again = ingest.run(spark, copy_of, inbox, "retry-2")
    assert again["retried"] == {"rows_retried": 0, "rows_resolved": 0}
    assert read("fact_deposit").where("deposit_id = 'V020'").count() == 1


def test_opening_balances_start_the_history(spark, folder, tmp_path):
    root = str(tmp_path / "w")
    ingest.run(spark, root, folder, "b", opening=True, buckets=4)
    balances = Warehouse(spark, root).read("fact_client_balance_history")
    assert balances.where("lsn is null").count() == 30 and balances.where("lsn is not null").count() == 5
    from tidemark.plans import replay as replays

    replays.replay_window(spark, root, "2023-12-01", "2024-12-31")
    assert Warehouse(spark, root).read("fact_client_balance_history").where("lsn is null").count() == 30


# --- report


def test_report_of_a_run(spark, first_run, copy_of):
    found = {(r.section, r.name, r.detail): r.found for r in ingest.run_report(Warehouse(spark, first_run), dt.datetime(2100, 1, 1)).collect()}
    tables = {name: n for (section, name, _), n in found.items() if section == "tables"}
    assert tables == {"dim_client": 36, "fact_deposit": 40, "fact_trade": 20, "fact_client_balance_history": 5,
                      "quarantine": 2, "ingestion_file_manifest": 7, "cdc_processing_ledger": 12}
    assert {k[1:]: n for k, n in found.items() if k[0] == "quarantine"} == {
        ("NEGATIVE_AMOUNT", "CRITICAL"): 1, ("ORPHAN_CLIENT", "ERROR"): 1, ("resolved", ""): 0}
    assert {k[1:]: n for k, n in found.items() if k[0] == "deposits" and k[2]} == {
        ("warehouse", "CANONICAL_WAREHOUSE"): 20, ("vendor", "CANONICAL_VENDOR"): 20}
    assert {n for k, n in found.items() if k[0] in ("history", "keys")} == {0}
    assert found["feed", "missing positions", ""] == 8 and found["files", "stale sources", ""] == 2
    assert found["files", "below 99 % valid rows", ""] == 2

    # an overlap that was planted shows
    batch = Warehouse(spark, copy_of).begin("broken")
    version = batch.table("dim_client").where("client_id = 'K003'").withColumn("client_sk", F.lit(99).cast("long"))
    batch.append("dim_client", version)
    batch.publish()
    found = {(r.section, r.name): r.found for r in ingest.run_report(Warehouse(spark, copy_of)).collect()}
    assert found["history", "overlapping versions"] == 1


# --- points in time


def test_as_of_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda n: T0 + dt.timedelta(days=n)
    states = [(rng.choice("aaaab"), day(rng.randint(0, 40)), k, rng.choice(["x", "y", None]), day(rng.randint(0, 60)) if rng.random() < 0.5 else None) for k in range(60)]
    states += [(None, day(1), 900, "n", None), ("a", None, 901, "n", None)]
    rows = [(rng.choice(["a", "a", "b", "c", None]), day(rng.randint(-3, 50)) if rng.random() < 0.95 else None, k) for k in range(400)]
    s = spark.createDataFrame(states, "who string, since timestamp_ntz, no int, state string, ended timestamp_ntz")
    r = spark.createDataFrame(rows, "who string, at timestamp_ntz, id int")

    def by_hand(who, at, until):
        mine = [x for x in states if who is not None and at is not None and x[0] == who and x[1] is not None and x[1] <= at]
        if not mine:
            return None, None
        last = max(mine, key=lambda x: (x[1], x[2]))
        return (None, None) if until and last[4] is not None and last[4] <= at else (last[2], last[3])

    for until in (None, "ended"):
        got = asof.as_of(r, s, "who", "at", "since", ["no", "state"], ["no"], until=until).collect()
        assert sorted((x.id, x.no, x.state) for x in got) == sorted((i, *by_hand(w, a, until)) for w, a, i in rows) or [
            x for x in got if (x.no, x.state) != by_hand(x.who, x["at"], until)] == []
        assert len(got) == len(rows)
    assert asof.as_of(r.limit(0), s, "who", "at", "since", ["no"], ["no"]).count() == 0
    assert asof.as_of(r, s.limit(0), "who", "at", "since", ["no"], ["no"]).where("no is not null").count() == 0


def test_as_of_with_a_hot_key(spark):
    """One key with all rows: no part, and so no task of the windows, holds more than a share of them."""
    n, parts = 40000, 16
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = spark.range(n).selectExpr("'hot' as who", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as at", "id")
        states = base.where("id % 100 = 0").select("who", F.col("at").alias("since"), F.col("id").alias("no"))
        from tidemark.operators.numbering import in_order

        sizes = [r["count"] for r in in_order(base.select("who", "at"), ["who", "at"]).groupBy("_part").count().collect()]
        assert max(sizes) < 4 * n / parts
        wrong = asof.as_of(base, states, "who", "at", "since", ["no"], ["no"]).where("no <> id - id % 100 or no is null")
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# --- comparison


def test_compare_finds_what_differs(spark):
    rows = [(i, f"c{i % 7}", None if i % 5 else "x", {"k": str(i), "a": None}) for i in range(50)] + [(1, "c1", "x", None)] * 3
    schema = "n int, who string, note string, image map<string,string>"
    before = spark.createDataFrame(rows, schema)
    bucket = F.pmod(F.hash("who"), F.lit(4))
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema).select("image", "note", "n", "who")
    assert compare.compared_buckets(before, shuffled, bucket).where("not equal").isEmpty()
    assert compare.differing_rows(before, shuffled, bucket).isEmpty()
    changed = rows[:10] + [(10, "c3", "", {"k": "10", "a": None})] + rows[11:-1]  # a null became empty, a repeated row is there once less
    after = spark.createDataFrame(changed, schema)
    found = sorted((r.side, r.n, r.times) for r in compare.differing_rows(before, after, bucket).collect())
    assert found == [("added", 10, 1), ("lost", 1, 1), ("lost", 10, 1)]
    assert compare.compared_buckets(before, after.limit(0), bucket).where("equal or rows_after > 0").isEmpty()


# --- pruning


def test_a_filter_on_the_calendar_prunes_months(spark, first_run):
    """Only the folder of the month that the calendar names is read."""
    from tidemark.plans import analytics

    warehouse = Warehouse(spark, first_run)
    deposits = warehouse.read("fact_deposit")
    assert {r.period for r in deposits.select("period").distinct().collect()} == {"2024-02", "2024-03"}
    days = warehouse.read("dim_date").where("month = 3 and day <= 15")
    result = analytics.deposits_in(deposits, days)
    got = {(r.period, r.source_system): r.deposits for r in result.collect()}
    want = deposits.where("status = 'completed' and deposit_date between '2024-03-01' and '2024-03-15'").groupBy("period", "source_system").count().collect()
    assert got == {(r.period, r.source_system): r["count"] for r in want} and got
    plan = result._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    (scan,) = [s.metrics() for s in _scans(plan) if s.metrics().contains("staticFilesNum")]
    assert scan.apply("numPartitions").value() == 1 and scan.apply("staticFilesNum").value() == 3  # two months of one part, one of the other


def _scans(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _scans(plan.plan())
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        return [plan]
    return [s for k in range(plan.children().size()) for s in _scans(plan.children().apply(k))]

