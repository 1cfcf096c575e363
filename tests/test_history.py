"""The block-wise history against a plain fold over random events."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tidemark.operators import history

EVENTS = (
    "lsn long, commit_ts timestamp_ntz, op string, client_id string, payload_hash string, "
    "before map<string,string>, after map<string,string>"
)
DIM = (
    "client_id string, risk_category string, account_status string, valid_from timestamp_ntz, "
    "valid_to timestamp_ntz, is_current boolean, is_deleted boolean, deleted_at timestamp_ntz"
)
T0 = dt.datetime(2024, 1, 1)


def fold(base, events):
    """One event after the other, as a reader of the rules would do it by hand."""
    versions = [dict(v, new=False) for v in base]
    balances, outcomes = [], {}
    for e in sorted(events, key=lambda e: e[0]):
        lsn, ts, op, client, _, before, after = e
        mine = [v for v in versions if v["client_id"] == client]
        current = next((v for v in mine if v["is_current"]), None)
        before, after = before or {}, after or {}
        outcomes[lsn] = "APPLIED"
        if op == "insert" and mine:
            outcomes[lsn] = "RECONCILED"
        elif op == "insert":
            versions.append(dict(client_id=client, risk_category=after.get("risk_category", "medium"),
                                 account_status=after.get("account_status", "active"), valid_from=ts, valid_to=None,
                                 is_current=True, is_deleted=False, deleted_at=None, new=True, lsn=lsn))
        elif op == "update" and current:
            risk = after.get("risk_category", current["risk_category"])
            status = after.get("account_status", current["account_status"])
            if (risk, status) != (current["risk_category"], current["account_status"]):
                current.update(valid_to=ts, is_current=False)
                versions.append(dict(current, risk_category=risk, account_status=status, valid_from=ts, valid_to=None,
                                     is_current=True, is_deleted=False, deleted_at=None, new=True, lsn=lsn))
            if "account_balance_usd" in after:
                a, b = (Decimal(x["account_balance_usd"]) if x.get("account_balance_usd") else None for x in (after, before))
                if a != b:
                    balances.append((lsn, client, ts, a))
        elif op == "delete" and current:
            current.update(valid_to=ts, is_current=False, is_deleted=True, deleted_at=ts)
        elif op not in ("insert", "update", "delete"):
            outcomes[lsn] = "QUARANTINED"
    return versions, balances, outcomes


def random_case(seed, n=600, clients=25, hot=True):
    rng = random.Random(seed)
    base = []
    for c in range(clients):
        if rng.random() < 0.6:
            dead = rng.random() < 0.2
            base.append(dict(client_id=f"C{c}", risk_category=rng.choice("lmh"), account_status="active",
                             valid_from=dt.datetime(2023, 1, 1), valid_to=dt.datetime(2023, 6, 1) if dead else None,
                             is_current=not dead, is_deleted=dead, deleted_at=dt.datetime(2023, 6, 1) if dead else None))
    events, lsn = [], 0
    for i in range(n):
        lsn += rng.choice([1, 1, 1, 2, 7])
        client = "C0" if hot and rng.random() < 0.35 else f"C{rng.randrange(clients)}"
        op = rng.choices(["insert", "update", "delete", "merge"], [12, 80, 3, 3])[0]
        before, after = {}, {}
        if op in ("insert", "update"):
            if rng.random() < 0.5:
                after["risk_category"] = rng.choice(["l", "m", "h", None])
            if rng.random() < 0.3:
                after["account_status"] = rng.choice(["active", "review"])
            if rng.random() < 0.4:
                after["account_balance_usd"] = rng.choice(["1250.0", "1250.00", "9.5"])
                before["account_balance_usd"] = rng.choice(["1250.00", "9.50", None])
        events.append((lsn, T0 + dt.timedelta(minutes=lsn), op, client, f"h{lsn}", before or None,
                       None if op == "delete" else after))
    return base, events


@pytest.mark.parametrize("seed,block", [(1, 1 << 20), (2, 50), (3, 7), (4, 1)])
def test_history_equals_fold(spark, seed, block):
    base, events = random_case(seed)
    want_versions, want_balances, want_outcomes = fold(base, events)
    arrival = list(events)
    random.Random(seed).shuffle(arrival)
    dim = spark.createDataFrame([tuple(b[k] for k in (c.split()[0] for c in DIM.split(", "))) for b in base], DIM)
    got = history.apply_events(dim, spark.createDataFrame(arrival, EVENTS), block)

    starts = sorted((r.client_id, r.opened_by_lsn, r.risk_category, r.account_status, r.valid_from, r.valid_to,
                     r.is_current, r.is_deleted, r.deleted_at) for r in got.starts.collect())
    assert starts == sorted(
        (v["client_id"], v["lsn"], v["risk_category"], v["account_status"], v["valid_from"], v["valid_to"],
         v["is_current"], v["is_deleted"], v["deleted_at"]) for v in want_versions if v["new"])

    closed = history.close_current(dim, got.closures)
    key = lambda r: (r[0], str(r[3:]))
    assert sorted((tuple(r) for r in closed.collect()), key=key) == sorted(
        (tuple(v[c.split()[0]] for c in DIM.split(", ")) for v in want_versions if not v["new"]), key=key)
    assert sorted(tuple(r) for r in got.balances.collect()) == sorted(want_balances)
    assert {r.lsn: r.outcome for r in got.outcomes.collect()} == want_outcomes


def test_blocks_do_not_follow_the_distance_of_lsns(spark):
    """Events far apart in the log: one summary per block of events, not one per event."""
    events = [(k << 21, T0, "update", "hot", f"h{k}", None, {"risk_category": "low"}) for k in range(60)]
    narrow = history.narrow_events(spark.createDataFrame(events, EVENTS), 20)
    assert sorted((r.block, r["count"]) for r in narrow.groupBy("block").count().collect()) == [(0, 20), (1, 20), (2, 20)]
    assert history._block_summaries(narrow).count() == 3
