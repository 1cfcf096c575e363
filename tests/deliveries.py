"""Small deliveries made by rule: the files of one run, as a source system would drop them."""

import json
import os

COUNTRIES = ["Malaysia", "Singapore", "UAE", "Brazil", "Germany"]
INSTRUMENTS = ["Gold", "EUR/USD", "BTC/USD", "USD/JPY", "S&P500"]
HEADER = "deposit_id,client_id,deposit_date,amount_usd,payment_method,currency_original,exchange_rate,status,processing_days,fee_usd"


def client(i):
    return f"K{i:03d}"


def signup():
    return [dict(client_id=client(i), signup_date=f"2024-01-{i % 28 + 1:02d}", country=COUNTRIES[i % 5],
                 email=f"k{i}.person@example.com", kyc_status="approved", account_type="standard", referral_source="organic",
                 signup_platform="web", promo_code=None if i % 3 else "PROMO10", assigned_manager="M1") for i in range(1, 31)]


def profile():
    return [dict(client_id=client(i), full_name=f"Person {i}", date_of_birth=f"19{60 + i}-05-17", nationality=COUNTRIES[i % 5],
                 risk_category=["low", "medium", "high"][i % 3], account_balance_usd=1000.0 + i, account_status="active",
                 currency="USD", last_login_date=None, preferred_language="English") for i in range(1, 31)]


def deposits():
    rows = [dict(deposit_id=f"D{i:03d}", client_id=client(i if i < 20 else 31), deposit_date=f"2024-02-{i:02d}", amount_usd=100.0 * i,
                 payment_method="bank_transfer", currency_original="USD", exchange_rate=1.0, status="completed", processing_days=2,
                 fee_usd=1.5) for i in range(1, 21)]
    rows[11]["credit_card"] = "credit_card"  # the method under a wrong key
    del rows[11]["payment_method"]
    return rows


def trades():
    return [dict(trade_id=f"T{i:03d}", client_id=client(i), trade_date=f"2024-03-{i:02d}", instrument=INSTRUMENTS[i % 5], direction="buy",
                 volume_lots=0.5, open_price=1.25, close_price=1.5, pnl_usd=10.0 * i, trade_status="closed") for i in range(1, 21)]


def vendor_row(i, who=None, amount=None, day="2024-03-01"):
    return f"V{i:03d},{client(who or i)},{day},{amount or f'{i * 50}.00'},e_wallet,USD,1.00,completed,1,2.50"


def vendor_files():
    first = [vendor_row(1, amount="-250.00")] + [vendor_row(i) for i in range(2, 10)]
    second = [vendor_row(2), vendor_row(5)] + [vendor_row(i, day="2024-03-02") for i in range(10, 17)]
    third = [vendor_row(i, who=99 if i == 20 else None, day="2024-02-26") for i in range(17, 23)]
    return {
        "deposits_vendor_20240301.csv": [HEADER, *first],
        "deposits_vendor_20240302.csv": [HEADER.replace("payment_method", "method"), *second],
        "deposits_vendor_20240303.csv": [HEADER, *third],
    }


def event(lsn, day, hour, op, i, before=None, after=None):
    return dict(lsn=lsn, commit_ts=f"2024-11-{day:02d}T{hour:02d}:00:00Z", op=op, client_id=client(i), before=before, after=after)


def image(risk, balance, status="active"):
    return dict(risk_category=risk, account_balance_usd=balance, account_status=status)


def events():
    """Twelve events in arrival order, which is not log order. K001 starts with risk medium, K012 with low."""
    return [
        event(505, 15, 11, "update", 1, image("high", 1250.0), image("high", 1850.0)),
        event(509, 21, 10, "update", 14, image("high", 9.0), image("medium", 9.0)),
        event(501, 2, 8, "insert", 30, None, dict(full_name="Person 30", risk_category="low")),
        event(504, 15, 10, "update", 1, image("medium", 1250.0), image("high", 1250.0)),
        event(510, 21, 14, "delete", 12, image("low", 0.0), None),
        event(512, 22, 8, "update", 2, image("high", 8500.0), image("high", 9200.0)),
        event(503, 14, 9, "update", 9, image("low", 6700.0), image("medium", 6700.0)),
        event(515, 22, 15, "update", 19, image("medium", 78500.0), image("medium", 80000.0)),
        event(508, 20, 9, "update", 14, image("high", 5.0), image("high", 9.0)),
        event(518, 23, 9, "update", 22, image("medium", 1650.0), image("medium", 2100.0)),
        event(506, 15, 14, "update", 1, image("high", 1850.0), image("high", 1850.0, "under_review")),
        event(520, 23, 16, "update", 25, image("medium", 1.0), image("high", 1.0)),
    ]


def write(folder, feed=None):
    os.makedirs(folder, exist_ok=True)
    for name, rows in (("client_signup", signup()), ("client_profile", profile()), ("client_deposit", deposits()), ("client_trades", trades())):
        with open(f"{folder}/{name}.json", "w") as out:
            out.write("[\n" + ",\n".join("  " + json.dumps(r) for r in rows) + "\n]\n")
    for name, lines in vendor_files().items():
        with open(f"{folder}/{name}", "w") as out:
            out.write("\n".join(lines) + "\n")
    write_feed(folder, events() if feed is None else feed)


def write_feed(folder, feed):
    with open(f"{folder}/client_profile_changes.jsonl", "w") as out:
        out.write("\n\n".join(json.dumps(e) for e in feed) + "\n")
