"""Many alike rows, and texts read in one pass: what is found does not change, and work does not grow with the copies."""

import datetime as dt

from ledgerloom.functions import dates, labels, money
from ledgerloom.operators import cards
from ledgerloom.sources import exports


def _sides(spark, copies):
    at = dt.datetime(2024, 3, 5, 10)
    main = [(100 * i + j, at + dt.timedelta(minutes=j), 500, "debit", "Ann") for i in range(copies) for j in (0,)]
    others = [(1000 * i + j, at + dt.timedelta(minutes=1 + j), 500, "debit", "ann", "sends") for i in range(copies - 4) for j in (0, 1)]
    return spark.createDataFrame(main, "id long, ts timestamp_ntz, cents long, direction string, payee string"), spark.createDataFrame(others, "id long, ts timestamp_ntz, cents long, direction string, payee string, source string")


def _by_hand(main, others):
    taken, out = set(), {}
    for o in sorted(others, key=lambda r: (r["ts"], r["id"])):
        apart = lambda e, o=o: (abs((e["ts"] - o["ts"]).total_seconds()), e["id"])
        near = sorted((e for e in main if e["id"] not in taken and apart(e)[0] <= 300), key=apart)
        out[o["id"]] = near[0]["id"] if near else None
        taken |= {e["id"] for e in near[:1]}
    return out


def test_copies_of_a_payment_are_merged_as_runs(spark, monkeypatch):
    main, others = _sides(spark, 12)
    written, whole = [], cards.cut
    monkeypatch.setattr(cards, "cut", lambda df: written.append(1) or whole(df))
    got = {r["other"]: r["entry"] for r in exports.merged(main, others).collect()}
    assert got == _by_hand(main.collect(), others.collect())
    # Each round is written: one for each copy would be some fifty.
    assert len(written) <= 20


def test_entries_of_two_times_equally_near_are_taken_by_id(spark):
    at = dt.datetime(2024, 3, 5, 10)
    schema = "id long, ts timestamp_ntz, cents long, direction string, payee string"
    main = spark.createDataFrame([(i, at + dt.timedelta(minutes=2 * (i % 2)), 500, "debit", "Ann" if i % 3 else "ann") for i in range(9)], schema)
    others = spark.createDataFrame([(i, at + dt.timedelta(minutes=1), 500, "debit", "ann", "sends") for i in range(10)], schema + ", source string")
    assert {r["other"]: r["entry"] for r in exports.merged(main, others).collect()} == {**{i: i for i in range(9)}, 9: None}


def test_texts_are_told_apart_in_one_pass(spark):
    texts = {"12.00": 1200, "(1,234.5)": -123450, "₹ -7": -700, "Rs. 3.10 Dr": 310, "+4.00 cr.": -400, "4.00 x": None, "": None, "\x011\x01": None, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(money.signed_cents("t").alias("c"))
    assert [r["c"] for r in got.collect()] == list(texts.values())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 1
    masks = {"HDFC Bank 001234": "XX1234", "visa 12 x 9": "XXXX9", "Bank 12": "Bank 12", "upi lite 7": "UPI Lite", " ": None}
    assert [r["m"] for r in spark.createDataFrame([(t,) for t in masks], "t string").select(labels.method_mask("t").alias("m")).collect()] == list(masks.values())
    assert dates.shape_of("dd MMM yyyy") == "^[-+0-9]+ [A-Za-z]+ [-+0-9]+$"
    times = ["September 5, 2024, 9:05 PM GMT+1", "5 Sept 2024, 21:05:00 IST", "2024-09-05 21:05", "1700000000", "5 Mar 2024, "]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in times], "t string").select(labels.read_time("t").alias("t")).collect()]
    assert got == [dt.datetime(2024, 9, 6, 1, 35), dt.datetime(2024, 9, 5, 21, 5), dt.datetime(2024, 9, 5, 21, 5), dt.datetime(2023, 11, 15, 3, 43, 20), dt.datetime(2024, 3, 5)]
