"""Answers that take bills in, and the sides of bills' payments, on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.dates import Period
from ledgerloom.operators import counted as c
from ledgerloom.plans import estimated, sides
from ledgerloom.plans.ask import Query

DAY = dt.date.fromisoformat
MOVES = "id bigint, ts timestamp_ntz, day date, cents bigint, direction string, channel string, payee string, shop string, card string, category string, refund_of bigint"


def moves(spark, *rows):
    full = [(i, dt.datetime.combine(DAY(d), dt.time(12)), DAY(d), n, way, ch, "P", "S", card, cat, of) for i, d, n, way, ch, card, cat, of in rows]
    return spark.createDataFrame(full, MOVES)


@pytest.fixture(scope="module")
def rows(spark):
    return c.counted(moves(spark, (1, "2024-02-05", 10_000, "debit", "card", "A", "food.out", None), (2, "2024-03-05", 7_000, "debit", "upi", None, "travel", None))).cache()


@pytest.fixture(scope="module")
def bills(spark):
    """A of 31 days across January and February; B within March; C under half a unit; D covered by a statement."""
    data = [("A", "2024-01-16", "2024-02-15", 31_000, None), ("B", "2024-03-01", "2024-03-31", 5_000, None), ("C", "2024-02-01", "2024-02-10", 40, None), ("D", "2024-02-01", "2024-02-29", 9_000, "s1")]
    return spark.createDataFrame([(k, DAY(a), DAY(b), e, s) for k, a, b, e, s in data], "card string, cycle_first date, cycle_last date, estimate bigint, covered_by string").withColumn("bill", F.concat(F.lit("b"), "card"))


def one(df):
    return df.collect()[0].asDict()


def test_whole_months_count_and_cut_ones_are_told(rows, bills):
    q = Query(period=Period(DAY("2024-01-20"), DAY("2024-03-31")))
    assert one(estimated.total(rows, bills, q)) == {"amount": 170.0 + 150.0 + 50.0, "payments": 2, "estimated": 200.0, "cut_months": "2024-01", "in_bills_only": None}


def test_without_a_period_every_month_is_whole(rows, bills):
    assert one(estimated.total(rows, bills, Query())) == {"amount": 170.0 + 310.0 + 50.0, "payments": 2, "estimated": 360.0, "cut_months": "", "in_bills_only": None}


@pytest.mark.parametrize(("narrow", "amount", "est", "beside"), [
    ({"cards": ("A",)}, 250.0, 150.0, None), ({"cards": ("C",)}, 0.0, 0.0, None), ({"channel": "card"}, 300.0, 200.0, None), ({"channel": "upi"}, 70.0, 0.0, None),
    ({"categories": ("food",)}, 100.0, 0.0, 200.0), ({"payees": ("p",)}, 170.0, 0.0, 200.0), ({"money": "in"}, 0.0, 0.0, None),
])
def test_what_a_narrower_question_takes_of_bills(rows, bills, narrow, amount, est, beside):
    got = one(estimated.total(rows, bills, Query(period=Period(DAY("2024-02-01"), DAY("2024-03-31")), **narrow)))
    assert (got["amount"], got["estimated"], got["in_bills_only"]) == (amount, est, beside)


def test_nothing_on_file(rows, bills):
    got = one(estimated.total(rows.limit(0), bills.limit(0), Query(period=Period.year(2024))))
    assert got == {"amount": 0.0, "payments": 0, "estimated": 0.0, "cut_months": "", "in_bills_only": None}


def test_a_trend_shows_months_that_only_bills_reach(spark, rows, bills):
    got = {r["month"]: (r["amount"], r["payments"], r["estimated"]) for r in estimated.trend(spark, rows, bills, Query("trend", period=Period.year(2024))).collect()}
    assert got == {"2024-01": (160.0, 0, 160.0), "2024-02": (250.0, 1, 150.0), "2024-03": (120.0, 1, 50.0)}


def test_two_periods_each_by_its_own_whole_months(rows, bills):
    q = Query("compare", period=Period(DAY("2024-03-01"), DAY("2024-03-31")), other=Period(DAY("2024-02-01"), DAY("2024-02-14")))
    assert one(estimated.compared(rows, bills, q)) == {"now": 120.0, "before": 100.0, "difference": 20.0, "of_bills": 50.0}


def test_a_refund_follows_its_investment_aside(spark):
    m = moves(spark, (1, "2024-02-05", 900, "debit", "upi", None, "investments", None), (2, "2024-02-09", 100, "credit", "upi", None, "other", 1), (3, "2024-02-09", 50, "credit", "upi", None, "investments", 99), (4, "2024-02-09", 70, "credit", "upi", None, "investments", 5), (5, "2024-02-01", 80, "debit", "upi", None, "food", None))
    keep, aside = c.without_investments(c.counted(m))
    assert {r["id"] for r in aside.collect()} == {1, 2, 3} and {r["id"] for r in keep.collect()} == {4, 5}


PAY = "id bigint, ts timestamp_ntz, day date, cents bigint, direction string, channel string, card string, settles string"


def paying(spark, *rows):
    return spark.createDataFrame([(i, dt.datetime.combine(DAY(d), dt.time(9)), DAY(d), n, way, ch, card, s) for i, d, n, way, ch, card, s in rows], PAY)


@pytest.fixture(scope="module")
def paid(spark):
    """b1: the card's row is older than the row paid from; b2: two credits, no debit; b3: one row alone; and one of no bill."""
    return paying(spark, (1, "2024-01-02", 500, "credit", "card", "A", "b1"), (2, "2024-01-03", 480, "debit", "upi", None, "b1"), (3, "2024-01-05", 100, "credit", "card", "B", "b2"), (4, "2024-01-05", 100, "credit", "card", "B", "b2"),
                  (5, "2024-01-06", 300, "debit", "upi", None, "b3"), (6, "2024-01-07", 10, "debit", "upi", None, None))


def test_the_side_paid_from_is_first(paid):
    got = {r["settles"]: (r["sides"], r["first"], r["debit"] and r["debit"]["id"], r["credit"] and r["credit"]["id"]) for r in sides.bill_sides(paid).collect()}
    assert got == {"b1": (2, 2, 2, 1), "b2": (2, 3, None, 3)}


def test_a_side_is_folded_only_into_one_that_is_shown(paid):
    every = sides.bill_sides(paid)
    left = lambda d: sorted(r["id"] for r in sides.folded(d, every).collect())
    assert left(paid) == [2, 3, 5, 6]
    assert left(paid.filter("id <> 2 and id <> 3")) == [1, 4, 5, 6]
    assert left(paid.limit(0)) == []
    assert left(paid.unionByName(paid.filter("id = 2"))) == [2, 2, 3, 5, 6]  # repeated rows are repeated


def test_bills_in_words(spark, paid):
    bills = spark.createDataFrame([("b1", "A", 500, "app"), ("b2", "B", 100, "app"), ("b9", "A", 1, "statement")], "bill string, bill_card string, bill_cents bigint, origin string")
    got = {r["id"]: (r["card_side"], r["note"]) for r in sides.described(paid, sides.bill_sides(paid), bills).collect()}
    assert got == {
        1: (None, "Paid from UPI on 2024-01-03, through the app"), 2: (1, "Bill for card A, through the app; 0.20 covered by rewards"), 3: (None, "Paid through the app"), 4: (None, "Paid through the app"),
        5: (None, None), 6: (None, None),
    }
