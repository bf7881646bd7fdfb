"""Readings of amounts: what an amount says is read once."""

import datetime as dt

from ledgerloom.operators import lines


def test_readings_read_an_amount_once(spark):
    rows = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1), "x", ["9.00", "0.00", "-5.00"]), ("a", 2, dt.date(2024, 1, 2), "y", ["7.00 Cr"]), ("a", 3, dt.date(2024, 1, 2), "z", [])], "file string, line long, day date, details string, amounts array<string>")
    got = lines.readings(rows)
    told = sorted(tuple(r[c] for c in ("line", "reading", "cents", "mark", "sign", "balance")) for r in got.collect())
    assert told == sorted([(1, "amount", 500, None, "-", None), (1, "debit+credit", 500, "cr", None, None), (1, "amount+balance", 0, None, None, -500), (2, "amount", 700, "cr", None, None)], key=lambda r: r[:2])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
