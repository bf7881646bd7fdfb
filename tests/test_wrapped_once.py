"""Lines of broken text: they are shuffled once by their file, and headers meet rows without a join."""

import datetime as dt

from ledgerloom.operators import wrapped

LINES = ["Date        Details               Amount", "01/02/2024  shop                    5.00", "            of the town", "02/02/2024  other                   6.00", "10:15 am", "no amount"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wrapped_rows_are_shuffled_once(spark, monkeypatch):
    written, whole = [], wrapped.cut
    monkeypatch.setattr(wrapped, "cut", lambda df: written.append(1) or whole(df))
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(LINES)], "file string, line long, text string")
    got = wrapped.rows_wrapped(lines)
    assert not written and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["day"], r["details"], r["clock"], r["amounts"][0]["text"]) for r in got.collect()) == [(dt.date(2024, 2, 1), "shop of the town", None, "5.00"), (dt.date(2024, 2, 2), "other", "10:15 am", "6.00")]


def test_headers_are_stacked_on_rows(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(LINES)] + [("b", 1, LINES[1])], "file string, line long, text string")
    got = wrapped.headed(lines)
    assert "Join" not in _plan(got)
    assert sorted((r["file"], r["line"], r["header"], r["details"], r["amount"]) for r in got.collect()) == [("a", 2, 1, "shop", 500), ("a", 4, 1, "other", 600)]
