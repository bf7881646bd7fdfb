"""Records of lines: one order of a file's lines serves all."""

from ledgerloom.sources import files


def test_records_take_one_order_and_no_grouping(spark):
    text = ["x", "Jan 5, 2024", "Paid to A", "DEBIT ₹1.00", "Jan 6, 2024", "UTR No. 7", "Jan 7, 2024", "Paid to B", "Paid to C"]
    got = files.records(spark.createDataFrame([(1, i, t) for i, t in enumerate([*text, None])] + [(2, 0, "Paid to D")], "file long, line long, text string"), files.ACTIVITY_START, files.ACTIVITY_FIELDS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan
    assert sorted((r["record"], r["day"], r["payee"], r["utr"], r["amount"]) for r in got.collect()) == [(1, "Jan 5, 2024", "A", None, "1.00"), (2, "Jan 6, 2024", None, "7", None), (3, "Jan 7, 2024", "B", None, None)]
