"""Rows, figures and headers that are broken over lines."""

from ledgerloom.operators import columns, wrapped


def frame(spark, **files):
    return spark.createDataFrame([(f, 10 * i, t) for f, lines in files.items() for i, t in enumerate(lines)], "file string, line int, text string")


def rows(spark, *lines):
    out = wrapped.rows_wrapped(frame(spark, a=lines)).orderBy("line").collect()
    return [(r["line"] // 10, str(r["day"])[5:], r["clock"], r["details"], [a["text"] for a in r["amounts"]]) for r in out]


def test_details_amounts_and_clocks_that_follow_a_row(spark):
    got = rows(
        spark,
        "01/03/2024  first shop        10.00",
        "            of the town",
        "            and country",
        "            but no more",
        "02/03/2024  second",
        "            shop              20.00",
        "10:15 am",
        "03/03/2024  third             30.00",
        "left text",
        "            not third's",
        "04/03/2024  fourth            40.00",
        "",
        "            after a blank",
        "05/03/2024",
        "            alone below       50.00",
        "06/03/2024  nothing at all",
    )
    assert got == [
        (0, "03-01", None, "first shop of the town and country", ["10.00"]), (4, "03-02", "10:15 am", "second shop", ["20.00"]), (7, "03-03", None, "third", ["30.00"]),
        (10, "03-04", None, "fourth", ["40.00"]), (13, "03-05", None, "alone below", ["50.00"]),
    ]


def test_undated_rows_and_parts_that_end_a_row(spark):
    got = rows(
        spark,
        "01/03/2024  late fee         100.00",
        "            igst on it        18.00",
        "            not of either",
        "02/03/2024  shop             200.00",
        "Total due: 1.00",
        "03/03/2024  abroad           300.00",
        "            usd 3.50",
    )
    assert got == [
        (0, "03-01", None, "late fee", ["100.00"]), (1, "03-01", None, "igst on it", ["18.00"]), (3, "03-02", None, "shop", ["200.00"]), (5, "03-03", None, "abroad usd", ["300.00", "3.50"]),
    ]
    assert wrapped.rows_wrapped(frame(spark)).count() == 0 and wrapped.rows_wrapped(frame(spark, a=["", "no date"])).count() == 0


def test_figures_under_labels_of_two_lines(spark):
    box = ["Previous          Total amount      Minimum", "balance           due               due", "", "1,000.00          2,345.67 Dr       50.00", "prose about the total", "amount due  9.00"]
    whole = ["Total due: 5.00", "Minimum due  9.00"]
    got = {r["file"]: r for r in wrapped.figures_wrapped(frame(spark, a=box, b=whole)).collect()}
    assert (got["a"]["previous"], got["a"]["due"], got["a"]["minimum"], got["a"]["printed_debits"]) == (100000, 234567, 5000, None)
    assert (got["b"]["due"], got["b"]["minimum"]) == (None, None)
    assert wrapped.figures_wrapped(frame(spark)).count() == 0


def test_headers_of_two_lines_and_blank_columns(spark):
    lines = [
        "Txn           Transaction                 Debit        Credit       Closing",
        "Date          Details                     amount       amount       balance",
        "01/03/2024    first shop                  10.00                     90.00",
        "02/03/2024    paid                                     25.00        115.00",
        "no row here",
        "03/03/2024    last                        1,000.00",
    ]
    got = wrapped.headed(frame(spark, a=lines, b=["Date  Details  Amount", "04/03/2024  one line  7.00"])).orderBy("file", "line").collect()
    assert [(r["line"], r["header"], r["details"], r["debit"], r["credit"], r["amount"], r["balance"]) for r in got] == [
        (3, 1, "first shop", 1000, None, None, 9000), (4, 1, "paid", None, 2500, None, 11500), (6, 1, "last", 100000, None, None, None), (2, 1, "one line", None, None, 700, None)]
    assert wrapped.headed(frame(spark)).count() == 0


def test_a_statement_with_everything_broken_is_proven(spark):
    lines = [
        "Previous          Total amount      Minimum", "balance           due               due", "1,000.00          1,085.00          50.00",
        "Txn           Transaction            Debit        Credit", "Date          Details                amount       amount",
        "01/03/2024    first shop             100.00", "              of the town", "              gst on it              10.00",
        "02/03/2024    refund of", "              the shop                            25.00",
    ]
    got = columns.statements_read(frame(spark, a=lines)).collect()
    assert [(r["status"], r["debits"], r["credits"]) for r in got] == [("proven", 11000, 2500)]
