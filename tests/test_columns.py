"""Statements whose amounts stand in columns: where these are, what they mean, and what the arithmetic proves."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import columns, proof

MONEY = lambda c: f"{c // 100:,}.{c % 100:02d}"


def lay(width, *cells):
    """A line with texts that end at given places."""
    out = ""
    for end, text in cells:
        out = out.ljust(max(len(out), end - len(text))) + text
    return out.ljust(width)


def frame(spark, files):
    return spark.createDataFrame([(f, i, t) for f, lines in files.items() for i, t in enumerate(lines)], "file string, line int, text string")


def read(spark, files):
    return {r["statement"]: r for r in columns.statements_read(frame(spark, files)).collect()}


def rows_of(rng, n):
    return [(f"{1 + i:02d}/03/2024", f"shop {chr(97 + i)}", rng.randint(100, 900_000), rng.random() < 0.35) for i in range(n)]


def two_columns(rows, debit=50, credit=64, shift=0):
    return [lay(0, (10, d), (12 + len(t), t), (debit + shift, MONEY(c)) if not cr else (credit + shift, MONEY(c))) for d, t, c, cr in rows]


def test_debits_and_credits_in_columns_with_blanks_are_proven(spark):
    rows = rows_of(random.Random(1), 12)
    d, c = sum(x[2] for x in rows if not x[3]), sum(x[2] for x in rows if x[3])
    head = [f"Previous balance: {MONEY(1_000_000)}", *two_columns(rows), f"Total due: {MONEY(1_000_000 + d - c)}"]
    mirrored = [f"Previous balance: {MONEY(5_000_000)}", *two_columns([(a, b, x, not cr) for a, b, x, cr in rows]), f"Total due: {MONEY(5_000_000 + d - c)}"]
    wrong = [*head[:-1], f"Total due: {MONEY(1_000_001 + d - c)}"]
    got = read(spark, {"a": head, "b": mirrored, "c": wrong})
    assert (got["a"]["status"], got["a"]["proof"], got["a"]["reading"], got["a"]["debits"], got["a"]["credits"]) == ("proven", "figures", "shape:debit@0+credit@1", d, c)
    assert (got["b"]["status"], got["b"]["reading"], got["b"]["debits"]) == ("proven", "shape:credit@0+debit@1", d)
    assert got["c"]["status"] == "unproven"


def test_tables_to_one_side_are_moved_into_line(spark):
    rng = random.Random(2)
    first, second = rows_of(rng, 9), rows_of(rng, 6)
    lines = ["Date  Details   Debit   Credit", *two_columns(first), "Date  Details   Debit   Credit", *two_columns(second, shift=-3)]
    rows = columns.placed(frame(spark, {"a": lines}))
    moved = {r["table"]: r["shift"] for r in columns.shifts(columns._edges(rows)).filter("side = 'x1'").collect()}
    held, cells = columns.columns(rows)
    assert moved == {1: 0, 2: 3} and sorted(r["edge"] for r in held.collect()) == [50.0, 64.0]
    assert cells.count() == 15
    by = {(r["line"]): r["column"] for r in cells.collect()}
    assert [by[i + 1] for i in range(9)] == [int(x[3]) for x in first] and [by[i + 11] for i in range(6)] == [int(x[3]) for x in second]


def test_an_amount_and_its_balance_prove_themselves(spark):
    rows, balance, lines = rows_of(random.Random(3), 8), 700_000, []
    for d, t, c, cr in rows:
        balance += -c if cr else c
        lines.append(lay(0, (10, d), (12 + len(t), t), (50, MONEY(c) + (" Cr" if cr and not lines else "")), (70, MONEY(balance))))
    got = read(spark, {"old": ["Opening balance: 7,000.00", *lines], "new": ["Opening balance: 7,000.00", *lines[::-1]], "none": lines})
    d, c = sum(x[2] for x in rows if not x[3]), sum(x[2] for x in rows if x[3])
    for name in ("old", "new"):
        assert (got[name]["status"], got[name]["proof"], got[name]["debits"], got[name]["credits"]) == ("proven", "running balance", d, c), name
    assert got["none"]["status"] == ("proven" if rows[0][3] else "nothing to check by")


def test_left_edges_and_an_orphan(spark):
    """Amounts that line up on the left; one row's only amount stands in a place of its own and is a column all the same."""
    lines = [f"{i + 1:02d}/03/2024 shop".ljust(40) + x for i, x in enumerate(["1.00", "22.00", "3,333.00", "44.00", "555.00"])] + ["09/03/2024 late".ljust(70) + "7.00"]
    held, cells = columns.columns(columns.placed(frame(spark, {"a": lines})))
    assert [(r["side"], r["edge"]) for r in held.orderBy("column").collect()] == [("x0", 40.0), ("x0", 70.0)]
    assert cells.count() == 6


def test_layouts_by_use(spark):
    lines = [lay(0, (10, f"{i + 1:02d}/03/2024"), (30, "1.00" if i % 2 else ""), (45, "" if i % 2 else "2.00"), (60, "9.00")) for i in range(8)]
    held, cells = columns.columns(columns.placed(frame(spark, {"a": lines})))
    got = {r["layout"] for r in columns.layouts(held, cells).collect()}
    assert got == {"amount@0", "amount@1", "amount@2", "debit@0+credit@1", "credit@0+debit@1"}  # a half of the rows is no column beside a balance
    more = lines + [lay(0, (10, f"{i + 11:02d}/03/2024"), (45, "2.00"), (60, "9.00")) for i in range(4)]
    held, cells = columns.columns(columns.placed(frame(spark, {"a": more})))
    assert "amount@1+balance@2" in {r["layout"] for r in columns.layouts(held, cells).collect()}


def test_files_without_rows_or_lines(spark):
    got = read(spark, {"a": ["Previous balance: 1.00", "nothing here"], "b": [""]})
    assert {r["status"] for r in got.values()} == {"nothing to check by"} and got["a"]["reading"] is None
    assert columns.statements_read(frame(spark, {})).count() == 0


# Proofs.
SPAN = "statement string, first date, last date, debits bigint, credits bigint"


def marked(spark, rows):
    return spark.createDataFrame([("s", r, d, c, m, None) for r, d, c, m in rows], "statement string, reading string, day string, cents bigint, mark string, sign string").withColumn("day", F.col("day").cast("date"))


def test_two_windows_that_take_different_rows_prove_nothing(spark):
    span = spark.createDataFrame([("s", "2024-01-02", "2024-01-10", 10000, 0)], "statement string, first string, last string, debits bigint, credits bigint").withColumns({c: F.col(c).cast("date") for c in ("first", "last")})
    rows = [("a", "2024-01-01", 10000, "dr"), ("a", "2024-01-11", 10000, "dr")]
    got = proof.over_cycles(marked(spark, rows), span).collect()
    assert [(r["status"], r["first"]) for r in got] == [("ambiguous", None)]
    got = proof.over_cycles(marked(spark, rows[:1]), span).collect()
    assert [(r["status"], str(r["first"]), str(r["last"]), r["inside"], r["beyond"]) for r in got] == [("proven", "2024-01-01", "2024-01-10", 1, 0)]
    # The same rows inside, but another reading leaves other rows outside.
    both = rows[:1] + [("b", "2024-01-01", 10000, "dr"), ("b", "2024-02-20", 5, "dr")]
    assert [r["status"] for r in proof.over_cycles(marked(spark, both), span).collect()] == ["ambiguous"]


@pytest.mark.parametrize("seed", range(3))
def test_running_balances_against_trying_everything(spark, seed):
    """Random short statements, some of which fit in no order, some in both: each order and meaning is tried one by one."""
    rng = random.Random(seed)
    rows, opening, want = [], {}, {}
    for s in range(60):
        n, owed, newest = rng.randint(1, 4), rng.random() < 0.5, rng.random() < 0.5
        opening[s] = rng.choice([None, 50])
        balance, part = 50, []
        for _ in range(n):
            c, cr = rng.choice([5, 10]), rng.random() < 0.5
            balance += c if (not cr) == owed else -c
            part.append([c, balance + (rng.random() < 0.1), rng.choice([None, "cr" if cr else "dr"])])
        part = part[::-1] if newest else part
        rows += [(s, "r", i, c, b, m) for i, (c, b, m) in enumerate(part)]
        for order in (False, True):
            seq = part[::-1] if order else part
            fits = []
            for o in (True, False):
                known = opening[s] is not None or seq[0][2] is not None
                moves = [None if opening[s] is None else seq[0][1] - opening[s]] + [y[1] - x[1] for x, y in zip(seq, seq[1:])]
                if n >= 2 and known and all(m is None or abs(m) == x[0] for m, x in zip(moves, seq)):
                    credits = [x[2] == "cr" if m is None else (m > 0) != o for m, x in zip(moves, seq)]
                    fits.append((-sum(x[2] is not None and (x[2] == "cr") == cr for x, cr in zip(seq, credits)), not o, credits[::-1] if order else credits))
            if fits:
                want[s] = min(fits)[2]
                break
    frame = spark.createDataFrame(rows, "statement int, reading string, line int, cents int, balance int, mark string").withColumn("sign", F.lit(None).cast("string"))
    heads = spark.createDataFrame(list(opening.items()), "statement int, previous int")
    got = {}
    for r in proof.running_balances(frame, heads).orderBy("statement", "line").collect():
        got.setdefault(r["statement"], []).append(r["credit"])
    assert got == want and len(want) > 15


def test_the_sql_of_decided_statements_tells_what_is_owed_where_no_row_speaks(spark, tmp_path):
    """Two debits and a balance that falls: no row is marked, so what is owed goes first; a third row, which is marked, decides otherwise."""
    import duckdb

    from ledgerloom.queries import ORACLE_SQL, QUERIES

    orders = [(k, customer, dt.datetime(1996, 1, k), 10.0 * k) for customer, keys in ((2, (1, 2)), (7, (3, 5, 6)), (12, (9, 12))) for k in keys]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["statements_decided"](spark, str(tmp_path)).orderBy("statement").select("statement", "status", "debits", "credits").collect()
    assert [tuple(r) for r in got] == [(2, "proven", 0, 3000), (7, "proven", 14000, 0), (12, "proven", 9000, 12000)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert con.execute(f"SELECT statement, status, debits, credits FROM ({ORACLE_SQL['statements_decided']}) ORDER BY statement").fetchall() == [tuple(r) for r in got]
