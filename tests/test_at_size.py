"""What keeps the work of a query in proportion to its input."""

from pyspark.sql import functions as F

from ledgerloom.operators import columns, matching, proof, wrapped

from .test_columns import frame


def plan(df):
    return df._jdf.queryExecution().toString()


def test_edges_are_counted_before_they_are_ordered(spark):
    lines = [f"{1 + i:02d}/03/2024  shop          {100 + i}.00" for i in range(20)]
    edges = columns._edges(columns.placed(frame(spark, {"a": lines})))
    assert {(r["side"], r["x"], r["n"]) for r in edges.collect()} == {("x0", 26, 20), ("x1", 32, 20)}


def test_places_are_those_of_the_finds_and_patterns_are_tried_once(spark):
    text = "1.00 11.00  x11.00Cr 1.00 a1.0 (5.00) 5.00"
    each = frame(spark, {"a": [text, "", "none"]}).select("line", wrapped._placed(F.col("text"), wrapped.MONEY).alias("p"))
    got = {r["line"]: [(p["x0"], p["x1"], p["text"]) for p in r["p"]] for r in each.collect()}
    assert got == {0: [(0, 4, "1.00"), (5, 10, "11.00"), (13, 20, "11.00Cr"), (21, 25, "1.00"), (31, 37, "(5.00)"), (38, 42, "5.00")], 1: [], 2: []}
    assert "split(" not in plan(each)


def test_what_figures_prove_is_worked_out_once(spark):
    rows = spark.sql("SELECT 's' AS statement, 'shape' AS reading, 1L AS line, DATE '2024-03-01' AS day, 500L AS cents, 'dr' AS mark, '' AS sign, CAST(NULL AS BIGINT) AS balance")
    heads = spark.sql("SELECT 's' AS statement, 0L AS previous, 500L AS due, CAST(NULL AS BIGINT) AS printed_debits, CAST(NULL AS BIGINT) AS printed_credits")
    out = proof.decide(rows, heads)
    assert [tuple(r)[:3] for r in out.collect()] == [("s", "proven", "figures")] and "xxhash64" not in plan(out)


def _alike(n):
    """A payment and a refund of one amount on one card in turn, of shops of their own; every fourth credit is one of instalments."""
    at = lambda i: f"2024-03-01 00:{i // 60:02d}:{i % 60:02d}"
    row = lambda i: (i, at(i), 500, f"s{i}", "c", None, i % 8 == 7)
    return [row(i) for i in range(0, 2 * n, 2)], [row(i) for i in range(1, 2 * n, 2)]


def _written(monkeypatch):
    """How many rows each table has that matching writes."""
    rows, cut = [], matching.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(matching, "cut", counted)
    return rows


def _sides(spark, n):
    schema = "id bigint, ts string, cents bigint, shop string, card string, ref string, emi boolean"
    return [spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")) for rows in _alike(n)]


def test_payments_and_refunds_of_one_amount_are_never_paired(spark, monkeypatch):
    rows = _written(monkeypatch)
    got = matching.assign_refunds(*_sides(spark, 200)).collect()
    assert {(r["refund"], r["payment"], r["tier"]) for r in got} == {(i, i - 1, 4 if i % 8 == 7 else 3) for i in range(1, 400, 2)}
    assert max(rows) <= 400


def test_forgetting_holds_records_against_keys(spark, monkeypatch):
    payments, refunds = _sides(spark, 100)
    before = matching.assign_refunds(payments, refunds)
    rows = _written(monkeypatch)
    gone = spark.createDataFrame([(0,), (7,)], "id bigint")
    got = {r["refund"]: r["payment"] for r in matching.reassigned(payments, refunds, before, gone).collect()}
    assert got == {i: i - 1 for i in range(3, 200, 2) if i != 7} | {9: 8}
    assert max(rows) <= 1000


def test_cycles_are_summed_without_an_order_of_days(spark):
    rows = spark.sql("SELECT 's' AS statement, 'wide' AS reading, DATE '2024-03-01' + CAST(id AS INT) AS day, 100L + id AS cents, 'dr' AS mark, '' AS sign FROM range(60)")
    span = spark.sql("SELECT 's' AS statement, DATE '2024-03-12' AS first, DATE '2024-04-09' AS last, CAST(sum(100 + id) AS BIGINT) AS debits, 0L AS credits FROM range(10, 40)")
    out = proof.over_cycles(rows, span)
    got = out.collect()
    assert [(r["status"], str(r["first"]), str(r["last"]), r["inside"], r["beyond"]) for r in got] == [("proven", "2024-03-11", "2024-04-09", 30, 30)]
    assert "Window [" not in plan(out)
