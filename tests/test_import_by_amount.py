"""Imports by amount: rows of one direction and amount are folded in one task, and only those of too many are linked first."""

import random

import pytest

from ledgerloom.operators import cascade

from .test_imports import NAMES, SCHEMA, plain_import, random_batch, row, run


def batches(n):
    rng = random.Random(n)
    old, new, links, records = [], [], {}, {}
    for base in range(1, n):
        a, b = random_batch(rng, base, rng.randint(2, 14))
        some, states = plain_import(a, b)
        old, new, links, records = old + a, new + b, links | some, records | states
    to = lambda rows: [tuple(r[n] for n in NAMES) for r in rows]
    return to(old), to(new), links, records


@pytest.mark.parametrize("at_most", [0, 6])
def test_amounts_of_too_many_rows_are_linked_first(spark, monkeypatch, at_most):
    """All of them, or some: the result is that of the plain fold."""
    monkeypatch.setattr(cascade, "AT_MOST", at_most)
    old, new, want, records = batches(120)
    got, kept = run(spark, old, new)
    assert got == want and kept.keys() == records.keys()
    assert all(kept[i][n] == e[n] for i, e in records.items() for n in NAMES if n not in ("file", "arrived"))


def test_an_import_of_few_rows_an_amount_writes_nothing(spark, monkeypatch):
    rows, cut = [], cascade.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(cascade, "cut", counted)
    old, new, want, _ = batches(20)
    links, records = cascade.imported(spark.createDataFrame(old, SCHEMA).drop("arrived"), spark.createDataFrame(new, SCHEMA))
    for out in (links, records):  # one shuffle each, and what tiers compare is put on behind it
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("RepartitionByExpression") + plan.count("Exchange hashpartitioning") == 1 and "regexp_extract_all" not in plan[plan.rindex("hashpartitioning") :]
    assert {r["id"]: (r["root"], r["tier"]) for r in links.collect()} == want and sum(rows) == 0


def test_rows_without_a_time_or_amount_stay_alone_beside_others(spark):
    new = [row(2, 1, "Acme", arrived=1), row(3, 0, "Acme", arrived=2, ts=None), row(4, 0, "Acme", arrived=3, ts=None), row(5, 0, "Acme", arrived=4, cents=None), row(6, 0, "Acme", arrived=5, cents=None), row(7, 0, "Acme", arrived=6, direction=None)]
    got, kept = run(spark, [row(1), row(8, ts=None)], new)
    assert got == {1: (1, None), 2: (1, 2)} | {i: (i, None) for i in range(3, 9)} and kept.keys() == {1, *range(3, 9)}


def test_a_batch_beside_no_records_writes_nothing(spark, monkeypatch):
    """Rows that find one another in one import, and amounts at the end of a batch of Arrow and of a slice of it."""
    monkeypatch.setattr(cascade, "ROWS_AT_ONCE", 2)
    monkeypatch.setattr(cascade, "_linked_first", None)
    new = [row(10 * c + i, i, "Acme", {"utr": f"u{c}"} if c % 2 else {}, 10 * c + i, cents=c) for c in range(1, 30) for i in range(3)]
    got, kept = run(spark, [], new)
    assert got == {10 * c + i: (10 * c, None if not i else 1 if c % 2 else 2) for c in range(1, 30) for i in range(3)} and len(kept) == 29
