"""Candidates of an import: both sides are made once, whatever tiers read them."""

from ledgerloom.operators import cascade


def test_sides_of_an_import_are_made_once(spark):
    side = lambda i: spark.range(4).selectExpr(f"id + {i} AS id", "timestamp_ntz'2024-03-05 10:00:00' AS ts", "500 + id AS cents", "'debit' AS direction", "'Ann' AS payee", "'upi' AS channel", "'1' AS card", "'XXXX12' AS paid_from", f"'f{i}' AS file", "CAST(map() AS map<string,string>) AS refs")
    found = cascade.candidates(side(0), side(100))
    assert sorted({(r["new_id"], r["old_id"], r["tier"]) for r in found.collect()}) == [(100 + i, i, t) for i in range(4) for t in (1, 2)]
    # The keys of each side come from its rows; all else from what was written.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4") <= 2
