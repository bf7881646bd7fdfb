"""Exports merged where two rows of another folder could be the same entry."""

import datetime as dt

import duckdb
import pytest

from ledgerloom.functions import dates, labels
from ledgerloom.queries import ORACLE_SQL, QUERIES

#: Two sends minutes after two entries of one amount and time, and three rewards for two entries.
ORDERS = [(33, 7, "1997-03-01"), (57, 7, "1997-03-01"), (12, 9, "1997-05-01"), (24, 9, "1997-05-01"), (36, 9, "1997-05-01"), (3, 5, "1997-06-01")]


@pytest.mark.parametrize("name", ["export_list_merged", "export_merge_counts"])
def test_each_entry_is_taken_once_in_the_query_and_its_sql(spark, tmp_path, name):
    rows = [(k, c, "F", 100.0 * c, dt.datetime.fromisoformat(day), "1-URGENT") for k, c, day in ORDERS]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(str(x).replace("+00:00", "") for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want)
    if name == "export_list_merged":
        assert len({r["id"] for r in got.collect()}) == got.count()


def test_texts_of_no_style_are_not_tried_but_all_styles_are_read(spark):
    texts = ["05/03/2024", "05-03-2024", "05.03.2024", "2024-03-05", "05 Mar 2024", "05-Mar-2024", "Mar 05, 2024"]
    got = spark.createDataFrame([(t,) for t in [*texts, "", "31/02/2024", "x", None]], "t string").select(dates.read_date("t").alias("d")).collect()
    assert [r["d"] for r in got] == [dt.date(2024, 3, 5)] * len(texts) + [None] * 4
    times = ["Mar 5, 2024, 9:05:00 PM", "Mar 5, 2024, 21:05", "5 March 2024, 21:05:00 IST", "2024-3-5 21:05", "5/3/2024 21:05", "5-3-2024 21:05:00", "2024-03-05T21:05Z"]
    got = [r["d"] for r in spark.createDataFrame([(t,) for t in times], "t string").select(labels.read_time("t").alias("d")).collect()]
    assert got[:-1] == [dt.datetime(2024, 3, 5, 21, 5)] * (len(times) - 1) and got[-1] == dt.datetime(2024, 3, 6, 2, 35)
