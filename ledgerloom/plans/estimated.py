"""Answers that take in what only bills tell: spending of cards in cycles that no statement lists.

A bill's estimate lies evenly on the days of its cycle. Only whole months of a period are counted; of months that the period
cuts it is said that they are left out. A question by category, payee or UPI, or about money in, takes none of it: an
estimate has no payee and no category.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Period, month_key, months_in
from ..functions.money import money
from .ask import Query, selected
from .notes import whole_month_estimates

_EVER = Period(dt.date(1000, 1, 1), dt.date(9999, 12, 31))


def takes_bills(q: Query) -> bool:
    return q.money == "out" and not q.categories and not q.payees and q.channel != "upi"


def of_query(bills: DataFrame, q: Query, period: Period | None = None) -> DataFrame:
    """(month, whole, cents) that a question takes from bills (card, cycle_first, cycle_last, estimate, covered_by): of whole months
    what counts, of cut ones what does not. The cards asked about reach the scan of the bills."""
    q = q.normal()
    own = bills.filter(F.col("card").isin(list(q.cards))) if q.cards else bills
    return whole_month_estimates(own if takes_bills(q) else own.filter(F.lit(False)), period or q.period or _EVER)


def anyway(bills: DataFrame, period: Period | None) -> DataFrame:
    """One row (cents): what bills tell of a period, whatever else a question narrows."""
    return of_query(bills, Query(period=period)).filter("whole").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


def total(rows: DataFrame, bills: DataFrame, q: Query) -> DataFrame:
    """One row: amount (counted and estimated together), payments, estimated, the months left out for being cut, and what a
    narrower question leaves out of the bills altogether (null where it takes them in)."""
    q = q.normal()
    counted = selected(rows, q).agg(F.coalesce(F.sum("signed"), F.lit(0)).alias("_c"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments"))
    months = F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("month"))))  # at most the two months at a period's ends
    est = of_query(bills, q).agg(F.coalesce(F.sum(F.when(F.col("whole"), F.col("cents"))), F.lit(0)).alias("_e"), F.concat_ws(",", months).alias("cut_months"))
    both = counted.crossJoin(est)  # one row each
    told = q.money == "out" and q.channel != "upi" and not takes_bills(q)
    both = both.crossJoin(anyway(bills, q.period).withColumnRenamed("cents", "_a")) if told else both.withColumn("_a", F.lit(None).cast("bigint"))  # one row
    return both.select(money(F.col("_c") + F.col("_e")).alias("amount"), "payments", money("_e").alias("estimated"), "cut_months", money(F.when(F.col("_a") > 50, F.col("_a"))).alias("in_bills_only"))


def compared(rows: DataFrame, bills: DataFrame, q: Query) -> DataFrame:
    """One row: a period with what bills tell of it against another, each by its own whole months."""
    q = q.normal()
    sides = []
    for name, p in (("now", q.period), ("before", q.other or q.period.before())):
        own = selected(rows, replace(q, period=None), p).agg(F.coalesce(F.sum("signed"), F.lit(0)).alias("_c"))
        est = of_query(bills, q, p).filter("whole").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("_e"))
        sides.append(own.crossJoin(est).select((F.col("_c") + F.col("_e")).alias(f"_{name}"), F.col("_e").alias(f"_e_{name}")))  # one row each
    both = sides[0].crossJoin(sides[1])  # one row each
    return both.select(money("_now").alias("now"), money("_before").alias("before"), money(F.col("_now") - F.col("_before")).alias("difference"), money(F.col("_e_now") - F.col("_e_before")).alias("of_bills"))


def trend(spark: SparkSession, rows: DataFrame, bills: DataFrame, q: Query) -> DataFrame:
    """(month, amount, payments, estimated) for every month of a period that rows or bills reach."""
    q = q.normal()
    by = selected(rows, q).groupBy(month_key("eff_day").alias("month")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("payments"))
    est = of_query(bills, q).filter("whole").select("month", F.col("cents").alias("_e"))
    reach = rows.agg(F.min(month_key("day")).alias("_lo"), F.max(month_key("day")).alias("_hi"))
    months = months_in(spark, q.period).join(F.broadcast(reach), F.lit(True))  # one row
    all_of = months.join(by, "month", "left").join(est, "month", "left").filter(F.col("month").between(F.col("_lo"), F.col("_hi")) | F.col("_e").isNotNull())
    s, e = F.coalesce("_s", F.lit(0)), F.coalesce("_e", F.lit(0))
    return all_of.select("month", money(s + e).alias("amount"), F.coalesce("payments", F.lit(0)).alias("payments"), money(e).alias("estimated"))
