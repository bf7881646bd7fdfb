"""Figures about cards: what was itemised, what bills say beyond, month by month, and the order cards are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Period, month_key, months_in, prorated
from ..functions.money import money
from .bills import covered_share


def _sum(value: Column | str, when: Column | None = None) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(v if when is None else F.when(when, v)), F.lit(0))


def figures(rows: DataFrame, bills: DataFrame, period: Period) -> DataFrame:
    """One row: purchases by card number, those with a card by UPI, fees, refunds, cashback, and bills paid in a period."""
    own = rows.filter(period.has("eff_day"))
    number, upi, spent = F.col("owner_channel") == "card", (F.col("owner_channel") != "card") & F.col("owner_card").isNotNull(), F.col("bucket") == "spent"
    left = own.agg(
        money(_sum("signed", spent & number)).alias("itemised"), _sum("n", spent & number).alias("itemised_payments"), money(_sum("signed", spent & upi)).alias("via_upi"), _sum("n", spent & upi).alias("via_upi_payments"),
        money(_sum("signed", number & (F.col("top") == "fees"))).alias("fees"), money(_sum("cents", number & F.col("refund_of").isNotNull())).alias("refunded"), money(_sum("cents", number & (F.col("bucket") == "cashback"))).alias("cashback"),
    )
    right = bills.filter(period.has("paid")).agg(money(_sum("cents")).alias("bills_paid"), F.count(F.lit(1)).alias("bills"))
    return left.crossJoin(right)  # one row each


def estimate_parts(bills: DataFrame, period: Period) -> DataFrame:
    """(bill, card, share, cents): of each bill that no statement covers (cycle_first, cycle_last, estimate) the share of its
    cycle's days in a period, and that part of its estimate; none under half a unit for a card."""
    parts = prorated(bills.filter("covered_by is null"), "cycle_first", "cycle_last").filter(F.col("month").between(f"{period.first:%Y-%m}", f"{period.last:%Y-%m}"))
    own = parts.groupBy("bill", "card", "estimate", "of_days").agg(F.sum("days").alias("_d"))
    own = own.select("bill", "card", (F.col("_d") / F.col("of_days")).alias("share"), F.floor(F.col("estimate") * F.col("_d") / F.col("of_days") + 0.5).cast("bigint").alias("cents"))
    enough = own.groupBy("card").agg(F.sum("cents").alias("_c")).filter("_c > 50").select("card")
    return own.join(enough, "card", "left_semi").select("bill", "card", "share", "cents")


def covered_part(bills: DataFrame, period: Period) -> DataFrame:
    """One row: what bills that a statement covers paid of the days in a period."""
    parts = prorated(bills.filter("covered_by is not null"), "cycle_first", "cycle_last").filter(F.col("month").between(f"{period.first:%Y-%m}", f"{period.last:%Y-%m}"))
    own = parts.groupBy("bill", "cents", "of_days").agg(F.sum("days").alias("_d"))
    return own.agg(F.coalesce(F.sum(F.floor(F.col("cents") * F.col("_d") / F.col("of_days") + 0.5).cast("bigint")), F.lit(0)).alias("cents"), F.count(F.lit(1)).alias("bills"))


def left_out_share(bills: DataFrame, rows: DataFrame) -> DataFrame:
    """(bill, share): of what was paid with a bill's card by UPI in its cycle, the part that is left out (investments), 0 to 1."""
    on_card = rows.filter((F.col("channel") != "card") & F.col("card").isNotNull())
    signed = F.when(F.col("direction") == "debit", F.col("cents")).otherwise(-F.col("cents"))
    days = on_card.groupBy("card", "day").agg(F.sum(signed).alias("_all"), _sum(signed, F.col("top") == "investments").alias("_out")).withColumn("_m", F.trunc("day", "MM"))
    months = bills.select("bill", "card", "cycle_first", "cycle_last", F.explode(F.sequence(F.trunc("cycle_first", "MM"), F.trunc("cycle_last", "MM"), F.expr("interval 1 month"))).alias("_m"))
    sums = months.join(days, ["card", "_m"]).filter("day between cycle_first and cycle_last").groupBy("bill").agg(F.sum("_all").alias("_all"), F.sum("_out").alias("_out"))
    share = F.when(F.col("_all") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_out") / F.col("_all")))).otherwise(0.0)
    return bills.select("bill").join(sums, "bill", "left").select("bill", F.coalesce(share, F.lit(0.0)).alias("share"))


def trends(spark: SparkSession, rows: DataFrame, bills: DataFrame, statements: DataFrame, period: Period) -> DataFrame:
    """(card, month, amount, estimated): each card's purchases by number and what bills say beyond, in months that a statement
    or a bill reaches; null where no file does; estimated where bills speak for more of the month than statements."""
    read = rows.filter((F.col("bucket") == "spent") & (F.col("owner_channel") == "card") & period.has("eff_day")).groupBy(F.col("owner_card").alias("card"), month_key("eff_day").alias("month")).agg(F.sum("signed").alias("_r"))
    parts = prorated(bills.filter("covered_by is null"), "cycle_first", "cycle_last")
    billed = parts.groupBy("card", "month").agg(F.sum(F.floor(F.col("estimate") * F.col("days") / F.col("of_days") + 0.5).cast("bigint")).alias("_b"), F.sum("days").alias("_d"))
    cover = covered_share(statements).withColumnRenamed("share", "_s")
    cards = statements.select("card").union(bills.select("card")).distinct()
    cells = cards.join(F.broadcast(months_in(spark, period)))  # cards by months of a period
    cells = cells.join(read, ["card", "month"], "left").join(billed, ["card", "month"], "left").join(cover, ["card", "month"], "left")
    of_month = F.col("_d") / F.day(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    known = F.coalesce(F.col("_s") > 0, F.lit(False)) | F.coalesce(F.col("_d") > 0, F.lit(False)) | (F.abs(F.coalesce("_r", F.lit(0))) > 0)
    return cells.select("card", "month", F.when(known, money(F.coalesce("_r", F.lit(0)) + F.coalesce("_b", F.lit(0)))).alias("amount"), F.coalesce(of_month > F.coalesce("_s", F.lit(0.0)), F.lit(False)).alias("estimated"))


def together(trend: DataFrame) -> DataFrame:
    """(month, amount, estimated) over all lines of a trend, for the months that any of them has."""
    return trend.filter("amount is not null").groupBy("month").agg(F.sum("amount").alias("amount"), F.bool_or("estimated").alias("estimated"))


def slots(amounts: DataFrame, name: str, k: int) -> DataFrame:
    """(name, slot): the k largest of all time have slots from 1, whatever period is looked at."""
    top = amounts.orderBy(F.desc("amount"), name).limit(k).agg(F.sort_array(F.collect_list(F.struct((-F.col("amount")).alias("a"), F.col(name).alias("n")))).alias("t"))  # k rows
    return top.select(F.posexplode("t").alias("_i", "_t")).select(F.col("_t.n").alias(name), (F.col("_i") + 1).alias("slot"))


def weights(rows: DataFrame, bills: DataFrame, period: Period) -> DataFrame:
    """(card, amount) to order cards by: purchases by number and by UPI, and bills paid, in a period."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day") & F.col("owner_card").isNotNull()).groupBy(F.col("owner_card").alias("card")).agg(F.sum("signed").alias("_c"))
    paid = bills.filter(period.has("paid")).groupBy("card").agg(F.sum("cents").alias("_c"))
    return spent.unionByName(paid).groupBy("card").agg(money(F.sum("_c")).alias("amount"))
