"""Figures about bills, stays and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import Period, month_key, prorated
from ..functions.money import money
from ..functions.text import normal_name
from ..operators.intervals import owned_days


def paid_by_month(bills: DataFrame, period: Period) -> DataFrame:
    """What was paid of each card's bills, by month of payment."""
    return bills.filter(period.has("paid")).groupBy("card", month_key("paid").alias("month")).agg(money(F.sum("cents")).alias("amount"), F.count(F.lit(1)).alias("bills"))


def estimates_by_month(estimates: DataFrame, period: Period) -> DataFrame:
    """Estimates (card, cycle_first, cycle_last, estimate in cents) spread over the days of their cycles, by card and month
    of the period; half a unit and less is no estimate."""
    parts = prorated(estimates.filter("estimate > 0"), "cycle_first", "cycle_last")
    inside = parts.filter(F.col("month").between(F.date_format(F.lit(period.first), "yyyy-MM"), F.date_format(F.lit(period.last), "yyyy-MM")))
    total = inside.groupBy("card", "month").agg(F.floor(F.sum(F.round(F.col("estimate") * F.col("days") * 1000 / F.col("of_days")).cast("bigint")) / 1000 + 0.5).cast("bigint").alias("cents"))
    return total.filter("cents > 50")


def covered_share(statements: DataFrame) -> DataFrame:
    """(card, month, share): the part of a month's days that a card's statements reach; a day in two of them counts once."""
    days = statements.select("card", F.explode(F.sequence("first", "last")).alias("day")).distinct()
    return days.groupBy("card", month_key("day").alias("month")).agg((F.count(F.lit(1)) / F.max(F.day(F.last_day("day")))).alias("share"))


def bills_answer(bills: DataFrame, period: Period) -> DataFrame:
    """One row: what was paid, how many bills, and the last of them."""
    return bills.filter(period.has("paid")).agg(money(F.coalesce(F.sum("cents"), F.lit(0))).alias("amount"), F.count(F.lit(1)).alias("bills"), F.max("paid").alias("last"))


def where_answer(stays: DataFrame, rows: DataFrame, period: Period) -> DataFrame:
    """Stays that reach into a period, cut to it: own days, spending and payments on them; stays without a day of their own
    in it are not there."""
    days = owned_days(stays).filter(period.has("day"))
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day")).groupBy(F.col("eff_day").alias("day")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("_n"))
    both = days.join(spent, "day", "left").groupBy("stay", "place")
    return both.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("days"), money(F.coalesce(F.sum("_s"), F.lit(0))).alias("amount"), F.coalesce(F.sum("_n"), F.lit(0)).alias("payments"))


def stay_preview(stays: DataFrame, rows: DataFrame, period: Period) -> DataFrame:
    """One row: what a new stay over the period would take in, and the days it would take from earlier stays."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day")).agg(money(F.coalesce(F.sum("signed"), F.lit(0))).alias("amount"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments"))
    taken = owned_days(stays).filter(period.has("day")).agg(F.count(F.lit(1)).alias("days_taken"), F.count_distinct("stay").alias("stays"))
    return spent.crossJoin(taken)  # one row each


def ticked_total(rows: DataFrame, ticked: DataFrame) -> DataFrame:
    """The net of chosen rows (ids): credits come off, card bills do not count."""
    own = rows.join(ticked.select("id").distinct(), "id", "left_semi").filter("bucket <> 'card_bill'")
    return own.agg(money(F.coalesce(F.sum(F.when(F.col("direction") == "credit", -F.col("cents")).otherwise(F.col("cents"))), F.lit(0))).alias("amount"), F.count(F.lit(1)).alias("rows"))


def one_row_per_bill(rows: DataFrame, key: str) -> DataFrame:
    """Of rows that are sides of the same payment (equal `key`) the first by time and id, with the number of sides; rows
    without a key stay as they are."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    line = Window.partitionBy(own).orderBy("ts", "id")
    numbered = rows.withColumns({"_n": F.row_number().over(line), "sides": F.count(F.lit(1)).over(Window.partitionBy(own))})
    return numbered.filter("_n = 1").drop("_n")


def matched_payees(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds person: the first alias (alias, person, place in the list) that is the row's name, or that it begins with as
    whole words. The first word of a name is the join's key, so no name meets every alias."""
    a = aliases.select(normal_name("alias").alias("_alias"), "person", F.col("place").alias("_place")).filter("_alias <> ''").withColumn("_first", F.split_part("_alias", F.lit(" "), F.lit(1)))
    names = rows.select("payee").distinct().withColumn("_name", normal_name("payee")).withColumn("_first", F.split_part("_name", F.lit(" "), F.lit(1)))
    hits = names.join(a, "_first").filter((F.col("_name") == F.col("_alias")) | F.col("_name").startswith(F.concat("_alias", F.lit(" "))))
    best = hits.groupBy("payee").agg(F.min_by("person", "_place").alias("person"))
    return rows.join(best, "payee", "left")


def tag() -> Column:
    """What a list shows beside a row."""
    return (
        F.when(F.col("refund_of").isNotNull(), "refund").when(F.col("bucket") == "card_bill", "card bill").when(F.col("bucket") == "ignored", "not counted")
        .when(F.col("bucket") == "people", "person").when(F.col("bucket").isin("in", "cashback"), "money in").otherwise("payment")
    )


def how_paid() -> Column:
    return F.when(F.col("owner_channel") == "card", F.concat(F.lit("Card "), F.col("owner_card"))).otherwise(F.upper("owner_channel"))


def search(rows: DataFrame, words: str) -> DataFrame:
    """Rows whose payee, shop, category or printed amount contains the words, in any case."""
    w = words.lower()
    found = F.lower(F.concat_ws(" ", "payee", "shop", "category")).contains(w) | F.format_number(money("cents"), 2).contains(w)
    return rows.filter(found)


def names_waiting(rows: DataFrame) -> DataFrame:
    """Payees of rows that no category was found for: how many rows and how much."""
    return rows.filter("top = 'uncategorised'").groupBy("payee").agg(F.count(F.lit(1)).alias("rows"), money(F.sum("cents")).alias("amount"))


def grouped_digits(amount: Column | str) -> Column:
    """A whole amount with commas as in 12,34,567: the last three digits, then twos."""
    n = F.abs(F.col(amount) if isinstance(amount, str) else amount).cast("bigint").cast("string")
    tail = F.right(n, F.lit(3))
    front = F.left(n, F.greatest(F.length(n) - 3, F.lit(0)))
    even = F.when(F.length(front) % 2 == 1, F.concat(F.lit(" "), front)).otherwise(front)
    spaced = F.ltrim(F.regexp_replace(even, "(..)(?!$)", "$1,"))
    return F.when(F.length(n) <= 3, n).otherwise(F.concat(spaced, F.lit(","), tail))
