"""Stays, cycles and runs: operators on closed intervals of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import cycle_end, cycle_start


def owned_days(stays: DataFrame) -> DataFrame:
    """(day, stay, place) for each day of any stay: the one told last has it, on a tie the one with the smaller number.

    Stays are typed in by people; a day's candidates are folded by an aggregate, before any shuffle of single days.
    """
    days = stays.filter("first <= last").select("stay", "place", "told", F.explode(F.sequence("first", "last")).alias("day"))
    best = F.max_by(F.struct("stay", "place"), F.struct("told", -F.col("stay")))
    return days.groupBy("day").agg(best.alias("_b")).select("day", "_b.stay", "_b.place")


def stay_summary(stays: DataFrame, rows: DataFrame) -> DataFrame:
    """For each stay: the days it has for itself, and spending and payments on them."""
    days = owned_days(stays)
    spent = rows.filter("bucket = 'spent'").groupBy(F.col("eff_day").alias("day")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("_n"))
    both = days.join(spent, "day", "left").groupBy("stay", "place").agg(
        F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("_s"), F.lit(0)).alias("cents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("payments"))
    whole = stays.select("stay", "place").join(both, ["stay", "place"], "left")
    return whole.select("stay", "place", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("days", "cents", "payments")])


def month_runs(rows: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive months in which a key has rows: first and last month and their number."""
    index = F.year("eff_day") * 12 + F.month("eff_day") - 1
    months = rows.select(key, index.alias("_i")).distinct()
    island = F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy("_i"))
    runs = months.withColumn("_g", island).groupBy(key, "_g").agg(F.min("_i").alias("_a"), F.max("_i").alias("_b"))
    name = lambda i: F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"))
    return runs.select(key, name(F.col("_a")).alias("first"), name(F.col("_b")).alias("last"), (F.col("_b") - F.col("_a") + 1).cast("bigint").alias("months"))


def usual_day(day: Column) -> Column:
    """The mean of days of the month on a circle, as an aggregate: 31 and 1 lie side by side."""
    angle = F.radians((F.dayofmonth(day) - 1) * (360.0 / 31))
    turn = F.atan2(F.sum(F.round(F.sin(angle), 9)), F.sum(F.round(F.cos(angle), 9)))
    days = F.round(F.degrees(turn) * (31.0 / 360), 6)
    return (F.floor(F.pmod(F.floor(days + 0.5), F.lit(31))) + 1).cast("int")


def cycles_of(bills: DataFrame, lead: int = 10) -> DataFrame:
    """Adds cycle_day, cycle_first and cycle_last to bills (card, paid): the usual day of each card's bills, `lead` days
    before they were paid, and the cycle that ended then."""
    days = bills.groupBy("card").agg(usual_day(F.date_sub("paid", lead)).alias("cycle_day"))
    placed = bills.join(days, "card").withColumn("cycle_last", cycle_end(F.date_sub("paid", 1), "cycle_day"))
    return placed.withColumn("cycle_first", cycle_start("cycle_last", "cycle_day"))


def estimates(bills: DataFrame, rows: DataFrame) -> DataFrame:
    """(card, cycle_first, cycle_last, paid_cents, charges, counted, estimate): what a bill pays beyond the rows on file.

    `counted` are the charges in a cycle and what the cycles before left over; the estimate is the rest of the payment.
    What is left over, carry_i = max(0, charges_i - paid_i + carry_{i-1}), is a running sum reflected at zero: inside a run
    of consecutive cycles it is the sum so far less the lowest sum so far (or zero), so two windows give it.
    """
    per_cycle = bills.groupBy("card", "cycle_first", "cycle_last").agg(F.sum("cents").alias("paid_cents"))
    charge = F.when((F.col("direction") == "debit") & (F.col("category") != "transfers.card_bill"), F.col("cents")).when((F.col("refund_of").isNotNull()) & (F.col("direction") == "credit"), -F.col("cents")).otherwise(0)
    charges = rows.filter("channel = 'card'").withColumn("_c", charge).groupBy("card", "day").agg(F.sum("_c").alias("_c"))
    # A cycle stands once for each month it touches, so the join is on card and month.
    months = per_cycle.withColumn("_m", F.explode(F.sequence(F.trunc("cycle_first", "MM"), F.trunc("cycle_last", "MM"), F.expr("interval 1 month"))))
    inside = months.join(charges.withColumn("_m", F.trunc("day", "MM")), ["card", "_m"]).filter("day between cycle_first and cycle_last")
    cycle = ["card", "cycle_first", "cycle_last"]
    own = per_cycle.join(inside.groupBy(*cycle).agg(F.sum("_c").alias("charges")), cycle, "left").withColumn("charges", F.coalesce("charges", F.lit(0)))
    line = Window.partitionBy("card").orderBy("cycle_first", "cycle_last")
    new = F.coalesce((F.date_add(F.lag("cycle_last").over(line), 1) != F.col("cycle_first")).cast("int"), F.lit(1))
    own = own.withColumn("_run", F.sum(new).over(line))  # a cycle that does not follow the last starts a run
    run = Window.partitionBy("card", "_run").orderBy("cycle_first", "cycle_last")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_s", F.sum(F.col("charges") - F.col("paid_cents")).over(so_far))
    own = own.withColumn("_carry", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    counted = F.col("charges") + F.coalesce(F.lag("_carry").over(run), F.lit(0))
    own = own.withColumn("counted", counted)
    return own.select("card", "cycle_first", "cycle_last", "paid_cents", "charges", "counted", F.greatest(F.col("paid_cents") - F.col("counted"), F.lit(0)).alias("estimate"))


def covered_by(bills: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds covered_by to bills with a cycle: the first statement of the card (by its start, then its name) that contains
    the whole cycle, null if none does."""
    # A statement stands once for each month it touches; a cycle that it contains begins in one of them.
    s = statements.select("card", "statement", "first", "last", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))).alias("_m"))
    cycles = bills.select("card", "cycle_first", "cycle_last").distinct().withColumn("_m", F.trunc("cycle_first", "MM"))
    hits = cycles.join(s, ["card", "_m"]).filter("first <= cycle_first and last >= cycle_last")
    best = hits.groupBy("card", "cycle_first", "cycle_last").agg(F.min_by("statement", F.struct("first", "statement")).alias("covered_by"))
    return bills.join(best, ["card", "cycle_first", "cycle_last"], "left").select(*bills.columns, "covered_by")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, within: str) -> DataFrame:
    """Each row of `left` with the latest row of `right` of the same `by` at or before its time, if no older than `within`.

    The two are stacked and ordered once by key and time, so one shuffle and one running `last` do it: nothing is
    multiplied, whatever the number of rows of a key. `left` has id, by, at; `right` has by, at, value.
    """
    stacked = left.select("id", by, at, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side")).unionByName(
        right.select(F.lit(None).cast(left.schema["id"].dataType).alias("id"), by, at, F.col(value).alias("_v"), F.col(at).alias("_t"), F.lit(0).alias("_side")))
    line = Window.partitionBy(by).orderBy(at, "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_v", "_t")), ignorenulls=True).over(line)
    found = stacked.withColumn("_l", last).filter("_side = 1")
    near = F.col("_l._t") >= F.col(at) - F.expr(f"interval {within}")
    return found.select("id", by, at, F.when(near, F.col("_l._v")).alias(value), F.when(near, F.col("_l._t")).alias("matched_at"))


def occurrence(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence, from 1: which of the rows that are alike in `keys` a row is."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def balances_hold(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, rows, holds): whether each balance differs from the one before by exactly the row's cents, up or down."""
    line = Window.partitionBy(key).orderBy(*order)
    step = F.abs(F.col("balance") - F.lag("balance").over(line))
    fine = rows.withColumn("_ok", F.coalesce(step == F.abs("cents"), F.lit(True)))
    return fine.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.bool_and("_ok").alias("holds"))


def clusters(rows: DataFrame, key: str, position: str, gap: float) -> DataFrame:
    """Adds cluster, from 0: within a key, positions further than `gap` apart part clusters."""
    line = Window.partitionBy(key).orderBy(position)
    new = F.coalesce((F.col(position) - F.lag(position).over(line) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(line)).drop("_new")


def filled_down(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """A missing value is taken from the nearest row above it in the same key."""
    line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(line))
