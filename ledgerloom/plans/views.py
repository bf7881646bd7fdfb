"""The named figures of a period: each is one aggregation over counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import Period, fiscal_year, month_key, months_in
from ..functions.money import money


def _figures() -> list[Column]:
    return [money(F.sum("signed")).alias("amount"), F.sum("n").alias("payments")]


def bucket_totals(rows: DataFrame, by: Column) -> DataFrame:
    return rows.groupBy(by.alias("period"), "bucket").agg(*_figures())


def category_rollup(rows: DataFrame, period: Period) -> DataFrame:
    """Spending by top category (level 1) and by category below it (level 2), in one pass over the rows."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day"))
    rolled = spent.rollup("top", "category").agg(*_figures(), F.grouping_id().alias("_g")).filter("_g < 3")
    return rolled.select("top", "category", (F.lit(2) - F.col("_g")).cast("int").alias("level"), "amount", "payments")


def monthly(spark: SparkSession, rows: DataFrame, period: Period) -> DataFrame:
    """Spending of every month of the period; months without any are zero."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day")).groupBy(month_key("eff_day").alias("month")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("_n"))
    both = months_in(spark, period).join(spent, "month", "left")
    return both.select("month", money(F.coalesce("_s", F.lit(0))).alias("amount"), F.coalesce("_n", F.lit(0)).alias("payments"))


def top_groups(rows: DataFrame, key: str, period: Period, k: int) -> DataFrame:
    """The k names with the most money out, refunds taken off; people count, card bills and ignored rows do not."""
    out = rows.filter((F.col("direction") == "debit") | F.col("refund_of").isNotNull()).filter(~F.col("bucket").isin("ignored", "card_bill") & period.has("eff_day"))
    return out.groupBy(F.col(key).alias("name")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("payments")).orderBy(F.desc("_s"), "name").limit(k).select("name", money("_s").alias("amount"), "payments")


def paid_from(rows: DataFrame, period: Period) -> DataFrame:
    out = rows.filter((F.col("direction") == "debit") | F.col("refund_of").isNotNull()).filter((F.col("bucket") != "ignored") & period.has("eff_day"))
    source = F.when(F.col("owner_channel") == "card", F.concat(F.lit("card:"), "owner_card")).otherwise("account")
    return out.groupBy(source.alias("source")).agg(*_figures())


def by_card(rows: DataFrame, period: Period) -> DataFrame:
    """Spending on each card, by its number and over another channel."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day"))
    direct = F.col("owner_channel") == "card"
    part = lambda c: money(F.sum(F.when(c, F.col("signed")).otherwise(0)))
    return spent.groupBy(F.col("owner_card").alias("card")).agg(part(direct).alias("by_number"), part(~direct).alias("via_upi"), F.sum("n").alias("payments"))


def largest(rows: DataFrame, period: Period, k: int) -> DataFrame:
    """The k largest single payments, with what came back of each."""
    back = rows.filter("refund_of is not null").groupBy(F.col("refund_of").alias("id")).agg(F.sum("cents").alias("_back"))
    top = rows.filter((F.col("bucket") == "spent") & (F.col("n") == 1) & period.has("eff_day")).orderBy(F.desc("cents"), "ts", "id").limit(k)
    return top.join(back, "id", "left").select("id", "payee", "eff_day", money("cents").alias("amount"), money(F.coalesce("_back", F.lit(0))).alias("refunded"))


def review_queue(rows: DataFrame, needs_review: Column) -> DataFrame:
    """Payees with rows to look at: their sum, number and days, and how many rows of the payee need no look."""
    marked = rows.withColumn("_r", needs_review)
    only = lambda c: F.when(F.col("_r"), F.col(c))
    grouped = marked.groupBy("payee").agg(
        F.sum(only("cents")).alias("_s"), F.count(only("id")).alias("rows"), F.min(only("day")).alias("first"), F.max(only("day")).alias("last"), F.count(F.when(~F.col("_r"), 1)).alias("elsewhere"))
    return grouped.filter("rows > 0").select("payee", money("_s").alias("amount"), "rows", "first", "last", "elsewhere")


def best_year(rows: DataFrame) -> DataFrame:
    """The year with the most months that have a row, the later one on a tie."""
    months = rows.groupBy(F.year("day").alias("year")).agg(F.countDistinct(F.month("day")).alias("months"))
    return months.orderBy(F.desc("months"), F.desc("year")).limit(1)


def fiscal_totals(rows: DataFrame) -> DataFrame:
    return bucket_totals(rows, fiscal_year("eff_day"))


def compare(rows: DataFrame, now: Period, then: Period) -> DataFrame:
    """Spending in two periods, the difference and its percentage of the earlier one (null if that is zero)."""
    spent = rows.filter(F.col("bucket") == "spent")
    part = lambda p: F.coalesce(F.sum(F.when(p.has("eff_day"), F.col("signed"))), F.lit(0))
    both = spent.filter(now.has("eff_day") | then.has("eff_day")).agg(part(now).alias("_a"), part(then).alias("_b"))
    return both.select(money("_a").alias("now"), money("_b").alias("before"), money(F.col("_a") - F.col("_b")).alias("difference"), F.when(F.col("_b") != 0, (F.col("_a") - F.col("_b")) * 100 / F.col("_b")).alias("percent"))


def contribution(rows: DataFrame, key: str, now: Period, then: Period, k: int = 6) -> DataFrame:
    """What a difference between two periods is made of: the k groups that changed most, and all others in one row (rank
    k + 1). The rows sum to the whole difference exactly; groups that changed by less than half a unit are in the rest."""
    spent = rows.filter((F.col("bucket") == "spent") & (now.has("eff_day") | then.has("eff_day")))
    change = F.sum(F.when(now.has("eff_day"), F.col("signed")).otherwise(-F.col("signed")))
    groups = spent.groupBy(F.col(key).alias("name")).agg(change.alias("_d"))
    # The k best of all groups by a limit, not by a window over all of them; the rest by one aggregate.
    first = groups.filter(F.abs("_d") >= 50).orderBy(F.desc(F.abs("_d")), "name").limit(k)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("_d")), "name")))
    whole = groups.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("_all")).crossJoin(first.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("_top")))
    rest = whole.select(F.lit("everything else").alias("name"), (F.col("_all") - F.col("_top")).alias("_d"), F.lit(k + 1).alias("rank"))
    return first.unionByName(rest).select("rank", "name", money("_d").alias("difference"))


def aligned_months(rows: DataFrame, year: int) -> DataFrame:
    """Months of a year beside the same months of the year before, where both have rows."""
    spent = rows.filter((F.col("bucket") == "spent") & (F.year("eff_day") == year))
    before = rows.filter((F.col("bucket") == "spent") & (F.year("eff_day") == year - 1))
    by = lambda d, name: d.groupBy(F.month("eff_day").alias("month")).agg(F.sum("signed").alias(name))
    both = by(spent, "_a").join(by(before, "_b"), "month")
    return both.select("month", money("_a").alias("now"), money("_b").alias("before"), money(F.col("_a") - F.col("_b")).alias("difference"))


def month_matrix(spark: SparkSession, rows: DataFrame, period: Period) -> DataFrame:
    """Spending by top category and month: null where nothing at all is on file for the month, zero where something is but
    not in the category, and never below zero."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day"))
    cells = spent.groupBy("top", month_key("eff_day").alias("month")).agg(F.sum("signed").alias("_s"))
    covered = rows.filter(period.has("day")).select(month_key("day").alias("month")).distinct().withColumn("_on", F.lit(True))
    calendar = months_in(spark, period)
    # Names of top categories times the months of one period.
    grid = spent.select("top").distinct().crossJoin(calendar)
    both = grid.join(covered, "month", "left").join(cells, ["top", "month"], "left")
    return both.select("top", "month", money(F.when(F.col("_on"), F.greatest(F.coalesce("_s", F.lit(0)), F.lit(0)))).alias("amount"))


def month_table(rows: DataFrame, period: Period) -> DataFrame:
    """One row for each top category, one column for each month of the period (m01 to m12), and the sum."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day"))
    months = [money(F.sum(F.when(F.month("eff_day") == i, F.col("signed")))).alias(f"m{i:02}") for i in range(1, 13)]
    return spent.groupBy("top").agg(*months, money(F.sum("signed")).alias("together"))


def coverage(rows: DataFrame) -> DataFrame:
    """First and last month of anything on file by channel, and the number of months between that have rows."""
    m = month_key("day")
    return rows.groupBy("channel").agg(F.min(m).alias("first"), F.max(m).alias("last"), F.countDistinct(m).alias("months"))


def shops_in(rows: DataFrame, category: str, period: Period) -> DataFrame:
    """Shops of a category: amount, payments and how many spellings their payees have."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day") & ((F.col("category") == category) | (F.col("top") == category)))
    return spent.groupBy(F.col("owner_shop").alias("shop")).agg(*_figures(), F.countDistinct("owner_payee").alias("spellings"))


def top_and_rest(groups: DataFrame, n: int) -> DataFrame:
    """(name, amount) cut to the n largest, with the others in one row of rank n + 1."""
    first = groups.orderBy(F.desc("amount"), "name").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("amount"), "name")))
    rest = groups.join(first.select("name"), "name", "left_anti").agg(F.sum("amount").alias("amount")).select(F.lit("others").alias("name"), "amount", F.lit(n + 1).alias("rank"))
    return first.unionByName(rest)


def total_spend(rows: DataFrame, estimates: DataFrame, period: Period) -> DataFrame:
    """Accounts, cards and what bills add beyond them (card, estimate in cents), by part; a card's estimate counts above
    half a unit."""
    spent = rows.filter((F.col("bucket") == "spent") & period.has("eff_day"))
    direct = F.when(F.col("owner_channel") == "card", "cards").otherwise("upi")
    parts = spent.groupBy(direct.alias("part")).agg(F.sum("signed").alias("_s"))
    added = estimates.groupBy("card").agg(F.sum("estimate").alias("_e")).filter("_e > 50").agg(F.sum("_e").alias("_s")).select(F.lit("estimates").alias("part"), "_s")
    return parts.unionByName(added).select("part", money(F.coalesce("_s", F.lit(0))).alias("amount"))


def display_names(rows: DataFrame) -> DataFrame:
    """The spelling of each shop used most, the first in order of name on a tie."""
    n = rows.groupBy("shop", "payee").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("shop").agg(F.min_by("payee", F.struct(-F.col("n"), F.col("payee"))).alias("name"), F.max("n").alias("uses"))
