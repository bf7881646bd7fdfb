"""What is said beside figures: labels, what waits, how reading went, what an answer leaves out, and what to ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import Period, month_key, prorated
from ..functions.money import money
from ..functions.text import payee_matches, place_key


def labelled(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds label and parent_label to rows by their category; categories (id, label, parent) are a tree of two levels."""
    own = categories.select(F.col("id").alias("category"), "label", F.col("parent").alias("_p"))
    up = categories.select(F.col("id").alias("_p"), F.col("label").alias("parent_label"))
    return rows.join(F.broadcast(own.join(up, "_p", "left").drop("_p")), "category", "left")  # a tree that people keep


def waiting(rows: DataFrame, period: Period) -> DataFrame:
    """One row: payments in a period that no payee's name stands for, how many and how much."""
    return rows.filter(period.has("eff_day") & (F.trim("payee") == "")).agg(F.count(F.lit(1)).alias("rows"), money(F.coalesce(F.sum("cents"), F.lit(0))).alias("amount"))


def run_times(files: DataFrame) -> DataFrame:
    """(batch, files, read, failed, waiting, seconds) of files (batch, status, queued, finished): from the first queued to the last finished."""
    took = F.unix_seconds(F.max("finished").cast("timestamp")) - F.unix_seconds(F.min("queued").cast("timestamp"))
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    return files.groupBy("batch").agg(F.count(F.lit(1)).alias("files"), of("read").alias("read"), of("failed").alias("failed"), of("waiting").alias("waiting"), took.alias("seconds"))


def files_summary(files: DataFrame) -> DataFrame:
    """(kind, files, missing, bytes) of files (kind, size, found)."""
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(~F.col("found"), 1)).alias("missing"), F.coalesce(F.sum(F.when(F.col("found"), F.col("size"))), F.lit(0)).alias("bytes"))


def kept(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table: what a fresh start would move away."""
    parts = [d.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def payment_sources(lines: DataFrame) -> DataFrame:
    """(file, mask, rows): the masks of accounts and cards that lines (file, text) name."""
    masks = lines.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"\b(X{2,}[0-9]{2,4})\b"), F.lit(1))).alias("mask"))
    return masks.groupBy("file", "mask").agg(F.count(F.lit(1)).alias("rows"))


def told_before(stays: DataFrame) -> DataFrame:
    """(key, region, place, told): of the places of one name the last told in each state."""
    return stays.filter("region is not null").groupBy(place_key("place").alias("key"), "region").agg(F.max_by("place", "told").alias("place"), F.max("told").alias("told"))


def distinct_places(stays: DataFrame) -> DataFrame:
    """(key, place): names that differ in case or marks alone are one; the one told last is shown."""
    return stays.groupBy(place_key("place").alias("key")).agg(F.max_by("place", F.struct("told", "place")).alias("place"))


def still_shown(ticked: DataFrame, shown: DataFrame) -> DataFrame:
    """The ticked ids that a filter still shows."""
    return ticked.select("id").distinct().join(shown.select("id"), "id", "left_semi")


def _best(rows: DataFrame, key: str, what: str) -> DataFrame:
    sums = rows.groupBy(F.col(key).cast("string").alias("name")).agg(F.sum("signed").alias("_s")).filter("_s > 50")
    return sums.orderBy(F.desc("_s"), "name").limit(1).select(F.lit(what).alias("what"), "name", money("_s").alias("amount"))


def highlights(rows: DataFrame, period: Period) -> DataFrame:
    """(what, name, amount): the biggest payment, the shop and the month with most spending, and spending against the period before
    over the months of the year that both have."""
    spent = rows.filter("bucket = 'spent'")
    now, then = spent.filter(period.has("eff_day")), spent.filter(period.before().has("eff_day"))
    biggest = now.filter("n = 1").orderBy(F.desc("cents"), "ts", "id").limit(1).select(F.lit("biggest").alias("what"), F.col("owner_payee").alias("name"), money("cents").alias("amount"))
    by_month = lambda d, c: d.groupBy(F.month("eff_day").alias("_m")).agg(F.sum("signed").alias(c))
    both = by_month(now, "_a").join(by_month(then, "_b"), "_m").agg(F.count(F.lit(1)).cast("string").alias("name"), money(F.coalesce(F.sum(F.col("_a") - F.col("_b")), F.lit(0))).alias("amount"))
    months = now.withColumn("_month", month_key("eff_day"))
    return biggest.unionByName(_best(now, "owner_shop", "shop")).unionByName(_best(months, "_month", "month")).unionByName(both.select(F.lit("against").alias("what"), "name", "amount"))


def whole_month_estimates(bills: DataFrame, period: Period) -> DataFrame:
    """(month, cents, whole): estimates (card, cycle_first, cycle_last, estimate) of bills without a statement, by month: of months that lie
    in the period whole what is counted (a card with half a unit or less is not), of those it cuts what is left out."""
    parts = prorated(bills.filter("covered_by is null and estimate > 0"), "cycle_first", "cycle_last")
    first = F.to_date(F.concat("month", F.lit("-01")))
    parts = parts.withColumn("_c", F.floor(F.col("estimate") * F.col("days") / F.col("of_days") + 0.5).cast("bigint"))
    parts = parts.withColumn("whole", (first >= F.lit(period.first)) & (F.last_day(first) <= F.lit(period.last)))
    parts = parts.filter((F.last_day(first) >= F.lit(period.first)) & (first <= F.lit(period.last)))
    enough = parts.filter("whole").groupBy("card").agg(F.sum("_c").alias("_s")).filter("_s > 50").select("card")
    counted = parts.filter("whole").join(enough, "card", "left_semi").unionByName(parts.filter("not whole and _c > 50"))
    return counted.groupBy("month", "whole").agg(F.sum("_c").alias("cents"))


def _exists(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias(name))


def beside(rows: DataFrame, held: DataFrame, period: Period, words: tuple[str, ...] = ()) -> DataFrame:
    """One row about an answer: held statements (first, last) that reach into its period, whether files start after it, what is left
    out as investments in it, and which words no payee matched."""
    inside = held.filter((F.col("first") <= F.lit(period.last)) & (F.col("last") >= F.lit(period.first))).agg(F.count(F.lit(1)).alias("held"))
    own = period.has("eff_day") & (F.col("top") == "investments")
    unmatched = [F.when(F.coalesce(F.bool_or(payee_matches("owner_payee", w)), F.lit(False)), None).otherwise(F.lit(w)) for w in words]
    told = rows.agg(
        (F.min(month_key("day")) > f"{period.first:%Y-%m}").alias("starts_later"), F.min(month_key("day")).alias("starts"), money(F.coalesce(F.sum(F.when(own, F.col("signed"))), F.lit(0))).alias("left_out"),
        F.concat_ws(",", *unmatched).alias("unmatched") if words else F.lit("").alias("unmatched"),
    )
    return inside.crossJoin(told)  # one row each


def why_nothing(rows: DataFrame, period: Period, word: str) -> DataFrame:
    """One row: why an answer is empty: nothing on file in the period, no such payee, or no payments to it then."""
    found = rows.agg(
        F.coalesce(F.bool_or(period.has("day")), F.lit(False)).alias("_file"), F.coalesce(F.bool_or(payee_matches("payee", word)), F.lit(False)).alias("_payee"),
        F.coalesce(F.bool_or(payee_matches("payee", word) & period.has("eff_day")), F.lit(False)).alias("_then"))
    return found.select(F.when(~F.col("_file"), "nothing on file").when(~F.col("_payee"), "no such payee").when(~F.col("_then"), "no payments").otherwise("payments").alias("reason"))


def suggestions(rows: DataFrame) -> DataFrame:
    """(place, question) to begin with: the latest year's largest category, whom most went to, and that year against the one before."""
    years = rows.agg(F.max(F.year("day")).alias("_y"), F.min(F.year("day")).alias("_first"))
    spent = rows.filter("bucket = 'spent'").join(F.broadcast(years), F.year("eff_day") == F.col("_y"))  # one row
    top = spent.groupBy("top", "_y").agg(F.sum("signed").alias("_s")).filter("_s > 50").orderBy(F.desc("_s"), "top").limit(1)
    year = F.col("_y").cast("string")
    a = top.select(F.lit(1).alias("place"), F.concat(F.lit("How much on "), F.lower("top"), F.lit(" in "), year, F.lit("?")).alias("question"))
    b = years.select(F.lit(2).alias("place"), F.concat(F.lit("Top 5 payees in "), year).alias("question"))
    c = years.select(F.lit(3).alias("place"), F.when(F.col("_first") < F.col("_y"), F.concat(F.lit("Compare "), (F.col("_y") - 1).cast("string"), F.lit(" and "), year)).otherwise(F.concat(F.lit("Biggest payments in "), year)).alias("question"))
    return a.unionByName(b).unionByName(c)
