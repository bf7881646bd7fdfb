"""The sides of a bill's payment: the row it was paid from and the card's own row that receives it are one payment.

Rows of one bill carry its number in `settles`. Sides are told apart by direction: those paid from (debits) come first, then
those that receive (credits), each in order of time. Rows without a bill take no part in any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money


def bill_sides(rows: DataFrame) -> DataFrame:
    """(settles, sides, first, debit, credit): of each bill with two rows or more their number, the first side's id, and the first
    row of each direction (id, day, channel, card), null where there is none. Partial sums meet, never a bill's rows."""
    place = F.struct((F.col("direction") != "debit").alias("late"), "ts", "id")
    row = F.struct("id", "day", "channel", "card")
    of = lambda d: F.min_by(row, F.when(F.col("direction") == d, F.struct("ts", "id")))
    groups = rows.filter("settles is not null").groupBy("settles").agg(F.count(F.lit(1)).alias("sides"), F.min_by("id", place).alias("first"), of("debit").alias("debit"), of("credit").alias("credit"))
    return groups.filter("sides > 1")


def folded(shown: DataFrame, sides: DataFrame) -> DataFrame:
    """The rows of a list with each bill's payment once: a side goes where its bill's first side is in the list as well; one that
    is shown without it stays."""
    paying = shown.filter("settles is not null")
    firsts = sides.select("settles", "first").join(paying.select("settles", F.col("id").alias("first")), ["settles", "first"], "left_semi")
    kept = paying.join(firsts, "settles", "left").filter("first is null or first = id").select(*shown.columns)
    return shown.filter("settles is null").unionByName(kept)


def _from(side: str) -> Column:
    c = F.col(side)
    return F.when(c["channel"] == "card", F.concat(F.lit("card "), c["card"])).otherwise(F.upper(c["channel"]))


def described(rows: DataFrame, sides: DataFrame, bills: DataFrame) -> DataFrame:
    """Adds card_side and note to rows of bills: for a row paid from, the id of the card's own row, and whose bill it is, through
    what, and how much of it rewards paid; for a card's row, what it was paid from and when. `bills` (bill, bill_card, bill_cents,
    origin) come from an app or from a statement; a note is null where there is nothing to add."""
    paying = rows.filter("settles is not null").join(sides.drop("sides", "first"), "settles", "left").join(bills.withColumnRenamed("bill", "settles"), "settles", "left")
    by_app = F.coalesce(F.col("origin") != "statement", F.lit(False))
    via = F.when(by_app, ", through the app").otherwise("")
    rewards = F.col("bill_cents") - F.col("cents")
    whose = F.when(F.col("bill_card").isNotNull(), F.concat_ws("; ", F.concat(F.lit("Bill for card "), "bill_card", via), F.when(by_app & (rewards >= 1), F.concat(F.format_string("%.2f", money(rewards)), F.lit(" covered by rewards")))))
    source = F.when(F.col("debit").isNotNull(), F.concat(F.lit("Paid from "), _from("debit"), F.lit(" on "), F.col("debit.day").cast("string"), via)).when(by_app, "Paid through the app")
    debit = F.col("direction") == "debit"
    added = {"card_side": F.when(debit, F.col("credit.id")), "note": F.when(debit, whose).otherwise(source)}
    rest = rows.filter("settles is null").withColumns({"card_side": F.lit(None).cast(rows.schema["id"].dataType), "note": F.lit(None).cast("string")})
    return rest.unionByName(paying.withColumns(added).select(*rest.columns))
