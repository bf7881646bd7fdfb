"""Counted rows: every movement with the day, the sign and the owner it counts under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a refund takes from its payment.
OWNED = ("payee", "shop", "channel", "card")


def top_of(category: Column | str) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    return F.split_part(c, F.lit("."), F.lit(1))


def is_linked_refund() -> Column:
    return (F.col("direction") == "credit") & F.col("refund_of").isNotNull()


def bucket() -> Column:
    """Where a movement counts; the first rule that fits holds."""
    return (
        F.when((top_of("category") == "ignored") | (F.col("category") == "transfers.self"), "ignored")
        .when(F.col("category") == "transfers.card_bill", "card_bill")
        .when((F.col("direction") == "credit") & F.col("refund_of").isNull(), F.when(F.col("category") == "income.cashback", "cashback").otherwise("in"))
        .when(F.col("category") == "transfers.p2p", "people").otherwise("spent")
    )


def counted(moves: DataFrame) -> DataFrame:
    """Adds eff_day, signed, n, bucket, top and the owner's payee, shop, channel, card and top category.

    A linked refund counts with a minus, as no payment, on its payment's day and under its payment's names; its category
    is its own. A refund whose payment is not there stands for itself.

    Only refunds look for an owner; all other rows pass as they are, without a shuffle, their effective day the day that
    the scan reads, so a filter on it reaches the scan.
    """
    owner = moves.select(
        F.col("id").alias("_id"), F.col("day").alias("_day"), top_of("category").alias("_top"), *[F.col(c).alias(f"_{c}") for c in OWNED])
    refund = F.coalesce(is_linked_refund(), F.lit(False))
    own = {"bucket": bucket(), "top": top_of("category")}
    rest = moves.filter(~refund).withColumns({"eff_day": F.col("day"), "signed": F.col("cents"), "n": F.lit(1).cast("bigint"), **own, **{f"owner_{c}": F.col(c) for c in OWNED}, "owner_top": own["top"]})
    back = moves.filter(refund).join(owner, F.col("refund_of") == F.col("_id"), "left")
    back = back.withColumns({"eff_day": F.coalesce("_day", "day"), "signed": -F.col("cents"), "n": F.lit(0).cast("bigint"), **own, **{f"owner_{c}": F.coalesce(f"_{c}", c) for c in OWNED}, "owner_top": F.coalesce(F.col("_top"), own["top"])})
    return rest.unionByName(back.select(*rest.columns))


COUNTED_SQL = """
counted AS (
  SELECT m.*, coalesce(o.day, m.day) AS eff_day, CASE WHEN m.direction = 'credit' AND m.refund_of IS NOT NULL THEN -m.cents ELSE m.cents END AS signed,
         CAST(CASE WHEN m.direction = 'credit' AND m.refund_of IS NOT NULL THEN 0 ELSE 1 END AS BIGINT) AS n,
         CASE WHEN split_part(m.category, '.', 1) = 'ignored' OR m.category = 'transfers.self' THEN 'ignored' WHEN m.category = 'transfers.card_bill' THEN 'card_bill'
              WHEN m.direction = 'credit' AND m.refund_of IS NULL THEN CASE WHEN m.category = 'income.cashback' THEN 'cashback' ELSE 'in' END
              WHEN m.category = 'transfers.p2p' THEN 'people' ELSE 'spent' END AS bucket,
         split_part(m.category, '.', 1) AS top, coalesce(o.payee, m.payee) AS owner_payee, coalesce(o.shop, m.shop) AS owner_shop, coalesce(o.channel, m.channel) AS owner_channel, coalesce(o.card, m.card) AS owner_card,
         coalesce(split_part(o.category, '.', 1), split_part(m.category, '.', 1)) AS owner_top
  FROM m LEFT JOIN m AS o ON m.direction = 'credit' AND m.refund_of = o.id
)"""


def without_investments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that count, rows set aside): investments are set aside with their refunds, whatever these are filed under."""
    own = F.col("owner_top") == "investments"
    return rows.filter(~own), rows.filter(own)


def is_under(category: str) -> Column:
    """In a category, or in one below it."""
    return (F.col("category") == category) | (F.col("top") == category)
