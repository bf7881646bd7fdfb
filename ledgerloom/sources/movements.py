"""Adapters: the driver's tables as ledger records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cents

#: Added to an order's number for the refund of it.
REFUND_OFFSET = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order, and a credit of a quarter, 40 days later, for some of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("o_orderkey")
    income = (F.col("o_orderstatus") == "P") & (k % 5 == 0)
    category = (
        F.when(income, "income.received").when(k % 13 == 0, "transfers.p2p").when(k % 17 == 0, "ignored").when(k % 19 == 0, "investments")
        .when(k % 23 == 0, "transfers.card_bill").otherwise(F.concat("o_orderpriority", F.lit("."), "c_mktsegment"))
    )
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        k.alias("id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("cents"), F.when(income, "credit").otherwise("debit").alias("direction"),
        F.when(k % 3 == 0, "card").otherwise("upi").alias("channel"), F.col("c_name").alias("payee"), F.col("c_mktsegment").alias("shop"), (F.col("o_custkey") % 7).cast("string").alias("card"),
        category.alias("category"), F.lit(None).cast("bigint").alias("refund_of"),
    )
    refunds = rows.filter("direction = 'debit' and id % 11 = 0").select(
        (F.col("id") + REFUND_OFFSET).alias("id"), (F.col("ts") + F.expr("interval 40 days")).alias("ts"), F.date_add("day", 40).alias("day"), F.expr("(cents + 2) div 4").alias("cents"), F.lit("credit").alias("direction"),
        "channel", "payee", "shop", "card", "category", F.col("id").alias("refund_of"),
    )
    return rows.unionByName(refunds)


MOVEMENTS_SQL = """
base AS (
  SELECT o_orderkey AS id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'credit' ELSE 'debit' END AS direction,
         CASE WHEN o_orderkey % 3 = 0 THEN 'card' ELSE 'upi' END AS channel, c_name AS payee, c_mktsegment AS shop, CAST(o_custkey % 7 AS VARCHAR) AS card,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'income.received' WHEN o_orderkey % 13 = 0 THEN 'transfers.p2p' WHEN o_orderkey % 17 = 0 THEN 'ignored'
              WHEN o_orderkey % 19 = 0 THEN 'investments' WHEN o_orderkey % 23 = 0 THEN 'transfers.card_bill' ELSE o_orderpriority || '.' || c_mktsegment END AS category,
         CAST(NULL AS BIGINT) AS refund_of
  FROM orders JOIN customer ON o_custkey = c_custkey
), m AS (
  SELECT * FROM base
  UNION ALL
  SELECT id + 1000000000, ts + INTERVAL 40 DAY, CAST(day + INTERVAL 40 DAY AS DATE), (cents + 2) // 4, 'credit', channel, payee, shop, card, category, id
  FROM base WHERE direction = 'debit' AND id % 11 = 0
)"""


def bills(moves: DataFrame) -> DataFrame:
    """One bill for each card and month of card payments: a tenth more than these, paid in the second half of the next month."""
    m = F.trunc("day", "MM")
    spent = moves.filter("channel = 'card' and direction = 'debit'").groupBy("card", m.alias("month_start")).agg(F.sum("cents").alias("_c"))
    offset = F.expr("cast((cast(card as int) * 3 + month(month_start)) % 9 + 20 as int)")
    return spent.select(
        F.concat("card", F.lit("-"), F.date_format("month_start", "yyyy-MM")).alias("bill"), "card", F.date_add(F.add_months("month_start", 1), offset).alias("paid"), F.expr("(_c * 11 + 5) div 10").alias("cents"), "month_start",
    )


BILLS_SQL = """
bills AS (
  SELECT card || '-' || strftime(ms, '%Y-%m') AS bill, card, CAST(ms + INTERVAL 1 MONTH AS DATE) + CAST((CAST(card AS INT) * 3 + month(ms)) % 9 + 20 AS INT) AS paid,
         CAST((c * 11 + 5) // 10 AS BIGINT) AS cents, ms AS month_start
  FROM (SELECT card, CAST(date_trunc('month', day) AS DATE) AS ms, CAST(sum(cents) AS BIGINT) AS c FROM m WHERE channel = 'card' AND direction = 'debit' GROUP BY ALL)
)"""


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 days for each nation, told in an order of their own; neighbours overlap."""
    k = F.col("n_nationkey")
    first = F.date_add(F.lit("1995-01-01").cast("date"), (k * 61).cast("int"))
    return table(spark, sf_dir, "nation").select(k.cast("bigint").alias("stay"), F.col("n_name").alias("place"), first.alias("first"), F.date_add(first, 89).alias("last"), (F.col("n_regionkey") * 100 + k).cast("bigint").alias("told"))


STAYS_SQL = """
stays AS (
  SELECT CAST(n_nationkey AS BIGINT) AS stay, n_name AS place, DATE '1995-01-01' + CAST(n_nationkey * 61 AS INT) AS first, DATE '1995-01-01' + CAST(n_nationkey * 61 + 89 AS INT) AS last, CAST(n_regionkey * 100 + n_nationkey AS BIGINT) AS told
  FROM nation
)"""
