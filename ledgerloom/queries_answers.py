"""Queries of answers that take bills in, and of the sides of bills' payments, over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import Period
from .functions.money import cents, money
from .operators import counted as c
from .plans import estimated, sides
from .plans.ask import Query
from .queries import COUNTED, query, rows_of
from .queries_cards import _MONTHS, _PLACED, _placed
from .sources import movements as src

_CUT, _CUT96 = Period(dt.date(1995, 3, 10), dt.date(1997, 6, 20)), Period(dt.date(1995, 1, 20), dt.date(1996, 7, 5))


def _estimates(name: str, p: Period, where: str = "true") -> str:
    """SQL of (month, whole, c) as `name`, over the bills' months `pm`."""
    first, last = f"DATE '{p.first}'", f"DATE '{p.last}'"
    return f"""{name}_all AS (SELECT card, month, CAST(floor(CAST(estimate * days AS DOUBLE) / of_days + 0.5) AS BIGINT) AS c, ms >= {first} AND last_day(ms) <= {last} AS whole FROM pm
  WHERE covered_by IS NULL AND estimate > 0 AND last_day(ms) >= {first} AND ms <= {last} AND {where}),
{name} AS (SELECT * FROM {name}_all WHERE CASE WHEN whole THEN card IN (SELECT card FROM {name}_all WHERE whole GROUP BY 1 HAVING sum(c) > 50) ELSE c > 50 END)"""


def _spent(p: Period, where: str = "true") -> str:
    return f"FROM counted WHERE bucket = 'spent' AND eff_day BETWEEN DATE '{p.first}' AND DATE '{p.last}' AND {where}"


_WITH = f"{COUNTED}, {_PLACED}, {_MONTHS}"
_CENTS = lambda x: f"CAST(coalesce({x}, 0) AS BIGINT)"


def _total_sql(spent: str, bills: str, beside: str = "CAST(NULL AS DOUBLE)") -> str:
    est = f"(SELECT {_CENTS('sum(c)')} FROM e WHERE whole)"
    return f"""{_WITH}, {_estimates('e', _CUT, bills)}, {_estimates('a', _CUT)} SELECT ({_CENTS('sum(signed)')} + {est}) / 100.0::DOUBLE AS amount, {_CENTS('sum(n)')} AS payments, {est} / 100.0::DOUBLE AS estimated,
coalesce((SELECT string_agg(month, ',' ORDER BY month) FROM (SELECT DISTINCT month FROM e WHERE NOT whole)), '') AS cut_months, {beside} AS in_bills_only {_spent(_CUT, spent)}"""


_BESIDE = "(SELECT CASE WHEN sum(c) > 50 THEN CAST(sum(c) AS BIGINT) / 100.0::DOUBLE END FROM a WHERE whole)"
for _name, _q, _sql in (
    ("total_with_estimates", Query(period=_CUT), _total_sql("true", "true")),
    ("total_of_cards_with_estimates", Query(period=_CUT, channel="card", cards=("2", "5", "2")), _total_sql("owner_channel = 'card' AND owner_card IN ('2', '5')", "card IN ('2', '5')")),
    ("total_by_upi_without_estimates", Query(period=_CUT, channel="upi"), _total_sql("owner_channel = 'upi'", "false")),
    ("total_of_a_category_beside_bills", Query(period=_CUT, categories=("1-URGENT",)), _total_sql("top = '1-URGENT'", "false", _BESIDE)),
):
    query(_name, _sql)(lambda s, d, q=_q: estimated.total(rows_of(s, d), _placed(s, d), q))

query("compare_with_estimates", f"""{_WITH}, {_estimates('e', _CUT)}, {_estimates('f', _CUT96)}, x AS (SELECT (SELECT {_CENTS('sum(c)')} FROM e WHERE whole) AS en, (SELECT {_CENTS('sum(c)')} FROM f WHERE whole) AS eb, (SELECT {_CENTS('sum(signed)')} {_spent(_CUT)}) AS sn, (SELECT {_CENTS('sum(signed)')} {_spent(_CUT96)}) AS sb)
SELECT (sn + en) / 100.0::DOUBLE AS now, (sb + eb) / 100.0::DOUBLE AS before, (sn + en - sb - eb) / 100.0::DOUBLE AS difference, (en - eb) / 100.0::DOUBLE AS of_bills FROM x""")(
    lambda s, d: estimated.compared(rows_of(s, d), _placed(s, d), Query("compare", period=_CUT, other=_CUT96)))
query("trend_with_estimates", f"""{_WITH}, {_estimates('e', _CUT)}, cal AS (SELECT strftime(x, '%Y-%m') AS month FROM generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '1997-06-01', INTERVAL 1 MONTH) AS t(x)),
s AS (SELECT strftime(eff_day, '%Y-%m') AS month, sum(signed) AS v, sum(n) AS n {_spent(_CUT)} GROUP BY 1), b AS (SELECT month, sum(c) AS v FROM e WHERE whole GROUP BY 1)
SELECT month, CAST(coalesce(s.v, 0) + coalesce(b.v, 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(s.n, 0) AS BIGINT) AS payments, CAST(coalesce(b.v, 0) AS BIGINT) / 100.0::DOUBLE AS estimated
FROM cal LEFT JOIN s USING (month) LEFT JOIN b USING (month) WHERE b.v IS NOT NULL OR month BETWEEN (SELECT min(strftime(day, '%Y-%m')) FROM m) AND (SELECT max(strftime(day, '%Y-%m')) FROM m)""")(
    lambda s, d: estimated.trend(s, rows_of(s, d), _placed(s, d), Query("trend", period=_CUT)))

# Investments are set aside with their refunds, though half of these are filed elsewhere.
query("investments_aside_with_refunds", f"""WITH {src.MOVEMENTS_SQL}, r AS (SELECT id, cents, direction, refund_of, CASE WHEN refund_of IS NOT NULL AND id % 2 = 0 THEN 'other.back' ELSE category END AS category FROM m)
SELECT split_part(coalesce(p.category, r.category), '.', 1) = 'investments' AS aside, count(*) AS rows, CAST(sum(CASE WHEN r.refund_of IS NOT NULL THEN -r.cents ELSE r.cents END) AS BIGINT) / 100.0::DOUBLE AS amount FROM r LEFT JOIN r AS p ON r.refund_of = p.id GROUP BY 1""")(lambda s, d: _aside(s, d))  # fmt: skip


def _aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = src.movements(spark, sf_dir).withColumn("category", F.when(F.expr("refund_of is not null and id % 2 = 0"), "other.back").otherwise(F.col("category")))
    of = lambda d, flag: d.groupBy(F.lit(flag).alias("aside")).agg(F.count(F.lit(1)).alias("rows"), money(F.sum("signed")).alias("amount"))
    keep, aside = c.without_investments(c.counted(moves))
    return of(keep, False).unionByName(of(aside, True))


# Sides of bills: three neighbouring orders settle one bill, some in two rows of the card, some without a row of it; the bill of
# every fifth is not on file.
_PAY_SQL = """p AS (SELECT o_orderkey AS id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'credit' ELSE 'debit' END AS direction,
CASE WHEN o_orderkey % 4 = 0 THEN 'card' ELSE 'upi' END AS channel, CAST(o_custkey % 7 AS VARCHAR) AS card, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 3 END AS settles FROM orders),
bl AS (SELECT o_orderkey // 3 AS bill, CAST(o_custkey % 7 AS VARCHAR) AS bill_card, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + o_orderkey % 4 * 25 AS bill_cents, CASE WHEN o_orderkey % 2 = 0 THEN 'app' ELSE 'statement' END AS origin FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey // 3 % 5 <> 0)"""
_SIDES_SQL = f"WITH {_PAY_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY settles ORDER BY direction = 'credit', ts, id) AS k, count(*) OVER (PARTITION BY settles) AS sides FROM p WHERE settles IS NOT NULL), g AS (SELECT * FROM o WHERE sides > 1)"


def _paying(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return src.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("cents"), F.when((k % 3 == 0) | (k % 5 == 0), "credit").otherwise("debit").alias("direction"),
        F.when(k % 4 == 0, "card").otherwise("upi").alias("channel"), (F.col("o_custkey") % 7).cast("string").alias("card"), F.when(k % 7 != 0, F.expr("o_orderkey div 3")).alias("settles"),
    )


def _bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = src.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 1 and (o_orderkey div 3) % 5 <> 0")
    return own.select(F.expr("o_orderkey div 3").alias("bill"), (F.col("o_custkey") % 7).cast("string").alias("bill_card"), (cents("o_totalprice") + k % 4 * 25).alias("bill_cents"), F.when(k % 2 == 0, "app").otherwise("statement").alias("origin"))


query("bill_sides", f"{_SIDES_SQL} SELECT settles, max(sides) AS sides, max(CASE WHEN k = 1 THEN id END) AS first, arg_min(id, k) FILTER (direction = 'debit') AS debit, arg_min(id, k) FILTER (direction = 'credit') AS credit FROM g GROUP BY 1")(
    lambda s, d: sides.bill_sides(_paying(s, d)).withColumns({"debit": F.col("debit.id"), "credit": F.col("credit.id")}))
query("bill_rows_folded", f"""{_SIDES_SQL}, shown AS (SELECT * FROM p WHERE year(day) <> 1996) SELECT id, settles FROM shown s WHERE settles IS NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.settles = s.settles AND g.k = 1 AND g.id <> s.id AND year(g.day) <> 1996)""")(
    lambda s, d: (lambda p: sides.folded(p.filter("year(day) <> 1996"), sides.bill_sides(p)).select("id", "settles"))(_paying(s, d)))
query("bill_rows_described", f"""{_SIDES_SQL}, t AS (SELECT settles, min(CASE WHEN direction = 'debit' THEN k END) AS kd, min(CASE WHEN direction = 'credit' THEN k END) AS kc FROM g GROUP BY 1),
w AS (SELECT t.settles, b.channel, b.card, b.day, x.id AS cid FROM t LEFT JOIN g b ON b.settles = t.settles AND b.k = kd LEFT JOIN g x ON x.settles = t.settles AND x.k = kc)
SELECT p.id, CASE WHEN p.direction = 'debit' THEN cid END AS card_side, CASE WHEN p.direction = 'debit' THEN 'Bill for card ' || bill_card || CASE WHEN origin = 'app' THEN ', through the app' || CASE WHEN bill_cents - p.cents >= 1 THEN '; ' || printf('%.2f', (bill_cents - p.cents) / 100.0::DOUBLE) || ' covered by rewards' ELSE '' END ELSE '' END
WHEN w.day IS NOT NULL THEN 'Paid from ' || CASE WHEN w.channel = 'card' THEN 'card ' || w.card ELSE upper(w.channel) END || ' on ' || CAST(w.day AS VARCHAR) || CASE WHEN origin = 'app' THEN ', through the app' ELSE '' END WHEN origin = 'app' THEN 'Paid through the app' END AS note
FROM p LEFT JOIN w ON w.settles = p.settles LEFT JOIN bl ON bl.bill = p.settles""")(
    lambda s, d: (lambda p: sides.described(p, sides.bill_sides(p), _bills(s, d)).select("id", "card_side", "note"))(_paying(s, d)))
