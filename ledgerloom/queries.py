"""The registered queries of the ledger operators over the driver's tables, each beside the SQL that gives the same rows.

Money is in cents until the last division, ties are broken by a unique column, and nothing is limited but top-k reports.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, money, text
from .functions.dates import Period
from .operators import counted as c
from .operators import intervals, matching, rules
from .plans import ask, bills, views
from .sources import movements as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COUNTED = f"WITH {src.MOVEMENTS_SQL}, {c.COUNTED_SQL}"
Y1998, Y1997 = Period.year(1998), Period.year(1997)
_IN98, _IN97 = "eff_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'", "eff_day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.counted(src.movements(spark, sf_dir))


def _view(name: str, sql: str, plan: Callable[[SparkSession, DataFrame], DataFrame]) -> None:
    query(name, f"{COUNTED} {sql}")(lambda spark, sf_dir: plan(spark, rows_of(spark, sf_dir)))


_FIG = "CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(sum(n) AS BIGINT) AS payments"

query("movements", f"WITH {src.MOVEMENTS_SQL} SELECT id, ts, day, cents, direction, channel, payee, shop, card, category, refund_of FROM m")(src.movements)
_view("counted_rows", "SELECT id, eff_day, signed, n, bucket, top, owner_payee, owner_shop, owner_channel, owner_card FROM counted",
      lambda s, r: r.select("id", "eff_day", "signed", "n", "bucket", "top", "owner_payee", "owner_shop", "owner_channel", "owner_card"))
_view("bucket_totals_by_year", f"SELECT CAST(year(eff_day) AS INT) AS period, bucket, {_FIG} FROM counted GROUP BY 1, 2", lambda s, r: views.bucket_totals(r, F.year("eff_day")))
_view("category_rollup_year", f"""SELECT top, category, CAST(CASE WHEN grouping(category) = 1 THEN 1 ELSE 2 END AS INT) AS level, {_FIG}
FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY GROUPING SETS ((top), (top, category))""", lambda s, r: views.category_rollup(r, Y1998))  # fmt: skip
_view("monthly_spend_gapfilled", f""", cal AS (SELECT strftime(x, '%Y-%m') AS month FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH) AS t(x)),
s AS (SELECT strftime(eff_day, '%Y-%m') AS month, sum(signed) AS s, sum(n) AS n FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1)
SELECT month, CAST(coalesce(s, 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(n, 0) AS BIGINT) AS payments FROM cal LEFT JOIN s USING (month)""", lambda s, r: views.monthly(s, r, Y1998))  # fmt: skip
_OUT = "(direction = 'debit' OR refund_of IS NOT NULL)"
for _key, _name in (("owner_shop", "top_shops_net_refunds"), ("owner_payee", "top_payees_net_refunds")):
    _view(_name, f"SELECT {_key} AS name, {_FIG} FROM counted WHERE {_OUT} AND bucket NOT IN ('ignored', 'card_bill') AND {_IN98} GROUP BY 1 ORDER BY sum(signed) DESC, 1 LIMIT 10",
          lambda s, r, k=_key: views.top_groups(r, k, Y1998, 10))
_view("paid_from_sources", f"SELECT CASE WHEN owner_channel = 'card' THEN 'card:' || owner_card ELSE 'account' END AS source, {_FIG} FROM counted WHERE {_OUT} AND bucket <> 'ignored' AND {_IN98} GROUP BY 1",
      lambda s, r: views.paid_from(r, Y1998))
_view("spend_by_card_channel", f"""SELECT owner_card AS card, CAST(sum(CASE WHEN owner_channel = 'card' THEN signed ELSE 0 END) AS BIGINT) / 100.0::DOUBLE AS by_number,
CAST(sum(CASE WHEN owner_channel = 'card' THEN 0 ELSE signed END) AS BIGINT) / 100.0::DOUBLE AS via_upi, CAST(sum(n) AS BIGINT) AS payments FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1""", lambda s, r: views.by_card(r, Y1998))  # fmt: skip
_view("largest_payments_with_refunded", f"""SELECT t.id, t.payee, t.eff_day, t.cents / 100.0::DOUBLE AS amount, CAST(coalesce(b.s, 0) AS BIGINT) / 100.0::DOUBLE AS refunded
FROM (SELECT * FROM counted WHERE bucket = 'spent' AND n = 1 AND {_IN98} ORDER BY cents DESC, ts, id LIMIT 10) t
LEFT JOIN (SELECT refund_of, sum(cents) AS s FROM counted WHERE refund_of IS NOT NULL GROUP BY 1) b ON b.refund_of = t.id""", lambda s, r: views.largest(r, Y1998, 10))  # fmt: skip
_view("review_queue", """SELECT payee, CAST(sum(CASE WHEN id % 29 = 0 THEN cents END) AS BIGINT) / 100.0::DOUBLE AS amount, count(CASE WHEN id % 29 = 0 THEN 1 END) AS rows, min(CASE WHEN id % 29 = 0 THEN day END) AS first,
max(CASE WHEN id % 29 = 0 THEN day END) AS last, count(CASE WHEN id % 29 <> 0 THEN 1 END) AS elsewhere FROM counted GROUP BY 1 HAVING count(CASE WHEN id % 29 = 0 THEN 1 END) > 0""", lambda s, r: views.review_queue(r, F.col("id") % 29 == 0))  # fmt: skip
_view("best_year", "SELECT CAST(year(day) AS INT) AS year, count(DISTINCT month(day)) AS months FROM counted GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1", lambda s, r: views.best_year(r))
_view("fiscal_year_totals", f"SELECT CAST(year(eff_day + INTERVAL 9 MONTH) AS INT) AS period, bucket, {_FIG} FROM counted GROUP BY 1, 2", lambda s, r: views.fiscal_totals(r))
_AB = f"coalesce(sum(CASE WHEN {_IN98} THEN signed END), 0) AS a, coalesce(sum(CASE WHEN {_IN97} THEN signed END), 0) AS b"
_D = "CAST(a AS BIGINT) / 100.0::DOUBLE AS now, CAST(b AS BIGINT) / 100.0::DOUBLE AS before, CAST(a - b AS BIGINT) / 100.0::DOUBLE AS difference"
_view("period_compare", f"SELECT {_D}, CASE WHEN b <> 0 THEN CAST((a - b) * 100 AS DOUBLE) / CAST(b AS DOUBLE) END AS percent FROM (SELECT {_AB} FROM counted WHERE bucket = 'spent')", lambda s, r: views.compare(r, Y1998, Y1997))
_view("why_contribution_top6_rest", f""", g AS (SELECT owner_payee AS name, CAST(sum(CASE WHEN {_IN98} THEN signed ELSE -signed END) AS BIGINT) AS d FROM counted WHERE bucket = 'spent' AND ({_IN98} OR {_IN97}) GROUP BY 1),
f AS (SELECT CAST(row_number() OVER (ORDER BY abs(d) DESC, name) AS INT) AS rank, name, d FROM g WHERE abs(d) >= 50 ORDER BY 1 LIMIT 6)
SELECT rank, name, d / 100.0::DOUBLE AS difference FROM f UNION ALL
SELECT 7, 'everything else', CAST((SELECT coalesce(sum(d), 0) FROM g) - (SELECT coalesce(sum(d), 0) FROM f) AS BIGINT) / 100.0::DOUBLE""", lambda s, r: views.contribution(r, "owner_payee", Y1998, Y1997))  # fmt: skip
_view("yoy_aligned_months", f""", a AS (SELECT month(eff_day) AS month, sum(signed) AS a FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1), b AS (SELECT month(eff_day) AS month, sum(signed) AS b FROM counted WHERE bucket = 'spent' AND {_IN97} GROUP BY 1)
SELECT CAST(month AS INT) AS month, {_D} FROM a JOIN b USING (month)""", lambda s, r: views.aligned_months(r, 1998))  # fmt: skip
_LATE = Period(dt.date(2001, 1, 1), dt.date(2002, 6, 30))
_view("month_matrix_null_vs_zero", """, p AS (SELECT * FROM counted WHERE bucket = 'spent' AND eff_day BETWEEN DATE '2001-01-01' AND DATE '2002-06-30'),
cal AS (SELECT strftime(x, '%Y-%m') AS month FROM generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH) AS t(x)),
cov AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month, true AS on_file FROM counted WHERE day BETWEEN DATE '2001-01-01' AND DATE '2002-06-30'),
cells AS (SELECT top, strftime(eff_day, '%Y-%m') AS month, sum(signed) AS s FROM p GROUP BY 1, 2)
SELECT top, month, CASE WHEN on_file THEN CAST(greatest(coalesce(s, 0), 0) AS BIGINT) / 100.0::DOUBLE END AS amount
FROM (SELECT DISTINCT top FROM p) CROSS JOIN cal LEFT JOIN cov USING (month) LEFT JOIN cells USING (top, month)""", lambda s, r: views.month_matrix(s, r, _LATE))  # fmt: skip
_MM = ", ".join(f"CAST(sum(CASE WHEN month(eff_day) = {i} THEN signed END) AS BIGINT) / 100.0::DOUBLE AS m{i:02}" for i in range(1, 13))
_view("month_table_pivot", f"SELECT top, {_MM}, CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE AS together FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1", lambda s, r: views.month_table(r, Y1998))
_view("coverage_by_channel", "SELECT channel, min(strftime(day, '%Y-%m')) AS first, max(strftime(day, '%Y-%m')) AS last, count(DISTINCT strftime(day, '%Y-%m')) AS months FROM counted GROUP BY 1", lambda s, r: views.coverage(r))
_view("shops_in_category", f"SELECT owner_shop AS shop, {_FIG}, count(DISTINCT owner_payee) AS spellings FROM counted WHERE bucket = 'spent' AND {_IN98} AND (category = '1-URGENT' OR top = '1-URGENT') GROUP BY 1", lambda s, r: views.shops_in(r, "1-URGENT", Y1998))
_view("top_categories_and_rest", f""", g AS (SELECT category AS name, CAST(sum(signed) AS BIGINT) AS amount FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1),
f AS (SELECT name, amount, CAST(row_number() OVER (ORDER BY amount DESC, name) AS INT) AS rank FROM g ORDER BY 3 LIMIT 4)
SELECT name, amount, rank FROM f UNION ALL SELECT 'others', CAST(sum(amount) AS BIGINT), 5 FROM g WHERE name NOT IN (SELECT name FROM f)""",
      lambda s, r: views.top_and_rest(r.filter((F.col("bucket") == "spent") & Y1998.has("eff_day")).groupBy(F.col("category").alias("name")).agg(F.sum("signed").alias("amount")), 4))
_view("investments_set_aside", f"SELECT top = 'investments' AS aside, {_FIG} FROM counted GROUP BY 1",
      lambda s, r: _aside(r))
_view("shop_display_name", """, g AS (SELECT shop, payee, count(*) AS n FROM counted GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY n DESC, payee) AS k FROM g)
SELECT shop, payee AS name, n AS uses FROM k WHERE k = 1""", lambda s, r: views.display_names(r))  # fmt: skip


def _aside(rows: DataFrame) -> DataFrame:
    keep, aside = c.without_investments(rows)
    total = lambda d, flag: d.groupBy(F.lit(flag).alias("aside")).agg(money.money(F.sum("signed")).alias("amount"), F.sum("n").alias("payments"))
    return total(keep, False).unionByName(total(aside, True))


# Questions.
_Q = {
    "ask_total": (ask.Query(period=Y1998), f"SELECT CAST(coalesce(sum(signed), 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments FROM counted WHERE bucket = 'spent' AND {_IN98}"),
    "ask_count": (ask.Query("count", Y1998, channel="card"), f"SELECT CAST(coalesce(sum(signed), 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments FROM counted WHERE bucket = 'spent' AND {_IN98} AND owner_channel = 'card'"),
    "ask_average": (ask.Query("average", Y1998), f"SELECT CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE / CAST(sum(n) AS DOUBLE) AS average, CAST(sum(n) AS BIGINT) AS payments FROM counted WHERE bucket = 'spent' AND {_IN98}"),
    "ask_average_month": (ask.Query("average", Y1998, per="month"), f"""SELECT CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE / (max(year(eff_day) * 12 + month(eff_day)) - min(year(eff_day) * 12 + month(eff_day)) + 1) AS average,
        CAST(max(year(eff_day) * 12 + month(eff_day)) - min(year(eff_day) * 12 + month(eff_day)) + 1 AS BIGINT) AS months FROM counted WHERE bucket = 'spent' AND {_IN98}"""),
    "ask_top": (ask.Query("top", Y1998, by="child", limit=7), f"SELECT category AS name, {_FIG} FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1 HAVING sum(signed) > 50 ORDER BY sum(signed) DESC, 1 LIMIT 7"),
    "ask_largest": (ask.Query("largest", Y1998, categories=("2-HIGH",)), f"SELECT id, owner_payee, eff_day, cents / 100.0::DOUBLE AS amount FROM counted WHERE bucket = 'spent' AND {_IN98} AND (category = '2-HIGH' OR top = '2-HIGH') AND n = 1 ORDER BY cents DESC, ts, id LIMIT 5"),
    "ask_compare": (ask.Query("compare", Y1998), f"SELECT {_D} FROM (SELECT {_AB} FROM counted WHERE bucket = 'spent')"),
    "ask_why": (ask.Query("why", Y1998), f""", g AS (SELECT top AS name, CAST(sum(CASE WHEN {_IN98} THEN signed ELSE -signed END) AS BIGINT) AS d FROM counted WHERE bucket = 'spent' AND ({_IN98} OR {_IN97}) GROUP BY 1),
        f AS (SELECT CAST(row_number() OVER (ORDER BY abs(d) DESC, name) AS INT) AS rank, name, d FROM g WHERE abs(d) >= 50 ORDER BY 1 LIMIT 6)
        SELECT rank, name, d / 100.0::DOUBLE AS difference FROM f UNION ALL SELECT 7, 'everything else', CAST((SELECT coalesce(sum(d), 0) FROM g) - (SELECT coalesce(sum(d), 0) FROM f) AS BIGINT) / 100.0::DOUBLE"""),
    "ask_trend": (ask.Query("trend", _LATE), """, cal AS (SELECT strftime(x, '%Y-%m') AS month FROM generate_series(TIMESTAMP '2001-01-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH) AS t(x)),
        s AS (SELECT strftime(eff_day, '%Y-%m') AS month, sum(signed) AS s, sum(n) AS n FROM counted WHERE bucket = 'spent' AND eff_day BETWEEN DATE '2001-01-01' AND DATE '2002-06-30' GROUP BY 1)
        SELECT month, CAST(coalesce(s, 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(n, 0) AS BIGINT) AS payments FROM cal LEFT JOIN s USING (month)
        WHERE month BETWEEN (SELECT min(strftime(day, '%Y-%m')) FROM counted) AND (SELECT max(strftime(day, '%Y-%m')) FROM counted)"""),
    "ask_list": (ask.Query("list", Y1998, cards=("3",), limit=20), f"SELECT id, owner_payee, eff_day, signed / 100.0::DOUBLE AS amount FROM counted WHERE bucket = 'spent' AND {_IN98} AND owner_card = '3' ORDER BY eff_day DESC, cents DESC, id LIMIT 20"),
    "ask_last": (ask.Query("last", Y1998), f"SELECT id, owner_payee, eff_day, signed / 100.0::DOUBLE AS amount FROM counted WHERE bucket = 'spent' AND {_IN98} AND n = 1 ORDER BY ts DESC, id DESC LIMIT 1"),
    "ask_payee": (ask.Query("total", None, payees=("customer#000000011",)), "SELECT CAST(coalesce(sum(signed), 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments FROM counted WHERE bucket IN ('spent', 'people') AND contains(regexp_replace(lower(owner_payee), '[^a-z0-9]', '', 'g'), 'customer000000011')"),
}
for _name, (_query, _sql) in _Q.items():
    _view(_name, _sql, lambda s, r, q=_query: ask.answer(s, r, q))

# Intervals, cycles and runs.
_STAYS = f"WITH {src.STAYS_SQL}"
_OWNED = """, d AS (SELECT stay, place, told, CAST(x AS DATE) AS day FROM stays, generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY) AS t(x)),
owned AS (SELECT day, stay, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY told DESC, stay) AS k FROM d) WHERE k = 1)"""
query("interval_month_proration", f"""{_STAYS}, x AS (SELECT stay, first, last, CAST(m AS DATE) AS m FROM stays, generate_series(date_trunc('month', first), CAST(last AS TIMESTAMP), INTERVAL 1 MONTH) AS t(m))
SELECT stay, strftime(m, '%Y-%m') AS month, CAST(date_diff('day', greatest(m, first), least(last_day(m), last)) + 1 AS INT) AS days, CAST(date_diff('day', first, last) + 1 AS INT) AS of_days,
(date_diff('day', greatest(m, first), least(last_day(m), last)) + 1) / CAST(date_diff('day', first, last) + 1 AS DOUBLE) AS share FROM x""")(
    lambda s, d: dates.prorated(src.stays(s, d), "first", "last").select("stay", "month", "days", "of_days", "share"))
query("stay_latest_wins", f"{_STAYS}{_OWNED} SELECT day, stay, place FROM owned")(lambda s, d: intervals.owned_days(src.stays(s, d)))
query("stay_summary", f"""{COUNTED}, {src.STAYS_SQL}{_OWNED}, s AS (SELECT eff_day AS day, sum(signed) AS s, sum(n) AS n FROM counted WHERE bucket = 'spent' GROUP BY 1),
o AS (SELECT stay, count(*) AS days, sum(s) AS s, sum(n) AS n FROM owned LEFT JOIN s USING (day) GROUP BY 1)
SELECT stays.stay, place, coalesce(days, 0) AS days, CAST(coalesce(s, 0) AS BIGINT) AS cents, CAST(coalesce(n, 0) AS BIGINT) AS payments FROM stays LEFT JOIN o ON o.stay = stays.stay""")(
    lambda s, d: intervals.stay_summary(src.stays(s, d), rows_of(s, d)))
query("month_runs", f"""{COUNTED}, i AS (SELECT DISTINCT payee, year(eff_day) * 12 + month(eff_day) - 1 AS i FROM counted), g AS (SELECT payee, i, i - row_number() OVER (PARTITION BY payee ORDER BY i) AS g FROM i)
SELECT payee, printf('%04d-%02d', min(i) // 12, min(i) % 12 + 1) AS first, printf('%04d-%02d', max(i) // 12, max(i) % 12 + 1) AS last, CAST(max(i) - min(i) + 1 AS BIGINT) AS months FROM g GROUP BY payee, g""")(
    lambda s, d: intervals.month_runs(rows_of(s, d), "payee"))
_BILLS = f"WITH {src.MOVEMENTS_SQL}, {src.BILLS_SQL}"
_END = "CASE WHEN least({m} + CAST({k} - 1 AS INT), last_day({m})) <= {d} THEN least({m} + CAST({k} - 1 AS INT), last_day({m})) ELSE least(CAST({m} - INTERVAL 1 MONTH AS DATE) + CAST({k} - 1 AS INT), last_day(CAST({m} - INTERVAL 1 MONTH AS DATE))) END"


def _end_sql(day: str, k: str) -> str:
    return _END.format(m=f"CAST(date_trunc('month', {day}) AS DATE)", k=k, d=day)


query("cycle_end_on_or_before", f"{_BILLS} SELECT bill, CAST(CAST(card AS INT) * 4 + 6 AS INT) AS cycle_day, {_end_sql('paid', '(CAST(card AS INT) * 4 + 6)')} AS cycle_end FROM bills")(
    lambda s, d: src.bills(src.movements(s, d)).withColumn("cycle_day", (F.col("card").cast("int") * 4 + 6).cast("int")).select("bill", "cycle_day", dates.cycle_end("paid", "cycle_day").alias("cycle_end")))
_USUAL = """, ang AS (SELECT card, radians((day(paid - INTERVAL 10 DAY) - 1) * (360.0::DOUBLE / 31)) AS a FROM bills),
usual AS (SELECT card, CAST(((CAST(floor(round(degrees(atan2(sum(round(sin(a), 9)), sum(round(cos(a), 9)))) * (31.0::DOUBLE / 360), 6) + 0.5) AS INT) % 31) + 31) % 31 + 1 AS INT) AS cycle_day FROM ang GROUP BY 1)"""
query("usual_billing_day", f"{_BILLS}{_USUAL} SELECT card, cycle_day FROM usual")(lambda s, d: src.bills(src.movements(s, d)).groupBy("card").agg(intervals.usual_day(F.date_sub("paid", 10)).alias("cycle_day")))
_CYCLES = f"""{_USUAL}, c1 AS (SELECT bills.*, cycle_day, {_end_sql("CAST(paid - INTERVAL 1 DAY AS DATE)", "cycle_day")} AS cycle_last FROM bills JOIN usual USING (card)),
c2 AS (SELECT *, CAST({_end_sql("CAST(cycle_last - INTERVAL 1 DAY AS DATE)", "cycle_day")} + INTERVAL 1 DAY AS DATE) AS cycle_first FROM c1)"""
query("billing_cycles", f"{_BILLS}{_CYCLES} SELECT bill, cycle_day, cycle_first, cycle_last FROM c2")(lambda s, d: intervals.cycles_of(src.bills(src.movements(s, d))).select("bill", "cycle_day", "cycle_first", "cycle_last"))
query("cycle_estimates_with_carry", f"""{_BILLS}{_CYCLES}, per AS (SELECT card, cycle_first, cycle_last, CAST(sum(cents) AS BIGINT) AS paid_cents FROM c2 GROUP BY 1, 2, 3),
ch AS (SELECT per.card, cycle_first, cycle_last, paid_cents, CAST(coalesce(sum(CASE WHEN direction = 'debit' AND category <> 'transfers.card_bill' THEN cents WHEN direction = 'credit' AND refund_of IS NOT NULL THEN -cents ELSE 0 END), 0) AS BIGINT) AS charges
  FROM per LEFT JOIN m ON m.card = per.card AND m.channel = 'card' AND m.day BETWEEN cycle_first AND cycle_last GROUP BY 1, 2, 3, 4),
r1 AS (SELECT *, CASE WHEN CAST(lag(cycle_last) OVER w + INTERVAL 1 DAY AS DATE) = cycle_first THEN 0 ELSE 1 END AS fresh FROM ch WINDOW w AS (PARTITION BY card ORDER BY cycle_first, cycle_last)),
r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY card ORDER BY cycle_first, cycle_last) AS run FROM r1),
r3 AS (SELECT *, sum(charges - paid_cents) OVER (PARTITION BY card, run ORDER BY cycle_first, cycle_last) AS s FROM r2),
r4 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY card, run ORDER BY cycle_first, cycle_last)) AS carry FROM r3),
r5 AS (SELECT *, charges + coalesce(lag(carry) OVER (PARTITION BY card, run ORDER BY cycle_first, cycle_last), 0) AS counted FROM r4)
SELECT card, cycle_first, cycle_last, paid_cents, charges, CAST(counted AS BIGINT) AS counted, CAST(greatest(paid_cents - counted, 0) AS BIGINT) AS estimate FROM r5""")(
    lambda s, d: (lambda m: intervals.estimates(intervals.cycles_of(src.bills(m)), m))(src.movements(s, d)))
query("total_spend_with_estimates", f"""WITH {src.MOVEMENTS_SQL}, {c.COUNTED_SQL}, e AS (SELECT card, 12345 * (CAST(card AS INT) + 1) - 40000 AS estimate FROM (SELECT DISTINCT card FROM m))
SELECT CASE WHEN owner_channel = 'card' THEN 'cards' ELSE 'upi' END AS part, CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE AS amount FROM counted WHERE bucket = 'spent' AND {_IN98} GROUP BY 1
UNION ALL SELECT 'estimates', CAST(sum(estimate) AS BIGINT) / 100.0::DOUBLE FROM e WHERE estimate > 50""")(
    lambda s, d: views.total_spend(rows_of(s, d), src.movements(s, d).select("card", ((F.col("card").cast("int") + 1) * 12345 - 40000).cast("bigint").alias("estimate")).distinct(), Y1998))


def _statements(moves: DataFrame) -> DataFrame:
    """One statement for each card and half year with rows, from its first to its last day of rows."""
    half = F.concat(F.year("day"), F.lit("-"), F.floor((F.month("day") - 1) / 6).cast("int"))
    return moves.groupBy("card", half.alias("_h")).agg(F.min("day").alias("first"), F.max("day").alias("last")).select(F.concat("card", F.lit("/"), "_h").alias("statement"), "card", "first", "last")


query("bill_coverage", f"""{_BILLS}{_CYCLES}, st AS (SELECT card || '/' || year(day) || '-' || ((month(day) - 1) // 6) AS statement, card, min(day) AS first, max(day) AS last FROM m GROUP BY 1, 2),
k AS (SELECT bill, statement, row_number() OVER (PARTITION BY bill ORDER BY first, statement) AS k FROM c2 JOIN st ON st.card = c2.card AND first <= cycle_first AND last >= cycle_last)
SELECT c2.bill, k.statement AS covered_by FROM c2 LEFT JOIN k ON k.bill = c2.bill AND k.k = 1""")(
    lambda s, d: (lambda m: intervals.covered_by(intervals.cycles_of(src.bills(m)), _statements(m)).select("bill", "covered_by"))(src.movements(s, d)))


# Events as payments and refunds.
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("ts"), "user_id", "event_type", money.cents("value").alias("cents"), "props")


query("nearest_event_asof", """SELECT e.event_id AS id, e.user_id, e.ts, CASE WHEN p.ts >= e.ts - INTERVAL 7 DAY THEN p.event_id END AS paid, CASE WHEN p.ts >= e.ts - INTERVAL 7 DAY THEN p.ts END AS matched_at
FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN LATERAL (SELECT event_id, ts FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts ORDER BY ts DESC, event_id DESC LIMIT 1) p ON true""")(
    lambda s, d: intervals.as_of(_events(s, d).filter("event_type = 'error'"), _events(s, d).filter("event_type = 'purchase'").withColumn("paid", F.col("id")), "user_id", "ts", "paid", "7 days"))
query("event_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS first, count(*) AS events FROM s GROUP BY user_id, s""")(
    lambda s, d: _sessions(s, d))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.imports import sessions

    found = sessions(src.table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "30 minutes")
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "events")


query("json_props_histogram", "SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS events FROM events GROUP BY 1, 2")(
    lambda s, d: src.table(s, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("events")))
query("occurrence_number", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS occurrence FROM lineitem""")(
    lambda s, d: intervals.occurrence(src.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("occurrence").cast("bigint").alias("occurrence")))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a running balance per user; a tenth of the users have one row whose balance is a cent off."""
    e = _events(spark, sf_dir)
    e = e.withColumn("balance", F.expr("sum(cents) over (partition by user_id order by ts, id rows unbounded preceding)") + F.when((F.col("user_id") % 10 == 0) & (F.col("id") % 7 == 0), 1).otherwise(0))
    return e


query("running_balance_check", """WITH e AS (SELECT event_id AS id, ts AS ts, user_id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events),
b AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) + CASE WHEN user_id % 10 = 0 AND id % 7 = 0 THEN 1 ELSE 0 END AS balance FROM e),
s AS (SELECT *, abs(balance - lag(balance) OVER (PARTITION BY user_id ORDER BY ts, id)) AS step FROM b)
SELECT user_id, count(*) AS rows, bool_and(coalesce(step = abs(cents), true)) AS holds FROM s GROUP BY 1""")(lambda s, d: intervals.balances_hold(_balances(s, d), "user_id", ["ts", "id"]))  # fmt: skip
query("gap_clusters", """WITH g AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 5 THEN 1 ELSE 0 END AS fresh FROM events)
SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY value) AS BIGINT) AS cluster FROM g""")(
    lambda s, d: intervals.clusters(src.table(s, d, "events"), "user_id", "value", 5.0).select("user_id", "event_id", "cluster"))
query("filled_down", """SELECT event_id, user_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events""")(
    lambda s, d: intervals.filled_down(src.table(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("event_type")), "user_id", "event_id", "event_type"))

# Matching: every third order read from a second file, two minutes later and under another number.
_REFS = "create_map"


def _two_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = src.movements(spark, sf_dir).filter("refund_of is null")
    old = m.select("id", "ts", "cents", "direction", "payee", "card", F.lit("a").alias("file"), F.create_map(F.lit("txnId"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("T"), F.col("id").cast("string")))).alias("refs"))
    new = m.filter("id % 3 = 0").select((F.col("id") + 5 * 10**9).alias("id"), (F.col("ts") + F.expr("interval 2 minutes")).alias("ts"), "cents", "direction", F.concat("payee", F.lit(" Ltd")).alias("payee"), "card", F.lit("b").alias("file"),
                                        F.create_map(F.lit("txnId"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("T"), F.col("id").cast("string")))).alias("refs"))
    return old, new


_FILES = f"""WITH {src.MOVEMENTS_SQL}, o AS (SELECT id, ts, cents, direction, regexp_replace(lower(payee), '[^a-z0-9]', '', 'g') AS payee, card, CASE WHEN id % 2 = 0 THEN 'T' || id END AS txn FROM m WHERE refund_of IS NULL),
n AS (SELECT id + 5000000000 AS id, ts + INTERVAL 2 MINUTE AS ts, cents, direction, payee || 'ltd' AS payee, card, txn FROM o WHERE id % 3 = 0)"""
query("dedup_exact_keys", f"""{_FILES}, h AS (SELECT n.id AS new_id, o.id AS old_id, 2 AS rank FROM n JOIN o ON n.txn = o.txn AND n.cents = o.cents AND n.direction = o.direction
UNION ALL SELECT n.id, o.id, 4 FROM n JOIN o ON date_trunc('minute', n.ts) = date_trunc('minute', o.ts) AND n.payee = o.payee AND n.cents = o.cents AND n.direction = o.direction)
SELECT new_id, old_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY rank, old_id DESC) AS k FROM h) WHERE k = 1""")(
    lambda s, d: matching.exact_matches(*_two_files(s, d)))
query("dedup_candidates_loose", f"""{_FILES}, h AS (SELECT n.id AS new_id, o.id AS old_id, abs(epoch(n.ts)::BIGINT - epoch(o.ts)::BIGINT) AS apart FROM n JOIN o ON n.cents = o.cents AND n.direction = o.direction AND abs(epoch(n.ts)::BIGINT - epoch(o.ts)::BIGINT) <= 600 AND (contains(n.payee, o.payee) OR contains(o.payee, n.payee)))
SELECT new_id, old_id, CAST(apart AS BIGINT) AS apart FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY apart, old_id) AS k FROM h) WHERE k = 1""")(
    lambda s, d: matching.loose_matches(*_two_files(s, d)))
query("dedup_overlapping_files", f"""{_FILES}, h AS (SELECT n.id AS new_id, o.id AS old_id, abs(date_diff('day', CAST(n.ts AS DATE), CAST(o.ts AS DATE))) AS apart FROM n JOIN o ON n.card = o.card AND n.cents = o.cents AND n.direction = o.direction AND abs(date_diff('day', CAST(n.ts AS DATE), CAST(o.ts AS DATE))) <= 3)
SELECT new_id, old_id FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY apart, old_id) AS k FROM h) WHERE k = 1""")(lambda s, d: matching.file_overlaps(*_two_files(s, d)))  # fmt: skip


def _payments_and_bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'")


query("mutually_unique_links", """WITH e AS (SELECT event_id AS id, CAST(ts AS DATE) AS day, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events),
p AS (SELECT a.id AS payment, b.id AS bill FROM e a JOIN e b ON a.event_type = 'purchase' AND b.event_type = 'error' AND abs(a.cents - b.cents) <= 100 AND date_diff('day', b.day, a.day) BETWEEN 0 AND 5),
u AS (SELECT *, count(*) OVER (PARTITION BY payment) AS x, count(*) OVER (PARTITION BY bill) AS y FROM p) SELECT payment, bill FROM u WHERE x = 1 AND y = 1""")(
    lambda s, d: matching.mutually_unique(*_payments_and_bills(s, d)))


def _refund_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Purchases as payments of a user at the user's shop, a third of round amounts; errors as refunds of a third of their value, every
    thirteenth a credit of instalments of a round amount."""
    e = _events(spark, sf_dir)
    emi, round_ = F.col("id") % 13 == 0, F.expr("(cents div 2000 + 1) * 2000")
    side = lambda d, c: d.select("id", "ts", c.alias("cents"), F.col("user_id").cast("string").alias("shop"), (F.col("user_id") % 50).cast("string").alias("card"), F.when(F.col("id") % 9 == 0, F.col("user_id").cast("string")).alias("ref"), emi.alias("emi"))
    return side(e.filter("event_type = 'purchase'"), F.when(F.col("id") % 3 == 0, round_).otherwise(F.col("cents"))), side(e.filter("event_type = 'error'"), F.when(emi, round_).otherwise(F.expr("(cents + 2) div 3")))


#: One refund after the other, as recursive SQL: a step takes the next refund of every card, as no assignment crosses cards here.
REFUNDS_SQL = """WITH RECURSIVE e AS (SELECT event_id AS id, ts, user_id AS shop, user_id % 50 AS card, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN event_id % 9 = 0 THEN user_id END AS ref, event_id % 13 = 0 AS emi FROM events),
pay AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN (cents // 2000 + 1) * 2000 ELSE cents END AS cents) FROM e WHERE event_type = 'purchase'),
r AS (SELECT * REPLACE (CASE WHEN emi THEN (cents // 2000 + 1) * 2000 ELSE (cents + 2) // 3 END AS cents), row_number() OVER (PARTITION BY card ORDER BY ts, id) AS n FROM e WHERE event_type = 'error'),
c AS (SELECT r.id AS refund, r.cents, pay.id AS payment, pay.cents AS budget, pay.ts AS paid, CASE WHEN r.emi THEN 4 WHEN r.ref = pay.ref THEN 1 WHEN r.shop = pay.shop THEN 2 ELSE 3 END AS tier FROM r JOIN pay ON pay.card = r.card AND pay.cents >= r.cents
  AND (CASE WHEN r.emi THEN NOT pay.emi AND pay.cents = r.cents ELSE coalesce(r.ref = pay.ref, false) OR r.shop = pay.shop OR r.cents = pay.cents END) AND ((NOT r.emi AND coalesce(r.ref = pay.ref, false)) OR (pay.ts <= r.ts AND pay.ts >= r.ts - INTERVAL 180 DAY))),
g AS (SELECT DISTINCT card, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS rs, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS cs, CAST([] AS INT[]) AS ts FROM r UNION ALL
  SELECT x.card, x.n, CASE WHEN b IS NULL THEN rs ELSE list_append(rs, b.refund) END, CASE WHEN b IS NULL THEN ps ELSE list_append(ps, b.payment) END, CASE WHEN b IS NULL THEN cs ELSE list_append(cs, b.cents) END, CASE WHEN b IS NULL THEN ts ELSE list_append(ts, b.tier) END
  FROM (SELECT r.card, r.n, any_value(g.rs) AS rs, any_value(g.ps) AS ps, any_value(g.cs) AS cs, any_value(g.ts) AS ts,
    arg_min({'refund': c.refund, 'payment': c.payment, 'cents': c.cents, 'tier': c.tier}, {'a': c.tier, 'b': c.cents <> c.budget, 'c': -epoch_us(c.paid), 'd': c.payment}) FILTER (c.budget - coalesce(list_sum(list_transform(list_filter(list_zip(g.ps, g.cs), lambda x: x[1] = c.payment), lambda x: x[2])), 0) >= c.cents) AS b
    FROM g JOIN r ON r.card = g.card AND r.n = g.n + 1 LEFT JOIN c ON c.refund = r.id GROUP BY r.card, r.n) x),
z AS (SELECT card, max_by(rs, n) AS rs, max_by(ps, n) AS ps, max_by(ts, n) AS ts FROM g GROUP BY card), a AS (SELECT card, unnest(rs) AS refund, unnest(ps) AS payment, unnest(ts) AS tier FROM z)"""
query("refund_assignment_greedy", f"{REFUNDS_SQL} SELECT refund, payment, tier FROM a")(lambda s, d: matching.assign_refunds(*_refund_sides(s, d)))
query("bill_link_greedy")(lambda s, d: matching.link_bills(*_payments_and_bills(s, d)))
query("row_multiset_equality", """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 10 <> 0),
x AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT x.n AS only_left, y.n AS only_right, x.n = 0 AND y.n = 0 AS equal FROM x, y""")(
    lambda s, d: (lambda li: matching.same_rows(li.select("l_orderkey", "l_linenumber"), li.filter("l_partkey % 10 <> 0").select("l_orderkey", "l_linenumber")))(src.table(s, d, "lineitem")))
query("upsert_latest_wins", """SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2""")(
    lambda s, d: (lambda li: matching.upserted(li.filter("l_partkey % 2 = 0"), li.filter("l_partkey % 2 = 1"), "key", "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate"))(
        src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))))

# Texts and rules.
query("normalised_text_key", """SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS key, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS words FROM part""")(
    lambda s, d: (lambda t: src.table(s, d, "part").select("p_partkey", text.compact(t).alias("key"), text.words_only(t).alias("words")))(F.concat_ws(" ", "p_name", "p_brand")))
_PART_RULES = [("PROMO.*BRASS", "promo brass"), ("^PROMO", "promo"), ("COPPER|TIN", "soft metal"), ("STEEL", "steel"), ("^ECONOMY", "economy")]
query("first_match_rule_category", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{v}'" for p, v in _PART_RULES) + " ELSE 'other' END AS category FROM part")(
    lambda s, d: src.table(s, d, "part").select("p_partkey", rules.first_match(F.col("p_type"), _PART_RULES, "other").alias("category")))
query("masked_accounts", "SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS last4, 'XX' || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS masked FROM customer")(
    lambda s, d: src.table(s, d, "customer").select("c_custkey", text.last_digits("c_name").alias("last4"), text.masked("c_name").alias("masked")))
query("content_hash_dedup", "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")(
    lambda s, d: src.table(s, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))

# Bills, stays and selections.
query("bills_by_card_month", f"{_BILLS} SELECT card, strftime(paid, '%Y-%m') AS month, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS amount, count(*) AS bills FROM bills WHERE paid BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")(
    lambda s, d: bills.paid_by_month(src.bills(src.movements(s, d)), Y1998))
query("ask_bills", f"{_BILLS} SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) / 100.0::DOUBLE AS amount, count(*) AS bills, max(paid) AS last FROM bills WHERE paid BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")(
    lambda s, d: bills.bills_answer(src.bills(src.movements(s, d)), Y1998))


def _cycle_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.cycles_of(src.bills(src.movements(spark, sf_dir))).select("card", "cycle_first", "cycle_last", F.col("cents").alias("estimate"))


query("estimates_by_month", f"""{_BILLS}{_CYCLES}, x AS (SELECT card, cycle_first, cycle_last, cents AS estimate, CAST(t AS DATE) AS ms FROM c2, generate_series(date_trunc('month', cycle_first), CAST(cycle_last AS TIMESTAMP), INTERVAL 1 MONTH) AS g(t) WHERE cents > 0),
y AS (SELECT card, strftime(ms, '%Y-%m') AS month, CAST(round(CAST(estimate * (date_diff('day', greatest(ms, cycle_first), least(last_day(ms), cycle_last)) + 1) * 1000 AS DOUBLE) / (date_diff('day', cycle_first, cycle_last) + 1)) AS BIGINT) AS v FROM x)
SELECT card, month, CAST(floor(CAST(sum(v) AS DOUBLE) / 1000 + 0.5) AS BIGINT) AS cents FROM y WHERE month BETWEEN '1998-01' AND '1998-12' GROUP BY 1, 2 HAVING CAST(floor(CAST(sum(v) AS DOUBLE) / 1000 + 0.5) AS BIGINT) > 50""")(
    lambda s, d: bills.estimates_by_month(_cycle_amounts(s, d), Y1998))
query("statement_coverage_share", f"""WITH {src.MOVEMENTS_SQL}, st AS (SELECT card, min(day) AS first, max(day) AS last FROM m GROUP BY card, year(day), (month(day) - 1) // 6),
d AS (SELECT DISTINCT card, CAST(t AS DATE) AS day FROM st, generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY) AS g(t))
SELECT card, strftime(day, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) / max(day(last_day(day))) AS share FROM d GROUP BY 1, 2""")(lambda s, d: bills.covered_share(_statements(src.movements(s, d))))  # fmt: skip
_96 = Period(dt.date(1996, 2, 10), dt.date(1996, 8, 20))
query("ask_where", f"""{COUNTED}, {src.STAYS_SQL}{_OWNED}, s AS (SELECT eff_day AS day, sum(signed) AS s, sum(n) AS n FROM counted WHERE bucket = 'spent' GROUP BY 1)
SELECT stay, place, min(day) AS first, max(day) AS last, count(*) AS days, CAST(coalesce(sum(s), 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments
FROM owned LEFT JOIN s USING (day) WHERE day BETWEEN DATE '1996-02-10' AND DATE '1996-08-20' GROUP BY 1, 2""")(lambda s, d: bills.where_answer(src.stays(s, d), rows_of(s, d), _96))  # fmt: skip
query("stay_preview", f"""{COUNTED}, {src.STAYS_SQL}{_OWNED}, a AS (SELECT CAST(coalesce(sum(signed), 0) AS BIGINT) / 100.0::DOUBLE AS amount, CAST(coalesce(sum(n), 0) AS BIGINT) AS payments FROM counted WHERE bucket = 'spent' AND eff_day BETWEEN DATE '1996-02-10' AND DATE '1996-08-20'),
b AS (SELECT count(*) AS days_taken, count(DISTINCT stay) AS stays FROM owned WHERE day BETWEEN DATE '1996-02-10' AND DATE '1996-08-20') SELECT * FROM a, b""")(lambda s, d: bills.stay_preview(src.stays(s, d), rows_of(s, d), _96))  # fmt: skip
_view("ticked_total", "SELECT CAST(coalesce(sum(CASE WHEN direction = 'credit' THEN -cents ELSE cents END), 0) AS BIGINT) / 100.0::DOUBLE AS amount, count(*) AS rows FROM counted WHERE bucket <> 'card_bill' AND id % 97 = 3",
      lambda s, r: bills.ticked_total(r, r.filter("id % 97 = 3").select("id")))
_view("row_tags", """SELECT CASE WHEN refund_of IS NOT NULL THEN 'refund' WHEN bucket = 'card_bill' THEN 'card bill' WHEN bucket = 'ignored' THEN 'not counted' WHEN bucket = 'people' THEN 'person' WHEN bucket IN ('in', 'cashback') THEN 'money in' ELSE 'payment' END AS tag,
CASE WHEN owner_channel = 'card' THEN 'Card ' || owner_card ELSE upper(owner_channel) END AS paid, count(*) AS rows FROM counted GROUP BY 1, 2""", lambda s, r: r.groupBy(bills.tag().alias("tag"), bills.how_paid().alias("paid")).agg(F.count(F.lit(1)).alias("rows")))  # fmt: skip
_view("list_search", "SELECT id, payee, cents FROM counted WHERE contains(lower(payee || ' ' || shop || ' ' || category), 'urgent.mach')", lambda s, r: bills.search(r, "Urgent.Mach").select("id", "payee", "cents"))
_view("one_row_per_bill", """, k AS (SELECT id, card, row_number() OVER (PARTITION BY card, day ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY card, day) AS sides FROM counted WHERE bucket = 'card_bill') SELECT id, card, sides FROM k WHERE k = 1""",
      lambda s, r: bills.one_row_per_bill(r.filter("bucket = 'card_bill'").withColumn("_side", F.concat_ws("/", "card", "day")), "_side").select("id", "card", "sides"))
query("grouped_digits", """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS v FROM orders), t AS (SELECT *, CAST(v AS VARCHAR) AS n FROM n)
SELECT o_orderkey, CASE WHEN length(n) <= 3 THEN n WHEN length(n) <= 5 THEN left(n, length(n) - 3) || ',' || right(n, 3) WHEN length(n) <= 7 THEN left(n, length(n) - 5) || ',' || substr(n, length(n) - 4, 2) || ',' || right(n, 3)
ELSE left(n, length(n) - 7) || ',' || substr(n, length(n) - 6, 2) || ',' || substr(n, length(n) - 4, 2) || ',' || right(n, 3) END AS amount FROM t""")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", bills.grouped_digits(F.floor(F.col("o_totalprice") * 37)).alias("amount")))


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("part a", "wrong", 9), ("Supplier#000000001", "first", 1), ("supplier", "any", 5)], "alias string, person string, place int")


query("payee_aliases", "SELECT s_suppkey, 'first' AS person FROM supplier")(
    lambda s, d: bills.matched_payees(src.table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("payee")), _aliases(s)).select("s_suppkey", "person"))


from . import queries_answers, queries_cards, queries_lines, queries_matching, queries_sources, queries_text, queries_upkeep  # noqa: E402, F401  (they register with query() above)
