"""Queries of rule cascades, merges and greedy links over the driver's tables; the links against recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cascade, ladder, matching, rules
from .queries import ORACLE_SQL, REFUNDS_SQL, _refund_sides, query
from .queries_text import _NORMAL, _case, _one_of
from .sources import movements as src

# Rules: customers as movements with names of many kinds.
_PAYEES = _one_of("c_custkey", "Shell Fuel {n}", "Ann Lee", "ACME pvt ltd", "Joes Cafe Ltd", "Zed 9", "???", "Bob Uma Ray", "Fresh mart", "Hotel Sea", "school fees")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return src.table(spark, sf_dir, "customer").select(
        k.alias("id"), F.expr(_PAYEES).alias("payee"), F.when(k % 6 == 0, F.concat(F.lit("xx "), F.lpad((k % 100).cast("string"), 4, "0"))).alias("payee_handle"), F.when(k % 4 == 0, "credit").otherwise("debit").alias("direction"),
        F.when(k % 9 == 0, "cashback").when(k % 9 == 1, "refund").otherwise("spend").alias("kind"), F.when(k % 8 == 0, "atm").alias("note"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir)
    return rules.decide(m, m.filter("id % 25 = 0").select("id", F.lit("gifts").alias("category")), spark.createDataFrame([("JOES cafe", "food.coffee")], "name string, category string"), spark.range(20).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("digits")),
                        spark.createDataFrame([("Acme", "work", "user"), ("acme ltd", "wrong", "model")], "name string, category string, by string"))


_RULED = f"""WITH s AS (SELECT c_custkey AS id, {_PAYEES} AS t, CASE WHEN c_custkey % 8 = 0 THEN 'atm' END AS note FROM customer), k AS (SELECT *, {_NORMAL} AS key, lower(concat_ws(' ', t, note)) AS txt FROM s),
d AS (SELECT *, CASE WHEN id % 25 = 0 THEN 'answer' WHEN id % 9 = 0 THEN 'kind' WHEN id % 9 = 1 THEN 'kind' WHEN key = 'joes cafe' THEN 'payee' WHEN id % 6 = 0 AND id % 100 < 20 THEN 'own account' WHEN key = 'acme' THEN 'memory' WHEN id % 4 = 0 THEN 'credit'
WHEN {_case([(v, p) for p, v in rules.KEYWORDS], 'txt')} IS NOT NULL THEN 'keyword' WHEN regexp_matches(key, '^[a-z]+ [a-z]+( [a-z]+)?$') AND NOT regexp_matches(txt, '[0-9]') THEN 'person' ELSE 'none' END AS decided_by FROM k)"""
query("categories_decided", f"""{_RULED} SELECT id, decided_by, CASE decided_by WHEN 'answer' THEN 'gifts' WHEN 'kind' THEN CASE WHEN id % 9 = 0 THEN 'income.cashback' ELSE 'income.refund' END WHEN 'payee' THEN 'food.coffee' WHEN 'own account' THEN 'transfers.self' WHEN 'memory' THEN 'work' WHEN 'credit' THEN 'income.received'
WHEN 'keyword' THEN {_case([(v, p) for p, v in rules.KEYWORDS], 'txt')} WHEN 'person' THEN 'transfers.p2p' ELSE 'uncategorised' END AS category, decided_by IN ('person', 'none') AS needs_review FROM d""")(lambda s, d: _decided(s, d).select("id", "decided_by", "category", "needs_review"))  # fmt: skip
query("rules_counted", f"{_RULED} SELECT decided_by, count(*) AS rows, count(*) FILTER (decided_by IN ('person', 'none')) AS to_review FROM d GROUP BY 1")(lambda s, d: rules.rule_counts(_decided(s, d)))
query("answers_remembered", f"""WITH s AS (SELECT c_custkey AS id, {_PAYEES} AS t FROM customer), k AS (SELECT {_NORMAL} AS name, 'c' || id AS category, id % 3 = 0 AS usr, id % 17 AS ts FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY usr DESC, ts DESC, category DESC) AS k FROM k WHERE name <> '') SELECT name, category, CASE WHEN usr THEN 'user' ELSE 'model' END AS by_whom, ts FROM n WHERE k = 1""")(
    lambda s, d: rules.remember(_moves(s, d).select(F.col("payee").alias("name"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("category"), F.when(F.col("id") % 3 == 0, "user").otherwise("model").alias("by"), (F.col("id") % 17).alias("ts"))).withColumnRenamed("by", "by_whom"))


# The ladder: orders as movements that meet one tier each, or several, by remainders of their number; payees by the customer's number.
_LADDER_PAYEES = _one_of("o_custkey", "Zoe Ltd {n}", "Swift Mart {n}", "Fund my account", "CRED club", "Unknown", "Petrol pump {n}", "Mr. Quux", "Lola", "UPI Lite", "Quux Nine", "Zia")


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = src.table(spark, sf_dir, "orders")
    listed = F.when(k % 5 == 0, F.create_map(F.lit("cardRow"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = o.select(
        k.alias("id"), F.expr(_LADDER_PAYEES).alias("payee"), F.when(k % 14 == 3, "ac 44001234").alias("payee_handle"), F.when(k % 4 == 0, "credit").otherwise("debit").alias("direction"),
        F.expr("CASE WHEN o_orderkey % 29 = 1 THEN 'cashback' WHEN o_orderkey % 31 = 1 THEN 'refund' WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 THEN 'bill_payment' WHEN o_orderkey % 4 = 0 THEN 'income' WHEN o_orderkey % 9 = 0 THEN 'transfer' ELSE 'spend' END").alias("kind"),
        F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'igst' WHEN o_orderkey % 6 = 1 THEN 'convenience charges' END").alias("note"), F.when(k % 5 == 0, "card").otherwise("upi").alias("channel"), F.lit(None).cast("string").alias("card"), F.lit(None).cast("string").alias("paid_from"),
        F.expr("CASE WHEN o_orderkey % 10 = 7 THEN 'Airline' WHEN o_orderkey % 10 = 9 THEN 'Retail' END").alias("merchant_category"), listed.alias("refs"),
    )
    answers = rows.filter("id % 37 = 5").select("id", F.lit("gifts").alias("category"))
    frame = spark.createDataFrame
    return ladder.placed(rows, answers, frame([("zoe", "family", 1)], "alias string, category string, place int"), frame([("zia", "friends", "user"), ("lola", "transfers.p2p", "llm")], "name string, category string, by string"),
                         frame([("1234",)], "digits string"), frame([("swift mart", "food.groceries", 1), ("swif*", "late", 2)], "phrase string, category string, place int"))


_LADDER_SQL = f"""WITH o AS (SELECT o_orderkey AS id, o_custkey % 11 AS p, {_LADDER_PAYEES} AS payee, o_orderkey % 5 = 0 AS listed, o_orderkey % 4 = 0 AS cr, CASE WHEN o_orderkey % 29 = 1 THEN 'cashback' WHEN o_orderkey % 31 = 1 THEN 'refund' WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 THEN 'bill_payment' WHEN o_orderkey % 4 = 0 THEN 'income' WHEN o_orderkey % 9 = 0 THEN 'transfer' ELSE 'spend' END AS kind FROM orders),
t AS (SELECT *, CASE WHEN id % 37 = 5 THEN 1 WHEN kind = 'cashback' THEN 2 WHEN kind = 'refund' THEN 3 WHEN listed AND kind = 'bill_payment' THEN 4 WHEN p = 0 THEN 5 WHEN cr AND kind = 'income' AND p = 1 THEN 6 WHEN p = 10 THEN 7 WHEN listed AND (kind = 'transfer' OR (NOT cr AND id % 6 = 0)) THEN 8 WHEN id % 14 = 3 THEN 9 WHEN p = 2 THEN 10
WHEN kind = 'transfer' AND p = 8 THEN 11 WHEN kind = 'income' THEN 12 WHEN p = 3 THEN 13 WHEN p = 1 THEN 14 WHEN p = 7 AND NOT listed THEN 15 WHEN id % 10 IN (7, 9) THEN 16 WHEN p = 5 THEN 17 WHEN listed AND NOT cr AND id % 6 = 1 THEN 18 WHEN p = 6 AND NOT listed THEN 19 WHEN p = 4 THEN 20 END AS tier FROM o)"""
query("ladder_of_categories", f"""{_LADDER_SQL} SELECT id, CAST(tier AS INT) AS tier, CASE tier WHEN 1 THEN 'gifts' WHEN 2 THEN 'income.cashback' WHEN 3 THEN 'income.refund' WHEN 4 THEN 'transfers.card_bill' WHEN 5 THEN 'family' WHEN 6 THEN 'income.refund' WHEN 7 THEN 'friends' WHEN 8 THEN CASE WHEN kind = 'transfer' THEN 'ignored' ELSE 'fees.tax' END
WHEN 9 THEN 'ignored' WHEN 10 THEN 'ignored' WHEN 11 THEN 'ignored' WHEN 12 THEN 'income.received' WHEN 13 THEN 'transfers.card_bill' WHEN 14 THEN 'food.groceries' WHEN 15 THEN 'transfers.p2p' WHEN 16 THEN CASE WHEN id % 10 = 7 THEN 'travel.tickets' ELSE 'shopping' END WHEN 17 THEN 'travel.fuel' WHEN 18 THEN 'fees' WHEN 19 THEN 'transfers.p2p'
WHEN 20 THEN 'uncategorized' ELSE CASE WHEN NOT listed AND p IN (8, 9) THEN 'transfers.p2p' ELSE 'uncategorized' END END AS category, CASE WHEN tier IN (9, 10, 11) THEN 'transfer' WHEN tier = 6 THEN 'refund' WHEN tier = 13 THEN 'bill_payment' ELSE kind END AS kind, coalesce(tier IN (10, 15, 19, 20) OR (tier = 16 AND id % 10 = 9), true) AS needs_review FROM t""")(
    lambda s, d: _ladder(s, d).select("id", "tier", "category", "kind", "needs_review"))
query("ladder_counts", f"{_LADDER_SQL} SELECT CAST(tier AS INT) AS tier, count(*) AS rows, count(*) FILTER (coalesce(tier IN (10, 15, 19, 20) OR (tier = 16 AND id % 10 = 9), true)) AS to_review FROM t GROUP BY 1")(lambda s, d: ladder.tier_counts(_ladder(s, d)))


# Merges: lines of an order as records of one movement.
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = src.table(spark, sf_dir, "lineitem")
    number = F.col("l_orderkey").cast("string")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") % 50).alias("cents"), F.lit("debit").alias("direction"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))).alias("payee"),
        F.when(F.col("l_linenumber") == 3, F.lit("c3")).alias("card"), F.lit("x").alias("category"), F.create_map(F.lit("utr"), F.when(F.col("l_orderkey") % 3 > 0, number)).alias("refs"), F.array(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")), F.lit("a")).alias("sources"),
    ).dropDuplicates(["id"])


query("records_merged", """WITH r AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS l FROM lineitem), g AS (SELECT CASE WHEN o % 3 > 0 THEN 'u' || o ELSE 'i' || (o * 10 + l) END AS key, o % 50 AS cents, o * 10 + l AS id, l FROM r)
SELECT min(id) AS id, cents, arg_min('p' || l, id) FILTER (l > 1) AS payee, arg_min('c3', id) FILTER (l = 3) AS card, array_to_string(list_sort(list_distinct(list_concat(list('f' || l), ['a']))), ',') AS sources, count(*) AS records FROM g GROUP BY key, cents""")(
    lambda s, d: matching.merged(_records(s, d)).select("id", "cents", "payee", "card", F.concat_ws(",", "sources").alias("sources"), "records"))
query("rows_retracted", "WITH r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem) SELECT id FROM r WHERE id % 10 <> 2")(
    lambda s, d: matching.retracted(_records(s, d).withColumn("sources", F.slice("sources", 1, 1)), "f2").select("id"))
query("repeated_ids_told_apart", """WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey || '/' || l_linenumber || '/' || l_extendedprice) AS n FROM lineitem)
SELECT CASE WHEN n = 1 THEN CAST(l_orderkey AS VARCHAR) ELSE sha1(l_orderkey || '|' || n) END AS id, l_partkey, l_suppkey FROM r""")(
    lambda s, d: matching.unique_ids(src.table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("cents"), F.concat_ws("/", "l_suppkey", "l_linenumber", "l_extendedprice").alias("payee"), "l_partkey", "l_suppkey")).select("id", "l_partkey", "l_suppkey"))

# Greedy links: the recursive SQL makes one choice after the other.
_EVENTS = "e AS (SELECT event_id AS id, ts, user_id, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"
ORACLE_SQL["bill_link_greedy"] = f"""WITH RECURSIVE {_EVENTS}, p AS (SELECT a.id AS payment, b.id AS bill, CASE WHEN a.cents <> b.cents THEN 1 ELSE 0 END AS inexact, abs(CAST(floor(epoch(a.ts)) AS BIGINT) - CAST(floor(epoch(b.ts)) AS BIGINT)) AS apart FROM e a JOIN e b ON a.event_type = 'purchase' AND b.event_type = 'error' AND a.ts BETWEEN b.ts - INTERVAL 902 SECOND AND b.ts + INTERVAL 902 SECOND AND abs(a.cents - b.cents) * 100 <= b.cents * 5),
o AS (SELECT *, row_number() OVER (ORDER BY inexact, apart, payment, bill) AS n FROM p WHERE apart <= 900),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS bs UNION ALL SELECT o.n, CASE WHEN list_contains(ps, payment) OR list_contains(bs, bill) THEN ps ELSE list_append(ps, payment) END, CASE WHEN list_contains(ps, payment) OR list_contains(bs, bill) THEN bs ELSE list_append(bs, bill) END FROM g JOIN o ON o.n = g.n + 1),
z AS (SELECT ps, bs FROM g ORDER BY n DESC LIMIT 1) SELECT unnest(ps) AS payment, unnest(bs) AS bill FROM z"""


def _by_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments, refunds = _refund_sides(spark, sf_dir)
    found = matching.assign_refunds(payments, refunds).join(refunds.select(F.col("id").alias("refund"), "card", "cents"), "refund")
    return found.groupBy("card", "tier").agg(F.count(F.lit(1)).alias("refunds"), F.sum("cents").alias("cents"))


query("refund_assignment_by_card", f"{REFUNDS_SQL} SELECT CAST(a.card AS VARCHAR) AS card, tier, count(*) AS refunds, CAST(sum(r.cents) AS BIGINT) AS cents FROM a JOIN r ON r.id = refund GROUP BY 1, 2")(_by_card)


# Refunds filed: purchases have the category of their user, refunds one of their own, told by a user, by rule or with a payment before.
def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments, refunds = _refund_sides(spark, sf_dir)
    k = F.col("id")
    told = refunds.withColumns({"category": F.lit("was"), "decided_by": F.when(k % 7 == 0, "user").when(k % 7 == 1, "refund").otherwise("rule"), "confidence": F.lit(0.5), "needs_review": k % 2 == 0})
    return matching.refunds_placed(payments.withColumn("category", F.concat(F.lit("c"), "card")), told, matching.assign_refunds(payments, refunds))


query("refunds_filed", f"""{REFUNDS_SQL} SELECT r.id, payment AS refund_of, CASE WHEN r.id % 7 = 0 THEN 'was' WHEN payment IS NOT NULL THEN 'c' || r.card WHEN emi THEN 'ignored' WHEN r.id % 7 = 1 THEN 'income.refund' ELSE 'was' END AS category, CASE WHEN r.id % 7 = 0 THEN 'user' WHEN payment IS NOT NULL THEN 'refund' WHEN emi THEN 'rule' WHEN r.id % 7 = 1 THEN 'heuristic' ELSE 'rule' END AS decided_by,
CASE WHEN r.id % 7 = 0 THEN 0.5 WHEN payment IS NOT NULL THEN 1.0 WHEN emi OR r.id % 7 = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN r.id % 7 > 0 AND (payment IS NOT NULL OR emi OR r.id % 7 = 1) THEN false ELSE r.id % 2 = 0 END AS needs_review FROM r LEFT JOIN a ON a.refund = r.id""")(_filed)  # fmt: skip


# Forgetting: purchases and errors of every 40th number go; what is left is linked as if they had never been there.
def _after_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments, refunds = _refund_sides(spark, sf_dir)
    gone = payments.select("id").unionByName(refunds.select("id")).filter("id % 40 = 7")
    return matching.reassigned(payments, refunds, matching.assign_refunds(payments, refunds), gone)


query("refunds_after_forgetting", REFUNDS_SQL.replace("FROM events)", "FROM events WHERE event_id % 40 <> 7)") + " SELECT refund, payment, tier FROM a")(_after_forgetting)


# A batch whose rows find one another: each movement twice in one import, the second of each two minutes later.
def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.movements(spark, sf_dir).filter("refund_of is null")
    part = lambda i: m.select((F.col("id") * 2 + i).alias("id"), (F.col("ts") + F.expr(f"interval {2 * i} minutes")).alias("ts"), "cents", "direction", "payee", "channel", "card", F.lit(None).cast("string").alias("paid_from"), F.lit("b").alias("file"), F.create_map(F.lit("utr"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))).alias("refs"), (F.col("id") * 2 + i).alias("arrived"))
    new = part(0).unionByName(part(1))
    old = part(0).filter("id % 6 = 0").withColumn("id", F.col("id") + 10**12).drop("arrived")
    return cascade.linked(old, new)


query("import_of_a_batch", f"""WITH {src.MOVEMENTS_SQL}, b AS (SELECT id, id * 2 % 6 = 0 AS was FROM m WHERE refund_of IS NULL)
SELECT id * 2 + 1000000000000 AS id, id * 2 + 1000000000000 AS root, CAST(NULL AS INT) AS tier FROM b WHERE was UNION ALL SELECT id * 2, CASE WHEN was THEN id * 2 + 1000000000000 ELSE id * 2 END, CASE WHEN was THEN 1 END FROM b
UNION ALL SELECT id * 2 + 1, CASE WHEN was THEN id * 2 + 1000000000000 ELSE id * 2 END, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END FROM b""")(_batch)
