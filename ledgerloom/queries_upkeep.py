"""Queries of edits of a ledger, and of what is said beside figures, over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import Period
from .operators import upkeep
from .plans import bills, notes
from .queries import _IN98, COUNTED, Y1998, query, rows_of
from .queries_cards import _MONTHS, _PLACED, _placed
from .sources import movements as src

_M = f"WITH {src.MOVEMENTS_SQL}"
_BY = ["rule", "user", "self", "payee", "model"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements with a decision each, by their number."""
    k = F.col("id")
    by = F.element_at(F.array(*[F.lit(b) for b in _BY]), (k % 5 + 1).cast("int"))
    return src.movements(spark, sf_dir).select("id", "payee", "shop", "category", by.alias("decided_by"), ((k % 11) / F.lit(10.0)).alias("confidence"), (k % 3 == 0).alias("needs_review"), F.lit("spend").alias("kind"))


def _verdicts(rows: DataFrame) -> DataFrame:
    k = F.col("id")
    by = F.element_at(F.array(*[F.lit(b) for b in _BY]), (k % 7 % 5 + 1).cast("int"))
    return rows.filter("id % 4 <> 3").select("id", F.when(k % 2 == 0, F.col("category")).otherwise("other").alias("category"), by.alias("decided_by"), ((k % 13) / F.lit(10.0)).alias("confidence"), (k % 5 == 1).alias("needs_review"), F.when(k % 6 == 0, "refund").alias("kind"))


_ARR = "['rule', 'user', 'self', 'payee', 'model']"
_STATE = f"""{_M}, r AS (SELECT id, payee, shop, category, {_ARR}[id % 5 + 1] AS decided_by, (id % 11) / 10.0::DOUBLE AS confidence, id % 3 = 0 AS needs_review, 'spend' AS kind FROM m),
v AS (SELECT id, CASE WHEN id % 2 = 0 THEN category ELSE 'other' END AS vc, {_ARR}[id % 7 % 5 + 1] AS vb, (id % 13) / 10.0::DOUBLE AS vf, id % 5 = 1 AS vr, CASE WHEN id % 6 = 0 THEN 'refund' END AS vk FROM r WHERE id % 4 <> 3)"""
query("verdicts_applied", f"""{_STATE} SELECT id, CASE WHEN vc IS NOT NULL THEN vc ELSE category END AS category, CASE WHEN vc IS NOT NULL THEN vb ELSE decided_by END AS decided_by, CASE WHEN vc IS NOT NULL THEN vf ELSE confidence END AS confidence, needs_review OR coalesce(vr, false) AS needs_review, coalesce(vk, kind) AS kind FROM r LEFT JOIN v USING (id)""")(
    lambda s, d: (lambda r: upkeep.applied(r, _verdicts(r)).select("id", "category", "decided_by", "confidence", "needs_review", "kind"))(_rows(s, d)))
query("recategorised", f"""{_STATE}, x AS (SELECT *, decided_by <> 'user' AND vc IS NULL AND decided_by = 'self' AS lost, decided_by <> 'user' AND vc IS NOT NULL AND (decided_by IN ('payee', 'user', 'self', 'refund') OR vb IN ('payee', 'user', 'self') OR vf >= confidence) AS takes FROM r LEFT JOIN v USING (id)),
y AS (SELECT id, category AS wc, needs_review AS wr, CASE WHEN lost THEN 'uncategorised' WHEN takes THEN vc ELSE category END AS category, CASE WHEN lost THEN 'none' WHEN takes THEN vb ELSE decided_by END AS decided_by, CASE WHEN lost THEN 0.0::DOUBLE WHEN takes THEN vf ELSE confidence END AS confidence,
CASE WHEN lost THEN true WHEN takes THEN (needs_review OR vr) AND NOT (vb IN ('payee', 'user') OR (NOT needs_review AND vc = category) OR (vc <> category AND vf >= 0.9 AND NOT vr)) ELSE needs_review END AS needs_review FROM x)
SELECT id, category, decided_by, confidence, needs_review, NOT (category = wc AND needs_review = wr) AS changed FROM y""")(lambda s, d: (lambda r: upkeep.recategorised(r, _verdicts(r)))(_rows(s, d)))  # fmt: skip


def _answers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    shops = rows.filter("shop in ('BUILDING', 'MACHINERY')").select("shop", F.concat(F.lit("by "), F.lower("shop"), F.lit("/"), (F.col("id") % 3).cast("string")).alias("category"), F.col("id").alias("at"))
    return rows.filter("id % 10 = 0").select("id", F.lit("by row").alias("category")), shops


_ANSWERED = f"{_STATE}, a AS (SELECT shop, arg_max('by ' || lower(shop) || '/' || (id % 3), id) AS c FROM r WHERE shop IN ('BUILDING', 'MACHINERY') GROUP BY 1), n AS (SELECT r.*, CASE WHEN id % 10 = 0 THEN 'by row' ELSE a.c END AS new FROM r LEFT JOIN a USING (shop))"
query("answers_of_rows_and_shops", f"{_ANSWERED} SELECT id, coalesce(new, category) AS category, CASE WHEN new <> category THEN category END AS undo FROM n")(lambda s, d: (lambda r: upkeep.answered(r, *_answers(r)).select("id", "category", "undo"))(_rows(s, d)))
query("answers_undone", f"{_ANSWERED} SELECT id, category FROM n")(lambda s, d: (lambda r: upkeep.undone(upkeep.answered(r, *_answers(r))).select("id", "category"))(_rows(s, d)))
query("spellings_to_change", f"{_ANSWERED} SELECT shop, payee, count(*) AS rows, count(*) FILTER (category <> c) AS to_change FROM r JOIN a USING (shop) GROUP BY 1, 2")(lambda s, d: (lambda r: upkeep.spellings(r, _answers(r)[1]))(_rows(s, d)))
query("slow_answers_kept", f"{_STATE} SELECT id, CASE WHEN decided_by = 'user' THEN category ELSE vc END AS category, CASE WHEN decided_by = 'user' THEN decided_by ELSE vb END AS decided_by FROM v JOIN r USING (id) WHERE id % 8 <> 0")(
    lambda s, d: (lambda r: upkeep.kept_answers(r.filter("id % 8 <> 0"), _verdicts(r).select("id", "category", "decided_by")))(_rows(s, d)))
query("rows_changed", f"{_STATE} SELECT count(*) FILTER (id % 9 = 0) AS added, count(*) FILTER (id % 10 = 1 AND id % 9 <> 0) AS removed, count(*) FILTER (id % 9 <> 0 AND id % 10 <> 1 AND id % 4 = 0) AS changed FROM r WHERE NOT (id % 9 = 0 AND id % 10 = 1)")(
    lambda s, d: (lambda r: upkeep.changed_rows(r.filter("id % 9 <> 0"), r.filter("id % 10 <> 1").withColumn("category", F.expr("CASE WHEN id % 4 = 0 THEN 'moved' ELSE category END")), ["category", "needs_review"]))(_rows(s, d)))
query("own_digits", """SELECT DISTINCT right(d, 4) AS digits FROM (SELECT lpad(CAST(o_orderkey % 300 AS VARCHAR), 4, '0') AS d FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT lpad(CAST(c_custkey % 50 + 900 AS VARCHAR), 4, '0') FROM customer UNION ALL SELECT '7777')""")(
    lambda s, d: upkeep.own_digits(src.table(s, d, "orders").select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'XX' || lpad(CAST(o_orderkey % 300 AS STRING), 4, '0') WHEN o_orderkey % 3 = 1 THEN 'XX12' END").alias("paid_from")),
                                   src.table(s, d, "customer").select(F.expr("lpad(CAST(c_custkey % 50 + 900 AS STRING), 4, '0')").alias("last4")), s.createDataFrame([("7777",)], "last4 string")))
query("rows_to_own_accounts", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 300 < 40")(
    lambda s, d: upkeep.to_own_account(src.table(s, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'a/c ' || lpad(CAST(o_orderkey % 300 AS STRING), 6, '0') END").alias("payee_handle")), s.range(40).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("digits"))).select("o_orderkey"))
query("accounts_of_ignored_names", "SELECT DISTINCT lpad(CAST(c_custkey % 90 AS VARCHAR), 4, '0') AS last4 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")(
    lambda s, d: upkeep.accounts_of_ignored(s.createDataFrame([("Building", "ignored"), ("machinery", "fun")], "name string, category string"), src.table(s, d, "customer").select(F.col("c_mktsegment").alias("payee"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'x@' || lpad(CAST(c_custkey % 90 AS STRING), 4, '0') END").alias("payee_handle"))))
query("rules_fingerprint", "SELECT count(*) AS rows, true AS same, true AS other FROM part")(lambda s, d: _prints(s, d))


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = src.table(spark, sf_dir, "part").select("p_name", "p_type")
    one, again, less = upkeep.rules_print(p), upkeep.rules_print(p.orderBy(F.desc("p_type"))), upkeep.rules_print(p.withColumn("p_type", F.lower("p_type")))
    both = one.join(again.select(F.col("print").alias("_b")), F.lit(True)).join(less.select(F.col("print").alias("_c")), F.lit(True))  # one row each
    return both.select("rows", (F.col("print") == F.col("_b")).alias("same"), (F.col("print") != F.col("_c")).alias("other"))


query("file_forgotten", f"""{_M}, t AS (SELECT id, refund_of, id % 3 <> 0 AS only_a, id % 4 = 0 AS in_b FROM m), k AS (SELECT * FROM t WHERE NOT only_a OR in_b) SELECT id, CASE WHEN refund_of IN (SELECT id FROM k) THEN refund_of END AS refund_of FROM k""")(
    lambda s, d: upkeep.forgotten(src.movements(s, d).select("id", "refund_of", F.filter(F.array(F.when(F.col("id") % 3 != 0, "a"), F.when((F.col("id") % 4 == 0) | (F.col("id") % 3 == 0), "b")), lambda x: x.isNotNull()).alias("sources")), "a").select("id", "refund_of"))
_EDITS = "SELECT c_custkey % 40 AS stay, c_custkey AS seen_at, CASE c_custkey % 7 WHEN 3 THEN 'remove' WHEN 0 THEN 'add' ELSE 'change' END AS op, CASE c_custkey % 11 WHEN 5 THEN ' ' ELSE c_mktsegment END AS place, CASE c_custkey % 3 WHEN 0 THEN 'goa' WHEN 1 THEN 'WB' END AS region, DATE '2020-01-01' + CAST(c_custkey % 50 AS INT) AS first, DATE '2020-01-01' + CAST(c_custkey % 80 AS INT) AS last FROM customer"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("c_custkey"), F.lit("2020-01-01").cast("date")
    return src.table(spark, sf_dir, "customer").select(
        (k % 40).alias("stay"), k.alias("at"), F.when(k % 7 == 3, "remove").when(k % 7 == 0, "add").otherwise("change").alias("op"), F.when(k % 11 == 5, " ").otherwise(F.col("c_mktsegment")).alias("place"), F.when(k % 3 == 0, "goa").when(k % 3 == 1, "WB").alias("region"),
        F.date_add(day, (k % 50).cast("int")).alias("first"), F.date_add(day, (k % 80).cast("int")).alias("last"))


query("stays_after_edits", f"""WITH e AS ({_EDITS}), f AS (SELECT *, row_number() OVER (PARTITION BY stay ORDER BY seen_at DESC) AS k FROM e WHERE op = 'remove' OR (trim(place) <> '' AND first <= last))
SELECT stay, place, CASE region WHEN 'goa' THEN 'GA' ELSE region END AS region, first, last, seen_at FROM f WHERE k = 1 AND op <> 'remove'""")(lambda s, d: upkeep.stays_after(_edits(s, d)).withColumnRenamed("at", "seen_at"))
query("stays_checked", f"WITH e AS ({_EDITS}) SELECT CASE WHEN trim(place) = '' THEN 'no name' WHEN first > last THEN 'days the wrong way' END AS reason, count(*) AS edits FROM e GROUP BY 1")(
    lambda s, d: _edits(s, d).groupBy(upkeep.checked_stay().alias("reason")).agg(F.count(F.lit(1)).alias("edits")))
query("accounts_claimed", "WITH e AS (SELECT c_custkey % 60 AS last4, c_custkey AS seen_at, c_custkey % 4 = 0 AS gone, c_name FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY last4 ORDER BY seen_at DESC) AS k FROM e) SELECT last4, seen_at, c_name FROM f WHERE k = 1 AND NOT gone")(
    lambda s, d: upkeep.last_told(src.table(s, d, "customer").select((F.col("c_custkey") % 60).alias("last4"), F.col("c_custkey").alias("at"), F.when(F.col("c_custkey") % 4 == 0, "remove").otherwise("claim").alias("op"), "c_name"), "last4").withColumnRenamed("at", "seen_at"))
query("statements_held_and_confirmed", """WITH a AS (SELECT o_custkey AS statement, o_orderkey AS seen_at, o_orderkey % 3 = 0 AS confirm, o_orderkey % 3 = 1 AS correct FROM orders), g AS (SELECT statement, bool_or(confirm) AS ok, arg_max(seen_at % 100, seen_at) FILTER (correct) AS n FROM a GROUP BY 1)
SELECT c_custkey AS statement, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN ok THEN 'counted' ELSE 'held' END ELSE 'counted' END AS status, CASE WHEN c_custkey % 2 = 0 THEN coalesce(n, 5) ELSE 5 END AS rows FROM customer LEFT JOIN g ON statement = c_custkey""")(
    lambda s, d: upkeep.statements_after(src.table(s, d, "customer").select(F.col("c_custkey").alias("statement"), F.when(F.col("c_custkey") % 2 == 0, "held").otherwise("counted").alias("status"), F.lit(5).cast("bigint").alias("rows")),
                                         src.table(s, d, "orders").select(F.col("o_custkey").alias("statement"), F.col("o_orderkey").alias("at"), F.element_at(F.array(F.lit("confirm"), F.lit("correct"), F.lit("look")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("action"), (F.col("o_orderkey") % 100).alias("rows")).withColumn("rows", F.when(F.col("action") == "correct", F.col("rows")))))
query("held_rows_rebuilt", """WITH b AS (SELECT o_custkey AS statement, o_orderkey AS line, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, o_orderkey % 4 = 0 AS cr FROM orders), f AS (SELECT statement, CASE WHEN line % 6 = 0 THEN NULL WHEN line % 6 = 1 THEN c + 1 ELSE c END AS c, CASE WHEN line % 6 = 1 THEN NOT cr ELSE cr END AS cr FROM b)
SELECT statement, CAST(coalesce(sum(c) FILTER (NOT cr), 0) AS BIGINT) AS debits, CAST(coalesce(sum(c) FILTER (cr), 0) AS BIGINT) AS credits, count(*) AS rows FROM f WHERE c IS NOT NULL GROUP BY 1""")(lambda s, d: _rebuilt(s, d))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.money import cents

    rows = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), F.col("o_orderkey").alias("line"), cents("o_totalprice").alias("cents"), (F.col("o_orderkey") % 4 == 0).alias("credit"))
    fix = rows.filter("line % 6 < 2").select("statement", "line", F.when(F.col("line") % 6 == 1, F.col("cents") + 1).alias("cents"), (~F.col("credit")).alias("credit"))
    return upkeep.rebuilt(rows, fix)


query("second_page", f"{_M} SELECT id, ts FROM m ORDER BY ts DESC, id LIMIT 60 OFFSET 60")(lambda s, d: upkeep.pages(src.movements(s, d).select("id", "ts"), [F.desc("ts"), "id"], 60, 2))

# Beside figures.
query("categories_labelled", f"{_M}, t AS (SELECT DISTINCT split_part(category, '.', 1) AS p, category AS c FROM m) SELECT category, upper(category) AS label, CASE WHEN contains(category, '.') THEN upper(split_part(category, '.', 1)) END AS parent_label, count(*) AS rows FROM m GROUP BY 1")(lambda s, d: _labelled(s, d))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = src.movements(spark, sf_dir)
    own = m.select(F.col("category").alias("id"), F.when(F.col("category").contains("."), F.split_part("category", F.lit("."), F.lit(1))).alias("parent")).distinct()
    tree = own.unionByName(own.filter("parent is not null").select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")).distinct()).withColumn("label", F.upper("id"))
    return notes.labelled(m.select("category"), tree).groupBy("category", "label", "parent_label").agg(F.count(F.lit(1)).alias("rows"))


query("unnamed_waiting", f"{COUNTED} SELECT count(*) AS rows, CAST(coalesce(sum(cents), 0) AS BIGINT) / 100.0::DOUBLE AS amount FROM counted WHERE {_IN98} AND id % 9 = 0")(
    lambda s, d: notes.waiting(rows_of(s, d).withColumn("payee", F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("payee"))), Y1998))
query("names_waiting", f"{COUNTED} SELECT payee, count(*) AS rows, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE AS amount FROM counted WHERE id % 6 = 0 GROUP BY 1")(
    lambda s, d: bills.names_waiting(rows_of(s, d).withColumn("top", F.when(F.col("id") % 6 == 0, "uncategorised").otherwise(F.col("top")))))
query("reading_times", """SELECT user_id AS batch, count(*) AS files, count(*) FILTER (event_type = 'purchase') AS read, count(*) FILTER (event_type = 'error') AS failed, CAST(0 AS BIGINT) AS waiting, CAST(floor(epoch(max(CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 90 SECOND END))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""")(
    lambda s, d: notes.run_times(src.table(s, d, "events").select(F.col("user_id").alias("batch"), F.when(F.col("event_type") == "purchase", "read").when(F.col("event_type") == "error", "failed").otherwise("other").alias("status"), F.col("ts").alias("queued"), F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("interval 90 seconds")).alias("finished"))))
query("files_and_missing", "SELECT lang AS kind, count(*) AS files, count(*) FILTER (doc_id % 7 = 0) AS missing, CAST(coalesce(sum(n_chars) FILTER (doc_id % 7 <> 0), 0) AS BIGINT) AS bytes FROM documents GROUP BY 1")(
    lambda s, d: notes.files_summary(src.table(s, d, "documents").select(F.col("lang").alias("kind"), F.col("n_chars").alias("size"), (F.col("doc_id") % 7 != 0).alias("found"))))
query("everything_kept", "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'files', count(*) FROM documents")(
    lambda s, d: notes.kept({"orders": src.table(s, d, "orders"), "customers": src.table(s, d, "customer"), "files": src.table(s, d, "documents")}))
query("payment_sources", "WITH t AS (SELECT o_custkey AS file, 'XX' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 4, '0') AS mask FROM orders UNION ALL SELECT o_custkey, 'XXXX' || lpad(CAST(o_orderkey % 3 AS VARCHAR), 2, '0') FROM orders WHERE o_orderkey % 2 = 0) SELECT file, mask, count(*) AS rows FROM t GROUP BY 1, 2")(
    lambda s, d: notes.payment_sources(src.table(s, d, "orders").select(F.col("o_custkey").alias("file"), F.expr("'from XX' || lpad(CAST(o_orderkey % 7 AS STRING), 4, '0') || CASE WHEN o_orderkey % 2 = 0 THEN ' by XXXX' || lpad(CAST(o_orderkey % 3 AS STRING), 2, '0') ELSE ' end' END").alias("text"))))
_TOLD = "SELECT CASE c_custkey % 2 WHEN 0 THEN lower(c_mktsegment) ELSE c_mktsegment || '.' END AS place, CASE c_custkey % 3 WHEN 0 THEN 'GA' WHEN 1 THEN 'WB' END AS region, c_custkey AS told FROM customer"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return src.table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("."))).alias("place"), F.when(k % 3 == 0, "GA").when(k % 3 == 1, "WB").alias("region"), k.alias("told"))


query("places_told_before", f"WITH t AS ({_TOLD}) SELECT replace(lower(place), '.', '') AS key, region, arg_max(place, told) AS place, max(told) AS told FROM t WHERE region IS NOT NULL GROUP BY 1, 2")(lambda s, d: notes.told_before(_told(s, d)))
query("distinct_places", f"WITH t AS ({_TOLD}) SELECT replace(lower(place), '.', '') AS key, arg_max(place, told) AS place FROM t GROUP BY 1")(lambda s, d: notes.distinct_places(_told(s, d)))
query("ticks_still_shown", f"{_M} SELECT id FROM m WHERE id % 6 = 0 AND channel = 'upi'")(lambda s, d: (lambda m: notes.still_shown(m.filter("id % 6 = 0"), m.filter("channel = 'upi'")))(src.movements(s, d)))
query("highlights", f"""{COUNTED}, p AS (SELECT * FROM counted WHERE bucket = 'spent' AND {_IN98}), q AS (SELECT month(eff_day) AS mo, sum(signed) AS b FROM counted WHERE bucket = 'spent' AND eff_day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1), r AS (SELECT month(eff_day) AS mo, sum(signed) AS a FROM p GROUP BY 1)
SELECT * FROM (SELECT 'biggest' AS what, owner_payee AS name, cents / 100.0::DOUBLE AS amount FROM p WHERE n = 1 ORDER BY cents DESC, ts, id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'shop', owner_shop, CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE FROM p GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'month', strftime(eff_day, '%Y-%m'), CAST(sum(signed) AS BIGINT) / 100.0::DOUBLE FROM p GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL SELECT 'against', CAST(count(*) AS VARCHAR), CAST(sum(a - b) AS BIGINT) / 100.0::DOUBLE FROM r JOIN q USING (mo)""")(lambda s, d: notes.highlights(rows_of(s, d), Y1998))  # fmt: skip
_CUT = Period(dt.date(1997, 2, 10), dt.date(1997, 9, 30))
query("estimates_of_whole_months", f"""WITH {src.MOVEMENTS_SQL}, {_PLACED}, {_MONTHS}, e AS (SELECT card, month, CAST(floor(CAST(estimate * days AS DOUBLE) / of_days + 0.5) AS BIGINT) AS c, ms >= DATE '1997-02-10' AND last_day(ms) <= DATE '1997-09-30' AS whole FROM pm WHERE covered_by IS NULL AND estimate > 0 AND last_day(ms) >= DATE '1997-02-10' AND ms <= DATE '1997-09-30'),
u AS (SELECT * FROM e WHERE (whole AND card IN (SELECT card FROM e WHERE whole GROUP BY 1 HAVING sum(c) > 50)) OR (NOT whole AND c > 50)) SELECT month, whole, CAST(sum(c) AS BIGINT) AS cents FROM u GROUP BY 1, 2""")(lambda s, d: notes.whole_month_estimates(_placed(s, d), _CUT))  # fmt: skip
query("notes_beside_an_answer", f"""{COUNTED} SELECT (SELECT count(*) FROM nation WHERE DATE '1995-01-01' + CAST(n_nationkey * 61 AS INT) <= DATE '1997-09-30' AND DATE '1995-01-01' + CAST(n_nationkey * 61 + 89 AS INT) >= DATE '1997-02-10') AS held, min(strftime(day, '%Y-%m')) > '1997-02' AS starts_later, min(strftime(day, '%Y-%m')) AS starts,
CAST(coalesce(sum(CASE WHEN eff_day BETWEEN DATE '1997-02-10' AND DATE '1997-09-30' AND top = 'investments' THEN signed END), 0) AS BIGINT) / 100.0::DOUBLE AS left_out, 'nobody' AS unmatched FROM counted""")(
    lambda s, d: notes.beside(rows_of(s, d), src.stays(s, d), _CUT, ("customer", "nobody")))
query("why_nothing", "SELECT 'no such payee' AS reason")(lambda s, d: notes.why_nothing(rows_of(s, d), Y1998, "nobody here"))
query("suggested_questions", f"""{COUNTED}, y AS (SELECT max(year(day)) AS y, min(year(day)) AS f FROM counted), t AS (SELECT top, y, sum(signed) AS s FROM counted, y WHERE bucket = 'spent' AND year(eff_day) = y GROUP BY 1, 2 HAVING sum(signed) > 50 ORDER BY s DESC, top LIMIT 1)
SELECT CAST(1 AS INT) AS place, 'How much on ' || lower(top) || ' in ' || y || '?' AS question FROM t UNION ALL SELECT 2, 'Top 5 payees in ' || y FROM y UNION ALL SELECT 3, CASE WHEN f < y THEN 'Compare ' || (y - 1) || ' and ' || y ELSE 'Biggest payments in ' || y END FROM y""")(lambda s, d: notes.suggestions(rows_of(s, d)))  # fmt: skip
