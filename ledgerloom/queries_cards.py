"""Queries of imports, cards and bills over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cards, cascade, intervals
from .plans import cards as plan
from .queries import _BILLS, _CYCLES, _IN98, COUNTED, Y1998, _statements, query, rows_of
from .sources import movements as src


# Imports: a fifth of the movements comes again by a transaction's number, a fifth minutes later under a longer name, a fifth
# as a card statement's row, and a fifth from a second file of a card; the last fifth is new.
def _imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = src.movements(spark, sf_dir).filter("refund_of is null").withColumns({"_k": F.col("id") % 5, "_two": F.lpad((F.col("id") % 89 + 10).cast("string"), 2, "0")})
    k, none = F.col("_k"), F.lit(None).cast("string")
    refs = lambda utr, txn, row: F.map_filter(F.create_map(F.lit("utr"), utr, F.lit("txnId"), txn, F.lit("cardRow"), row), lambda _, v: v.isNotNull())
    number = F.col("id").cast("string")
    old = m.select("id", "ts", "cents", "direction", "payee", "channel", "card", F.when(k == 3, F.concat(F.lit("XX12"), "_two")).otherwise(F.concat(F.lit("XXXX"), "_two")).alias("paid_from"), F.lit("a").alias("file"),
                   refs(none, F.when(k == 0, F.concat(F.lit("T"), number)), F.when(k == 3, F.concat(F.lit("r"), number))).alias("refs"))
    later = F.when(k == 1, F.expr("interval 4 minutes")).when(k.isin(2, 3), F.expr("interval 1 day")).when(k == 4, F.expr("interval 400 days")).otherwise(F.expr("interval 0 days"))
    new = m.select((F.col("id") + 5 * 10**9).alias("id"), (F.col("ts") + later).alias("ts"), "cents", "direction", F.when(k == 1, F.concat("payee", F.lit(" Ltd"))).when(k == 2, "POS").otherwise(F.col("payee")).alias("payee"), F.when(k == 2, "card").otherwise(F.col("channel")).alias("channel"), "card",
                   F.when(k.isin(2, 3), F.concat(F.lit("XX12"), "_two")).alias("paid_from"), F.lit("b").alias("file"), refs(none, F.when(k == 0, F.concat(F.lit("T"), number)), F.when(k.isin(2, 3), F.concat(F.lit("s"), number))).alias("refs"))
    return old, new


_IMPORTED = f"""WITH {src.MOVEMENTS_SQL}, b AS (SELECT *, id % 5 AS k, lpad(CAST(id % 89 + 10 AS VARCHAR), 2, '0') AS two FROM m WHERE refund_of IS NULL),
o AS (SELECT id, ts, cents, direction, regexp_replace(lower(payee), '[^a-z0-9]', '', 'g') AS key, channel, card, CASE WHEN k = 3 THEN 'XX12' ELSE 'XXXX' END || two AS paid, CASE WHEN k = 0 THEN 'T' || id END AS txn, CASE WHEN k = 3 THEN 'r' || id END AS crow FROM b),
n AS (SELECT id + 5000000000 AS id, ts + CASE k WHEN 1 THEN INTERVAL 4 MINUTE WHEN 2 THEN INTERVAL 1 DAY WHEN 3 THEN INTERVAL 1 DAY WHEN 4 THEN INTERVAL 400 DAY ELSE INTERVAL 0 DAY END AS ts, cents, direction,
  regexp_replace(lower(CASE k WHEN 1 THEN payee || ' Ltd' WHEN 2 THEN 'POS' ELSE payee END), '[^a-z0-9]', '', 'g') AS key, CASE WHEN k = 2 THEN 'card' ELSE channel END AS channel, card, CASE WHEN k IN (2, 3) THEN 'XX12' || two END AS paid, CASE WHEN k = 0 THEN 'T' || id END AS txn, CASE WHEN k IN (2, 3) THEN 's' || id END AS crow FROM b),
p AS (SELECT n.id AS new_id, o.id AS old_id, abs(epoch(n.ts)::BIGINT - epoch(o.ts)::BIGINT) AS apart, abs(date_diff('day', CAST(n.ts AS DATE), CAST(o.ts AS DATE))) AS days, NOT coalesce(n.txn <> o.txn, false) AND NOT (n.crow IS NOT NULL AND o.crow IS NOT NULL AND n.crow <> o.crow) AS fits,
  contains(n.key, o.key) OR contains(o.key, n.key) AS alike, n.key AS nk, o.key AS ok, n.ts AS nt, o.ts AS ot, n.txn AS ntx, o.txn AS otx, n.crow AS nc, o.crow AS oc, n.paid AS np, o.paid AS op, n.channel AS nch, o.channel AS och, n.card AS ncard, o.card AS ocard
  FROM n JOIN o ON n.cents = o.cents AND n.direction = o.direction),
h AS (SELECT new_id, old_id, 1 AS tier, CASE WHEN ntx = otx THEN 2 ELSE 4 END AS rank, apart FROM p WHERE fits AND (ntx = otx OR (nk = ok AND date_trunc('minute', nt) = date_trunc('minute', ot)))
UNION ALL SELECT new_id, old_id, 2, 0, apart FROM p WHERE fits AND alike AND apart <= 600
UNION ALL SELECT new_id, old_id, 3, 0, apart FROM p WHERE fits AND (nc IS NULL) <> (oc IS NULL) AND right(np, 2) = right(op, 2) AND regexp_matches(CASE WHEN nc IS NULL THEN np ELSE op END, '^X{{4}}[0-9]{{2}}$') AND days <= CASE WHEN (CASE WHEN oc IS NOT NULL THEN nch ELSE och END) = 'upi' THEN 1 ELSE 3 END
UNION ALL SELECT new_id, old_id, 4, 0, apart FROM p WHERE nc IS NOT NULL AND oc IS NOT NULL AND nc <> oc AND ncard = ocard AND days <= 3 AND NOT coalesce(ntx <> otx, false))"""
# A second row for each movement, of the same batch and file, that wants the same record: by the number again (joins it), within
# minutes under another number, as another row of the statement, as another row of the second file (all three are too late:
# the record has a number, a row or the file by then), and the new movement again (joins the first of the batch).
def _rivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old, new = _imports(spark, sf_dir)
    k, number = F.col("id") % 5, F.col("id").cast("string")
    put = lambda name, value: F.map_concat(F.map_filter("refs", lambda key, _: key != name), F.create_map(F.lit(name), value))
    first = new.withColumn("refs", F.when(k == 1, put("txnId", F.concat(F.lit("A"), number))).otherwise(F.col("refs")))
    second = new.withColumns({"id": F.col("id") + 10**9, "refs": F.when(k == 1, put("txnId", F.concat(F.lit("B"), number))).when(k.isin(2, 3), put("cardRow", F.concat(F.lit("t"), number))).otherwise(F.col("refs"))})
    return old, first.unionByName(second.withColumn("ts", F.col("ts") + F.when(k == 1, F.expr("interval 2 minutes")).otherwise(F.expr("interval 0 minutes")))).withColumn("arrived", F.col("id"))


_RIVALS = f"WITH {src.MOVEMENTS_SQL}, b AS (SELECT *, id % 5 AS k, lpad(CAST(id % 89 + 10 AS VARCHAR), 2, '0') AS two FROM m WHERE refund_of IS NULL)"
query("import_cascade", f"""{_RIVALS} SELECT id + 5000000000 AS id, CASE k WHEN 4 THEN id + 5000000000 ELSE id END AS root, CASE WHEN k < 4 THEN CAST(k + 1 AS INT) END AS tier FROM b
UNION ALL SELECT id + 6000000000, CASE k WHEN 0 THEN id WHEN 4 THEN id + 5000000000 ELSE id + 6000000000 END, CASE WHEN k IN (0, 4) THEN 1 END FROM b""")(lambda s, d: cascade.linked(*_rivals(s, d)).filter("id >= 5000000000"))
query("records_after_import", f"""{_RIVALS} SELECT id, payee, channel, card, CASE k WHEN 3 THEN 'XX12' ELSE 'XXXX' END || two AS paid_from, 'a,b' AS files, CASE k WHEN 0 THEN 'txnId=T' || id WHEN 1 THEN 'txnId=A' || (id + 5000000000) WHEN 2 THEN 'cardRow=s' || id WHEN 3 THEN 'cardRow2=s' || id || ' cardRow=r' || id ELSE '' END AS refs FROM b WHERE k < 4
UNION ALL SELECT id, payee, channel, card, 'XXXX' || two, 'a', '' FROM b WHERE k = 4 UNION ALL SELECT id + 5000000000, payee, channel, card, NULL, 'b', '' FROM b WHERE k = 4
UNION ALL SELECT id + 6000000000, CASE k WHEN 1 THEN payee || ' Ltd' WHEN 2 THEN 'POS' ELSE payee END, CASE k WHEN 2 THEN 'card' ELSE channel END, card, CASE WHEN k IN (2, 3) THEN 'XX12' || two END, 'b', CASE k WHEN 1 THEN 'txnId=B' ELSE 'cardRow=t' END || (id + 5000000000) FROM b WHERE k IN (1, 2, 3)""")(
    lambda s, d: cascade.imported(*_rivals(s, d))[1].select("id", "payee", "channel", "card", "paid_from", F.concat_ws(",", F.array_sort("sources")).alias("files"), F.concat_ws(" ", F.array_sort(F.transform(F.map_entries("refs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))).alias("refs")))
query("import_counts", f"{_IMPORTED}, b1 AS (SELECT new_id, min(tier) AS tier FROM h GROUP BY 1) SELECT CAST(coalesce(tier, 0) AS INT) AS tier, count(*) AS records FROM n LEFT JOIN b1 ON n.id = new_id GROUP BY 1")(
    lambda s, d: _import_counts(*_imports(s, d)))


def _import_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    found = cascade.matches(old, new).select(F.col("new_id").alias("id"), "tier")
    return new.select("id").join(found, "id", "left").groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count(F.lit(1)).alias("records"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every movement three times under one root: the statement's row, the app's record, and a refund's wording of it."""
    m = src.movements(spark, sf_dir).filter("refund_of is null").select("id", "ts", "cents", "direction", "payee", "channel", "card", "category")
    kind = F.when(F.col("direction") == "credit", "income").otherwise("spend")
    part = lambda i, payee, kind, refs, card, source: m.select((F.col("id") * 3 + i).alias("id"), (F.col("id") * 3).alias("root"), (F.col("ts") + F.expr(f"interval {i} hours")).alias("ts"), "cents", "direction", kind.alias("kind"), payee.alias("payee"), F.lit(["card", "upi", "upi"][i]).alias("channel"), F.lit(["XX1", "XXXX2", "X"][i]).alias("paid_from"), card.alias("card"), F.concat("category", F.lit(f"/{i}")).alias("category"), refs.alias("refs"), F.array(F.lit(source), F.lit("f")).alias("sources"))
    number = F.col("id").cast("string")
    a = part(0, F.lit("POS"), kind, F.create_map(F.lit("cardRow"), number), F.col("card"), "s")
    b = part(1, F.col("payee"), kind, F.create_map(F.lit("txnId"), F.concat(F.lit("T"), number)), F.lit(None).cast("string"), "p")
    c = part(2, F.lit("Refund"), F.when(F.col("direction") == "credit", "refund").otherwise(kind), F.create_map(F.lit("txnId"), F.lit("later"), F.lit("utr"), number), F.lit("9"), "p")
    return a.unionByName(b).unionByName(c)


query("records_folded", f"""WITH {src.MOVEMENTS_SQL} SELECT id * 3 AS id, ts + INTERVAL 2 HOUR AS ts, 'Refund' AS payee, 'upi' AS channel, 'X' AS paid_from, card, CASE direction WHEN 'credit' THEN 'refund' ELSE 'spend' END AS kind, category || CASE direction WHEN 'credit' THEN '/2' ELSE '/0' END AS category,
cents, direction, 'f,p,s' AS sources, CAST(id AS VARCHAR) || CASE direction WHEN 'credit' THEN '/later/' ELSE '/T' || id || '/' END || id AS refs, CAST(3 AS BIGINT) AS records FROM m WHERE refund_of IS NULL""")(
    lambda s, d: cascade.folded(_roots(s, d)).withColumns({"sources": F.concat_ws(",", F.array_sort("sources")), "refs": F.concat_ws("/", F.col("refs")["cardRow"], F.col("refs")["txnId"], F.col("refs")["utr"])}))


# Cards: customers as cards seen in files.
def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return src.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("Bank "), (k % 3).cast("string")).alias("issuer"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("product"), F.lpad((k % 40 + 100).cast("string"), 4, "0").alias("last4"),
        F.when(k % 4 == 0, "RuPay").when(k % 4 == 1, "Visa").alias("network"), F.concat(F.lit("f"), F.lpad((k % 7).cast("string"), 2, "0")).alias("file"), k.alias("at"))


_SEEN = """WITH seen AS (SELECT 'Bank ' || (c_custkey % 3) AS issuer, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS product, lpad(CAST(c_custkey % 40 + 100 AS VARCHAR), 4, '0') AS last4, CASE c_custkey % 4 WHEN 0 THEN 'RuPay' WHEN 1 THEN 'Visa' END AS network, 'f' || lpad(CAST(c_custkey % 7 AS VARCHAR), 2, '0') AS file, c_custkey AS seen_at FROM customer),
cards AS (SELECT 'card-' || replace(lower(issuer), ' ', '-') || '-' || last4 AS card, last4, arg_min(issuer, seen_at) AS issuer, arg_min(product, seen_at) FILTER (product IS NOT NULL) AS product, arg_min(network, seen_at) FILTER (network IS NOT NULL) AS network, min(seen_at) AS first_seen, array_to_string(list_sort(list_distinct(list(file))), ',') AS files FROM seen GROUP BY 1, 2)"""
query("cards_registered", f"{_SEEN} SELECT card, last4, issuer, product, network, first_seen, files FROM cards")(lambda s, d: cards.registered(_seen(s, d)).withColumn("files", F.concat_ws(",", "files")))
query("card_of_mask", f"""{_SEEN}, x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'XX1234' ELSE 'XXXX' || lpad(CAST(o_orderkey % 45 AS VARCHAR), 2, '0') END AS paid, CASE WHEN o_orderkey % 3 = 0 THEN 'upi' ELSE 'card' END AS channel FROM orders),
e AS (SELECT right(last4, 2) AS ends, list_distinct(list(card)) AS a, list_distinct(list(card) FILTER (lower(network) = 'rupay')) AS t, list_distinct(list(card) FILTER (network IS NULL)) AS u FROM cards GROUP BY 1),
y AS (SELECT o_orderkey, CASE WHEN channel <> 'upi' THEN a WHEN len(t) > 0 THEN t ELSE u END AS among FROM x LEFT JOIN e ON regexp_extract(paid, '^X{{4}}([0-9]{{2}})$', 1) = ends)
SELECT o_orderkey, CASE WHEN len(among) = 1 THEN among[1] END AS found_card FROM y""")(
    lambda s, d: cards.card_of(src.table(s, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'XX1234' ELSE 'XXXX' || lpad(CAST(o_orderkey % 45 AS STRING), 2, '0') END").alias("paid_from"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'upi' ELSE 'card' END").alias("channel")), cards.registered(_seen(s, d))).select("o_orderkey", "found_card"))
query("cards_on_histories", """WITH t AS (SELECT 'f' || (o_orderkey % 9) AS file, CASE o_orderkey % 4 WHEN 0 THEN 'Axis' WHEN 1 THEN 'HDFC' WHEN 2 THEN 'unknown' ELSE 'axis hdfc axis' END AS bank, lpad(CAST(o_orderkey % 50 AS VARCHAR), 4, '0') AS last4, o_orderkey % 5 = 0 AS visa FROM orders)
SELECT file, CASE WHEN contains(lower(bank), 'axis') THEN 'Axis' ELSE 'HDFC' END AS issuer, last4, min(CASE WHEN visa THEN 'visa' END) AS network FROM t WHERE bank <> 'unknown' GROUP BY 1, 2, 3""")(
    lambda s, d: cards.cards_in(src.table(s, d, "orders").select(F.expr("'f' || (o_orderkey % 9)").alias("file"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Axis' WHEN 1 THEN 'HDFC' WHEN 2 THEN 'unknown' ELSE 'axis hdfc axis' END || ' card ending ' || lpad(CAST(o_orderkey % 50 AS STRING), 4, '0') || CASE WHEN o_orderkey % 5 = 0 THEN ' visa' ELSE '' END").alias("text")), {"Axis": "axis", "HDFC": "hdfc"}, {"visa": "visa"}))


# Bills: the driver's bills as those of apps; statements list two in three of them, a day late and a rupee off, and others.
def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = src.bills(src.movements(spark, sf_dir)).withColumn("_n", F.month("month_start") + 12 * F.year("month_start"))
    apps = b.select(F.col("bill").alias("id"), "card", F.col("paid").alias("day"), "cents")
    rows = b.filter("_n % 3 <> 0").select(F.concat(F.lit("s"), "bill").alias("id"), "card", F.date_add("paid", (F.col("_n") % 4).cast("int")).alias("day"), (F.col("cents") + F.col("_n") % 2 * 100 + F.when(F.col("_n") % 7 == 0, F.col("cents")).otherwise(0)).alias("cents"))
    return apps, rows.withColumn("ts", F.col("day").cast("timestamp_ntz"))


_SIDES = f"""{_BILLS}, nb AS (SELECT *, month(month_start) + 12 * year(month_start) AS n FROM bills), r AS (SELECT 's' || bill AS id, card, paid + CAST(n % 4 AS INT) AS day, cents + n % 2 * 100 + CASE WHEN n % 7 = 0 THEN cents ELSE 0 END AS cents FROM nb WHERE n % 3 <> 0),
h AS (SELECT r.id AS row, r.day, b.bill, row_number() OVER (PARTITION BY r.id ORDER BY r.cents <> b.cents, abs(date_diff('day', r.day, b.paid)), b.bill) AS k FROM r JOIN bills b ON b.card = r.card AND abs(date_diff('day', r.day, b.paid)) <= 5 AND abs(r.cents - b.cents) * 100 <= b.cents * 5)"""
query("statement_rows_settled", f"{_SIDES} SELECT r.id AS row, h.bill FROM r LEFT JOIN h ON h.row = r.id AND k = 1")(lambda s, d: (lambda a: cards.settled(a[1], a[0]))(_sides(s, d)))
query("bills_of_apps_and_statements", f"{_SIDES} SELECT origin, count(*) AS bills, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT 'app' AS origin, cents FROM bills UNION ALL SELECT 'statement', cents FROM r WHERE id NOT IN (SELECT row FROM h)) GROUP BY 1")(
    lambda s, d: cards.all_bills(*_sides(s, d)).groupBy("origin").agg(F.count(F.lit(1)).alias("bills"), F.sum("cents").alias("cents")))
_ENDS = "st AS (SELECT bill || '/s' AS statement, card, CAST(month_start + INTERVAL 1 MONTH AS DATE) + CAST((CAST(card AS INT) + month(month_start) % 3) AS INT) AS last FROM bills WHERE month(month_start) % 4 <> 1)"


def _month_ends(bills: DataFrame) -> DataFrame:
    return bills.filter("month(month_start) % 4 <> 1").select(F.concat("bill", F.lit("/s")).alias("statement"), "card", F.date_add(F.add_months("month_start", 1), F.expr("cast(cast(card as int) + month(month_start) % 3 as int)")).alias("last"))


def _end(day: str, k: str) -> str:
    from .queries import _end_sql

    return _end_sql(day, k)


query("bills_placed_by_statements", f"""{_BILLS}, {_ENDS}, nr AS (SELECT b.bill, b.card, b.paid, st.last, row_number() OVER (PARTITION BY b.bill ORDER BY abs(date_diff('day', st.last, b.paid)), st.last) AS k FROM bills b JOIN st ON st.card = b.card),
c AS (SELECT bill, card, paid, day(last) AS d, {_end("CAST(paid - INTERVAL 1 DAY AS DATE)", "day(last)")} AS cyc FROM nr WHERE k = 1),
f AS (SELECT c.bill, statement, last, row_number() OVER (PARTITION BY c.bill ORDER BY abs(date_diff('day', last, cyc)), last, statement) AS k FROM c JOIN st ON st.card = c.card AND abs(date_diff('day', last, cyc)) <= 3 AND last < paid),
g AS (SELECT c.bill, f.statement, coalesce(f.last, cyc) AS cycle_last, coalesce(day(f.last), d) AS d FROM c LEFT JOIN f ON f.bill = c.bill AND f.k = 1)
SELECT bill, statement, CAST({_end("CAST(cycle_last - INTERVAL 1 DAY AS DATE)", "d")} + INTERVAL 1 DAY AS DATE) AS cycle_first, cycle_last FROM g""")(
    lambda s, d: (lambda b: cards.placed_by_statements(b, _month_ends(b)))(src.bills(src.movements(s, d))))


# Figures.
def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills with their cycles, covered or not, and an estimate of half of what was paid."""
    m = src.movements(spark, sf_dir)
    out = intervals.covered_by(intervals.cycles_of(src.bills(m)), _statements(m).filter("first >= date'1996-01-01'"))
    return out.withColumn("estimate", F.expr("cents div 2"))


_PLACED = f"""{src.BILLS_SQL}{_CYCLES}, sts AS (SELECT * FROM (SELECT card || '/' || year(day) || '-' || ((month(day) - 1) // 6) AS statement, card, min(day) AS first, max(day) AS last FROM m GROUP BY 1, 2) WHERE first >= DATE '1996-01-01'),
placed AS (SELECT c2.*, cents // 2 AS estimate, (SELECT min(statement) FROM sts WHERE sts.card = c2.card AND first <= cycle_first AND last >= cycle_last) AS covered_by FROM c2)"""
_MONTHS = """pm AS (SELECT bill, card, cents, estimate, covered_by, CAST(t AS DATE) AS ms, strftime(t, '%Y-%m') AS month, date_diff('day', greatest(CAST(t AS DATE), cycle_first), least(last_day(CAST(t AS DATE)), cycle_last)) + 1 AS days, date_diff('day', cycle_first, cycle_last) + 1 AS of_days
FROM placed, generate_series(date_trunc('month', cycle_first), CAST(cycle_last AS TIMESTAMP), INTERVAL 1 MONTH) AS g(t))"""
_SUMS = lambda c, w: f"CAST(coalesce(sum(CASE WHEN {w} THEN {c} END), 0) AS BIGINT)"
query("card_figures", f"""{COUNTED}, {src.BILLS_SQL}, a AS (SELECT {_SUMS('signed', "bucket = 'spent' AND owner_channel = 'card'")} / 100.0::DOUBLE AS itemised, {_SUMS('n', "bucket = 'spent' AND owner_channel = 'card'")} AS itemised_payments, {_SUMS('signed', "bucket = 'spent' AND owner_channel <> 'card'")} / 100.0::DOUBLE AS via_upi, {_SUMS('n', "bucket = 'spent' AND owner_channel <> 'card'")} AS via_upi_payments,
{_SUMS('signed', "owner_channel = 'card' AND top = 'fees'")} / 100.0::DOUBLE AS fees, {_SUMS('cents', "owner_channel = 'card' AND refund_of IS NOT NULL")} / 100.0::DOUBLE AS refunded, {_SUMS('cents', "owner_channel = 'card' AND bucket = 'cashback'")} / 100.0::DOUBLE AS cashback FROM counted WHERE {_IN98}),
b AS (SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) / 100.0::DOUBLE AS bills_paid, count(*) AS bills FROM bills WHERE paid BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') SELECT * FROM a, b""")(lambda s, d: plan.figures(rows_of(s, d), src.bills(src.movements(s, d)), Y1998))  # fmt: skip
query("card_estimate_parts", f"""WITH {src.MOVEMENTS_SQL}, {_PLACED}, {_MONTHS}, e AS (SELECT bill, card, CAST(sum(days) AS DOUBLE) / of_days AS share, CAST(floor(CAST(estimate * sum(days) AS DOUBLE) / of_days + 0.5) AS BIGINT) AS cents FROM pm WHERE covered_by IS NULL AND month BETWEEN '1998-01' AND '1998-12' GROUP BY bill, card, estimate, of_days)
SELECT * FROM e WHERE card IN (SELECT card FROM e GROUP BY card HAVING sum(cents) > 50)""")(lambda s, d: plan.estimate_parts(_placed(s, d), Y1998))
query("covered_bills_part", f"""WITH {src.MOVEMENTS_SQL}, {_PLACED}, {_MONTHS}, e AS (SELECT bill, CAST(floor(CAST(cents * sum(days) AS DOUBLE) / of_days + 0.5) AS BIGINT) AS cents FROM pm WHERE covered_by IS NOT NULL AND month BETWEEN '1998-01' AND '1998-12' GROUP BY bill, pm.cents, of_days)
SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, count(*) AS bills FROM e""")(lambda s, d: plan.covered_part(_placed(s, d), Y1998))
query("left_out_share_of_bills", f"""{COUNTED}, {_PLACED}, x AS (SELECT bill, sum(CASE direction WHEN 'debit' THEN c.cents ELSE -c.cents END) AS a, sum(CASE WHEN top = 'investments' THEN CASE direction WHEN 'debit' THEN c.cents ELSE -c.cents END ELSE 0 END) AS o
FROM placed p JOIN counted c ON c.card = p.card AND c.channel <> 'card' AND c.day BETWEEN cycle_first AND cycle_last GROUP BY 1)
SELECT p.bill, CASE WHEN a > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(o AS DOUBLE) / CAST(a AS DOUBLE))) ELSE 0.0::DOUBLE END AS share FROM placed p LEFT JOIN x ON x.bill = p.bill""")(lambda s, d: plan.left_out_share(_placed(s, d), rows_of(s, d)))  # fmt: skip
_TREND = f"""{COUNTED}, {_PLACED}, {_MONTHS}, cal AS (SELECT strftime(x, '%Y-%m') AS month, last_day(CAST(x AS DATE)) AS e FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH) AS t(x)),
rd AS (SELECT owner_card AS card, strftime(eff_day, '%Y-%m') AS month, sum(signed) AS r FROM counted WHERE bucket = 'spent' AND owner_channel = 'card' AND {_IN98} GROUP BY 1, 2),
bl AS (SELECT card, month, sum(CAST(floor(CAST(estimate * days AS DOUBLE) / of_days + 0.5) AS BIGINT)) AS b, sum(days) AS d FROM pm WHERE covered_by IS NULL GROUP BY 1, 2),
cd AS (SELECT DISTINCT card, CAST(t AS DATE) AS day FROM sts, generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY) AS g(t)), cv AS (SELECT card, strftime(day, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) / max(day(last_day(day))) AS s FROM cd GROUP BY 1, 2),
tr AS (SELECT k.card, cal.month, CASE WHEN coalesce(s, 0) > 0 OR coalesce(d, 0) > 0 OR abs(coalesce(r, 0)) > 0 THEN CAST(coalesce(r, 0) + coalesce(b, 0) AS BIGINT) / 100.0::DOUBLE END AS amount, coalesce(CAST(d AS DOUBLE) / day(e) > coalesce(s, 0), false) AS estimated
FROM (SELECT card FROM sts UNION SELECT card FROM bills) k CROSS JOIN cal LEFT JOIN rd ON rd.card = k.card AND rd.month = cal.month LEFT JOIN bl ON bl.card = k.card AND bl.month = cal.month LEFT JOIN cv ON cv.card = k.card AND cv.month = cal.month)"""


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = _statements(src.movements(spark, sf_dir)).filter("first >= date'1996-01-01'")
    return plan.trends(spark, rows_of(spark, sf_dir), _placed(spark, sf_dir), statements, Y1998)


query("card_trends", f"{_TREND} SELECT card, month, amount, estimated FROM tr")(_trend)
query("months_together", f"{_TREND} SELECT month, CAST(round(sum(amount) * 100) AS BIGINT) AS cents, bool_or(estimated) AS estimated FROM tr WHERE amount IS NOT NULL GROUP BY 1")(
    lambda s, d: plan.together(_trend(s, d)).select("month", F.round(F.col("amount") * 100).cast("bigint").alias("cents"), "estimated"))
query("colour_slots", f"{COUNTED} SELECT category, CAST(row_number() OVER (ORDER BY amount DESC, category) AS INT) AS slot FROM (SELECT category, sum(signed) AS amount FROM counted WHERE bucket = 'spent' GROUP BY 1) QUALIFY slot <= 7")(
    lambda s, d: plan.slots(rows_of(s, d).filter("bucket = 'spent'").groupBy("category").agg(F.sum("signed").alias("amount")), "category", 7))
query("card_weights", f"""{COUNTED}, {src.BILLS_SQL} SELECT card, CAST(sum(c) AS BIGINT) / 100.0::DOUBLE AS amount FROM (SELECT owner_card AS card, signed AS c FROM counted WHERE bucket = 'spent' AND {_IN98}
UNION ALL SELECT card, cents FROM bills WHERE paid BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') GROUP BY 1""")(lambda s, d: plan.weights(rows_of(s, d), src.bills(src.movements(s, d)), Y1998))  # fmt: skip
