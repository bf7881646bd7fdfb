"""Queries of statements as lines of text, printed from the driver's orders: a file for each customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.money import cents
from .operators import columns
from .operators import lines as op
from .operators import proof, wrapped
from .queries import query
from .sources import movements as src


def _amount(c: Column) -> Column:
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer: previous balance, a header, rows in two shapes, terms, totals beside and below their labels."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") * 10).alias("line"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), cents("o_totalprice").alias("c"), F.lower("o_orderpriority").alias("p"))
    day, amount = F.date_format("d", "dd/MM/yyyy"), _amount(F.col("c"))
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(day, F.lit(" 10:15 am "), "p", F.lit(" ref "), F.col("k").cast("string"), F.lit(" "), amount, F.lit(" Cr")))
        .when(F.col("k") % 4 == 1, F.concat(day, F.lit("  "), "p", F.lit("  "), amount, F.lit("  0.00  "), _amount(F.col("c") + 500)))
        .when(F.col("k") % 4 == 2, F.concat(day, F.lit(" "), "p", F.lit(" -"), amount)).otherwise(F.concat(F.lit("see "), "p", F.lit(" Page "), (F.col("k") % 9).cast("string"), F.lit(" of 9")))
    )
    body = o.select("file", "line", text.alias("text"))
    own = o.groupBy("file").agg(F.sum("c").alias("c"))
    extra = F.array(
        F.struct(F.lit(-4).alias("line"), F.concat(F.lit("Previous Balance: "), _amount(F.col("c") + 100)).alias("text")), F.struct(F.lit(-3).alias("line"), F.lit("Date  Details  Debit  Credit  Balance").alias("text")),
        F.struct(F.lit(-2).alias("line"), F.concat(F.lit("May-2024 "), _amount(F.col("c")), F.lit(" 12.00")).alias("text")), F.struct((F.lit(10**12)).alias("line"), F.lit("Terms and Conditions").alias("text")),
        F.struct((F.lit(10**12) + 1).alias("line"), F.lit("01/01/2024 late fee 100.00").alias("text")), F.struct((F.lit(10**12) + 2).alias("line"), F.lit("Account summary page 2").alias("text")),
        F.struct((F.lit(10**12) + 3).alias("line"), F.lit("Total Amount Due").alias("text")), F.struct((F.lit(10**12) + 4).alias("line"), _amount(F.col("c") + 7).alias("text")),
    )
    return body.unionByName(own.select("file", F.inline(extra)).select("file", F.col("line").cast("bigint").alias("line"), "text"))


_A = "CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
_D = "strftime(d, '%d/%m/%Y')"
_LINES = f"""WITH o AS (SELECT o_custkey AS file, o_orderkey * 10 AS line, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, lower(o_orderpriority) AS p FROM orders),
w AS (SELECT file, CAST(sum(c) AS BIGINT) AS c FROM o GROUP BY 1),
t AS (SELECT file, line, CASE k % 4 WHEN 0 THEN {_D} || ' 10:15 am ' || p || ' ref ' || k || ' ' || {_A.format(c='c')} || ' Cr' WHEN 1 THEN {_D} || '  ' || p || '  ' || {_A.format(c='c')} || '  0.00  ' || {_A.format(c='(c + 500)')} WHEN 2 THEN {_D} || ' ' || p || ' -' || {_A.format(c='c')} ELSE 'see ' || p || ' Page ' || (k % 9) || ' of 9' END AS text FROM o
UNION ALL SELECT file, -4, 'Previous Balance: ' || {_A.format(c='(c + 100)')} FROM w UNION ALL SELECT file, -3, 'Date  Details  Debit  Credit  Balance' FROM w UNION ALL SELECT file, -2, 'May-2024 ' || {_A.format(c='c')} || ' 12.00' FROM w
UNION ALL SELECT file, 1000000000000, 'Terms and Conditions' FROM w UNION ALL SELECT file, 1000000000001, '01/01/2024 late fee 100.00' FROM w UNION ALL SELECT file, 1000000000002, 'Account summary page 2' FROM w
UNION ALL SELECT file, 1000000000003, 'Total Amount Due' FROM w UNION ALL SELECT file, 1000000000004, {_A.format(c='(c + 7)')} FROM w)"""
_TOK = op.TOKEN.replace("'", "''")
query("line_tokens", f"""{_LINES}, x AS (SELECT file, line, unnest(regexp_extract_all(text, '{_TOK}')) AS token, generate_subscripts(regexp_extract_all(text, '{_TOK}'), 1) - 1 AS place FROM t)
SELECT file, line, CAST(place AS INT) AS place, CASE WHEN regexp_matches(token, '^(?:{op.DATE})$') THEN 'date' WHEN regexp_matches(token, '^(?:{op.TIME})$') THEN 'time' WHEN regexp_matches(token, '^(?:{op.MONEY})$') THEN 'money' WHEN regexp_matches(token, '^(?:[0-9][0-9,]*)$') THEN 'number' ELSE 'text' END AS kind, token FROM x""")(
    lambda s, d: op.tokens(_lines(s, d)))
query("rows_by_shape", f"""{_LINES} SELECT file, line, d AS day, CASE k % 4 WHEN 0 THEN '10:15 am ' || p || ' ref ' || k ELSE p END AS details, CASE k % 4 WHEN 0 THEN {_A.format(c='c')} || ' Cr' WHEN 1 THEN {_A.format(c='c')} || ',0.00,' || {_A.format(c='(c + 500)')} ELSE '-' || {_A.format(c='c')} END AS amounts FROM o WHERE k % 4 < 3
UNION ALL SELECT file, 1000000000001, DATE '2024-01-01', 'late fee', '100.00' FROM w""")(lambda s, d: op.rows_by_shape(_lines(s, d)).withColumn("amounts", F.concat_ws(",", "amounts")))  # fmt: skip
query("layout_readings", f"""{_LINES} SELECT file AS statement, reading, line, CASE WHEN k % 4 = 1 THEN CASE reading WHEN 'amount' THEN c + 500 WHEN 'debit+credit' THEN c + 500 ELSE 0 END ELSE c END AS cents,
CASE WHEN reading = 'debit+credit' THEN 'cr' WHEN k % 4 = 0 THEN 'cr' END AS mark, CASE WHEN k % 4 = 2 THEN '-' END AS sign, CASE WHEN reading = 'amount+balance' THEN c + 500 END AS balance
FROM o, (VALUES ('amount'), ('debit+credit'), ('amount+balance')) AS v(reading) WHERE k % 4 < 3 AND (reading = 'amount' OR k % 4 = 1) UNION ALL SELECT file, 'amount', 1000000000001, 10000, NULL, NULL, NULL FROM w""")(
    lambda s, d: op.readings(op.rows_by_shape(_lines(s, d))).select("statement", "reading", "line", "cents", "mark", "sign", "balance"))
query("rows_by_header", f"{_LINES} SELECT file, line, CAST(-3 AS BIGINT) AS header, d AS day, p AS details, c AS debit, CAST(0 AS BIGINT) AS credit, CAST(NULL AS BIGINT) AS amount, c + 500 AS balance FROM o WHERE k % 4 = 1")(lambda s, d: op.rows_by_header(_lines(s, d)))
query("statement_figures", f"{_LINES} SELECT file, c + 100 AS previous, c + 7 AS due, CAST(NULL AS BIGINT) AS printed_debits, CAST(NULL AS BIGINT) AS printed_credits, CAST(NULL AS BIGINT) AS minimum FROM w")(lambda s, d: op.figures(_lines(s, d)))
query("months_summed_up", f"{_LINES} SELECT file, DATE '2024-05-01' AS month, c AS debits, CAST(1200 AS BIGINT) AS credits FROM w")(lambda s, d: op.months(_lines(s, d)))
query("file_segments", f"{_LINES} SELECT file, line, CAST(greatest(1, sum(CASE WHEN regexp_matches(lower(text), '1-urgent') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line)) AS INT) AS part FROM t")(
    lambda s, d: op.segments(_lines(s, d), "1-urgent").select("file", "line", "part"))
query("lines_outside_terms", f"{_LINES} SELECT file, line, text FROM t WHERE line NOT IN (1000000000000, 1000000000001)")(lambda s, d: op.outside_terms(_lines(s, d)))
query("lines_without_page_numbers", rf"{_LINES}, u AS (SELECT file, line, trim(regexp_replace(text, '(?i)\bpage\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?', '', 'g')) AS text FROM t) SELECT * FROM u WHERE text <> ''")(lambda s, d: op.without_page_numbers(_lines(s, d)))
query("median_starts", "SELECT o_custkey, quantile_disc(length(o_orderpriority), 0.5) AS start FROM orders GROUP BY 1")(
    lambda s, d: op.median_start(src.table(s, d, "orders").withColumn("x", F.length("o_orderpriority").cast("bigint")), "o_custkey", "x").withColumn("start", F.col("start").cast("bigint")))


# Proof: each customer's orders of 1995 to 1997 as rows marked in one of three ways, totals over a span that is a day or two off.
def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, credit = F.col("o_custkey"), F.col("o_orderkey") % 4 == 0
    o = src.table(spark, sf_dir, "orders").select(k.alias("statement"), F.explode(F.array(F.lit("wide"), F.lit("narrow"))).alias("reading"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("_c"), credit.alias("credit"), "o_orderkey")
    m = F.col("statement") % 3
    return o.select("statement", "reading", "day", (F.col("_c") + F.when((F.col("reading") == "narrow") & (F.col("o_orderkey") % 7 == 0), 1).otherwise(0)).alias("cents"), F.when(F.col("credit") & (m == 0), "Cr").alias("mark"),
                    F.when(F.col("credit") & (m == 1), "-").when(F.col("credit") & (m == 2), "+").alias("sign"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that the wide reading meets, but for every fifth statement, which prints a balance a unit off; every seventh prints none."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), cents("o_totalprice").alias("c"), (F.col("o_orderkey") % 4 == 0).alias("credit"))
    t = o.groupBy("statement").agg(F.coalesce(F.sum(F.when(~F.col("credit"), F.col("c"))), F.lit(0)).alias("d"), F.coalesce(F.sum(F.when(F.col("credit"), F.col("c"))), F.lit(0)).alias("r"))
    s, none = F.col("statement"), F.lit(None).cast("bigint")
    return t.select("statement", F.when(s % 7 != 0, s * 13 + 1).otherwise(none).alias("previous"), F.when(s % 7 != 0, s * 13 + 1 - F.col("r") + F.col("d") + F.when(s % 5 == 0, 177).otherwise(0)).otherwise(none).alias("due"), none.alias("printed_debits"), none.alias("printed_credits"))


_MARKED = """WITH b AS (SELECT o_custkey AS statement, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, o_orderkey % 4 = 0 AS credit, o_orderkey AS k FROM orders),
x AS (SELECT b.*, reading, convention, c + CASE WHEN reading = 'narrow' AND k % 7 = 0 THEN 1 ELSE 0 END AS cents, credit AND convention = CASE statement % 3 WHEN 0 THEN 'marked' WHEN 1 THEN 'minus' ELSE 'plus' END AS cr FROM b, (VALUES ('wide'), ('narrow')) AS r(reading), (VALUES ('marked'), ('minus'), ('plus')) AS v(convention)),
h AS (SELECT statement, CAST(coalesce(sum(c) FILTER (NOT credit), 0) AS BIGINT) AS d, CAST(coalesce(sum(c) FILTER (credit), 0) AS BIGINT) AS r FROM b GROUP BY 1),
hd AS (SELECT statement, CASE WHEN statement % 7 <> 0 THEN statement * 13 + 1 END AS previous, CASE WHEN statement % 7 <> 0 THEN statement * 13 + 1 - r + d + CASE WHEN statement % 5 = 0 THEN 177 ELSE 0 END END AS due FROM h),
g AS (SELECT statement, reading, convention, CAST(sum(CASE WHEN cr THEN 0 ELSE cents END) AS BIGINT) AS debits, CAST(sum(CASE WHEN cr THEN cents ELSE 0 END) AS BIGINT) AS credits, count(*) AS rows, list_sort(list(day || '/' || cents || '/' || cr)) AS rset FROM x GROUP BY 1, 2, 3)"""
query("statements_proven", f"""{_MARKED}, p0 AS (SELECT g.*, previous, abs(previous - credits + debits - due) AS off, CASE WHEN due % 100 = 0 THEN 50 ELSE 0 END AS slack FROM g JOIN hd USING (statement)),
p AS (SELECT *, CASE WHEN min(off) OVER (PARTITION BY statement) = 0 THEN off = 0 ELSE off <= slack END AS ok FROM p0),
a AS (SELECT statement, max(CASE WHEN previous IS NOT NULL THEN 1 ELSE 0 END) AS chk, count(DISTINCT CASE WHEN ok THEN rset END) AS sets, min(CASE WHEN ok THEN reading || '/' || CASE convention WHEN 'marked' THEN 1 WHEN 'minus' THEN 2 ELSE 3 END END) AS best FROM p GROUP BY 1)
SELECT a.statement, CASE WHEN chk = 0 THEN 'nothing to check by' WHEN sets = 0 THEN 'unproven' WHEN sets = 1 THEN 'proven' ELSE 'ambiguous' END AS status, p.reading, p.convention, p.debits, p.credits FROM a LEFT JOIN p ON p.statement = a.statement AND chk = 1 AND sets = 1 AND best = p.reading || '/' || CASE p.convention WHEN 'marked' THEN 1 WHEN 'minus' THEN 2 ELSE 3 END""")(
    lambda s, d: proof.prove(_marked(s, d), _heads(s, d)))
query("nearest_readings", f"""{_MARKED}, n AS (SELECT g.statement, reading, convention, previous + debits - credits - due AS off, rows FROM g JOIN hd USING (statement))
SELECT statement, reading, convention, off, rows FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY abs(coalesce(off, 0)), rows DESC, reading, convention) AS k FROM n) WHERE k = 1""")(lambda s, d: op.nearest_reading(_marked(s, d), _heads(s, d)))  # fmt: skip
query("control_totals", f"{_MARKED} SELECT statement, d AS debits, r AS credits, (SELECT count(*) FROM b WHERE b.statement = h.statement) AS rows FROM h")(
    lambda s, d: proof.control_totals(src.table(s, d, "orders").select(F.col("o_custkey").alias("statement"), cents("o_totalprice").alias("cents"), (F.col("o_orderkey") % 4 == 0).alias("credit"))))
query("statement_arithmetic", f"{_MARKED} SELECT statement, CASE WHEN statement % 7 <> 0 THEN statement % 5 <> 0 END AS holds, CASE WHEN statement % 7 <> 0 THEN CASE WHEN statement % 5 = 0 THEN -177 ELSE 0 END END::BIGINT AS difference FROM h")(
    lambda s, d: op.arithmetic(_heads(s, d), proof.control_totals(src.table(s, d, "orders").select(F.col("o_custkey").alias("statement"), cents("o_totalprice").alias("cents"), (F.col("o_orderkey") % 4 == 0).alias("credit")))))
query("statement_outliers", """WITH b AS (SELECT o_custkey AS statement, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT statement, quantile_disc(date_diff('day', DATE '1970-01-01', day), 0.5) AS mid FROM b GROUP BY 1)
SELECT statement, o_orderkey, abs(date_diff('day', DATE '1970-01-01', day) - mid) > 400 AS outlier FROM b JOIN m USING (statement)""")(
    lambda s, d: proof.outliers(src.table(s, d, "orders").select(F.col("o_custkey").alias("statement"), "o_orderkey", F.to_date("o_orderdate").alias("day"))).select("statement", "o_orderkey", "outlier"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the days from 1995 to 1997 of each customer, and a span that begins up to three days early or late."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("c"), (F.col("o_orderkey") % 4 == 0).alias("credit"))
    t = o.groupBy("statement").agg(*[F.coalesce(F.sum(F.when(F.col("day").between("1995-01-01", "1997-12-31") & (F.col("credit") == flag), F.col("c"))), F.lit(0)).alias(n) for n, flag in (("debits", False), ("credits", True))])
    return t.select("statement", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("statement") % 9 - 4).cast("int")).alias("first"), F.lit("1997-12-31").cast("date").alias("last"), "debits", "credits")


def _trapped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every statement; two thirds hold 123.45 more than the rows within the span come to."""
    return _spans(spark, sf_dir).select("statement", F.lit("1995-01-01").cast("date").alias("first"), "last", (F.col("debits") + F.when(F.col("statement") % 3 < 2, 12345).otherwise(0)).alias("debits"), "credits")


def _trapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows marked. Of every third statement a row of 123.45 lies within reach on either side of the span, so that either could be
    the one its totals hold; of the next, only the one before it. Statements with other rows so near are left to the others."""
    s, mark = F.col("statement"), F.when(F.col("o_orderkey") % 4 == 0, "Cr").otherwise("Dr")
    rows = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), F.lit("wide").alias("reading"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("cents"), mark.alias("mark"), F.lit(None).cast("string").alias("sign"))
    sides = F.array(F.struct(F.lit("1994-12-30").cast("date").alias("day"), F.lit(True).alias("early")), F.struct(F.lit("1998-01-02").cast("date").alias("day"), F.lit(False).alias("early")))
    more = _spans(spark, sf_dir).select("statement", F.inline(sides)).filter((s % 3 == 0) | ((s % 3 == 1) & F.col("early")))
    more = more.select("statement", F.lit("wide").alias("reading"), "day", F.lit(12345).cast("bigint").alias("cents"), F.lit("Dr").alias("mark"), F.lit(None).cast("string").alias("sign"))
    near = F.col("day").between("1994-12-28", "1995-01-03") | F.col("day").between("1997-12-29", "1998-01-03")
    return rows.unionByName(more).join(rows.filter(near).select("statement").distinct(), "statement", "left_anti")


_CYCLED = """, sp AS (SELECT statement, CAST(coalesce(sum(c) FILTER (NOT credit AND day BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'), 0) AS BIGINT) AS debits, CAST(coalesce(sum(c) FILTER (credit AND day BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'), 0) AS BIGINT) AS credits FROM b GROUP BY 1)"""
query("proven_over_cycles", f"""{_MARKED}{_CYCLED}, wn AS (SELECT statement, debits, credits, DATE '1995-01-01' + CAST(statement % 9 - 4 + a AS INT) AS first, DATE '1997-12-31' + CAST(z AS INT) AS last, abs(a) + abs(z) AS o FROM sp, generate_series(-3, 3) AS p(a), generate_series(-3, 3) AS q(z)),
y AS (SELECT statement, reading, convention, day, cents, cr OR (credit AND statement % 3 = 0) AS cr FROM x),
f AS (SELECT wn.statement, reading, convention, first, last, o, list_sort(list(day || '/' || cents || '/' || cr) FILTER (day BETWEEN first AND last)) AS l, list_sort(list(day || '/' || cents || '/' || cr) FILTER (day NOT BETWEEN first AND last)) AS g, count(*) FILTER (day BETWEEN first AND last) AS inside, count(*) FILTER (day NOT BETWEEN first AND last) AS beyond
  FROM wn JOIN y ON y.statement = wn.statement GROUP BY wn.statement, reading, convention, first, last, o, debits, credits HAVING coalesce(sum(CASE WHEN cr THEN 0 ELSE cents END) FILTER (day BETWEEN first AND last), 0) = debits AND coalesce(sum(CASE WHEN cr THEN cents ELSE 0 END) FILTER (day BETWEEN first AND last), 0) = credits),
k AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY CASE convention WHEN 'marked' THEN 1 WHEN 'minus' THEN 2 ELSE 3 END, o, first, last, reading) AS k FROM f), n AS (SELECT statement, count(DISTINCT coalesce(CAST(l AS VARCHAR), '') || '|' || coalesce(CAST(g AS VARCHAR), '')) AS sets FROM f GROUP BY 1)
SELECT statement, CASE sets WHEN 1 THEN 'proven' ELSE 'ambiguous' END AS status, CASE WHEN sets = 1 THEN reading END AS reading, CASE WHEN sets = 1 THEN convention END AS convention, CASE WHEN sets = 1 THEN first END AS first, CASE WHEN sets = 1 THEN last END AS last, CASE WHEN sets = 1 THEN inside END AS inside, CASE WHEN sets = 1 THEN beyond END AS beyond FROM k JOIN n USING (statement) WHERE k = 1""")(
    lambda s, d: proof.over_cycles(_marked(s, d), _spans(s, d)))
query("cycles_with_traps", f"""{_MARKED}{_CYCLED} SELECT statement, CASE WHEN statement % 3 = 0 THEN 'ambiguous' ELSE 'proven' END AS status, CASE WHEN statement % 3 = 1 THEN DATE '1994-12-30' WHEN statement % 3 = 2 THEN DATE '1995-01-01' END AS first, CASE WHEN statement % 3 > 0 THEN DATE '1997-12-31' END AS last
FROM sp WHERE statement NOT IN (SELECT statement FROM b WHERE day BETWEEN DATE '1994-12-28' AND DATE '1995-01-03' OR day BETWEEN DATE '1997-12-29' AND DATE '1998-01-03')""")(
    lambda s, d: proof.over_cycles(_trapped_rows(s, d), _trapped_spans(s, d)).select("statement", "status", "first", "last"))


# Running balances: each customer's orders in order of their keys, with a balance behind each; by fifths of the customers what is owed,
# oldest first or newest first, what is left, a balance that is a unit off once, and a first row without a mark or an opening.
def _running(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("statement"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), cents("o_totalprice").alias("cents"), (F.col("o_orderkey") % 4 == 0).alias("credit"))
    w = Window.partitionBy("statement").orderBy("k")
    s, own = F.col("statement") % 5, F.when(F.col("credit"), -F.col("cents")).otherwise(F.col("cents"))
    o = o.withColumns({"_b": F.sum(own).over(w), "_i": F.row_number().over(w)})
    balance = F.when(s == 2, 10**12 - F.col("_b")).otherwise(100_000 + F.col("_b")) + F.when((s == 3) & (F.col("_i") == 2), 1).otherwise(0)
    return o.select("statement", F.lit("shape").alias("reading"), F.when(s == 1, -F.col("k")).otherwise(F.col("k")).alias("line"), "day", "cents", F.when(F.col("credit") & (s < 4), "cr").when((s < 4) & (F.col("_i") % 3 == 0), "dr").alias("mark"), F.lit(None).cast("string").alias("sign"), balance.alias("balance"), "credit")


def _openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, none = F.col("statement") % 5, F.lit(None).cast("bigint")
    return _running(spark, sf_dir).select("statement").distinct().select("statement", F.when(s.isin(0, 1, 3), 100_000).when(s == 2, 10**12).cast("bigint").alias("previous"), *[none.alias(c) for c in ("due", "printed_debits", "printed_credits")])


# Where what is left is printed and no row says which way it goes, both meanings agree with as many rows: then it is what is owed.
query("statements_decided", f"""{_MARKED}, r AS (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY k) AS i, count(*) OVER (PARTITION BY statement) AS n FROM b),
t AS (SELECT statement, any_value(n) AS n, CAST(sum(CASE WHEN credit THEN 0 ELSE c END) AS BIGINT) AS d, CAST(sum(CASE WHEN credit THEN c ELSE 0 END) AS BIGINT) AS r, statement % 5 = 2 AND NOT bool_or(credit OR i % 3 = 0) AS untold FROM r GROUP BY 1), z AS (SELECT * REPLACE (CASE WHEN untold THEN r ELSE d END AS d, CASE WHEN untold THEN d ELSE r END AS r), n >= 2 AND statement % 5 < 3 AS ok FROM t)
SELECT statement, CASE WHEN ok THEN 'proven' ELSE 'nothing to check by' END AS status, CASE WHEN ok THEN 'running balance' END AS proof, CASE WHEN ok THEN 'shape' END AS reading, CAST(NULL AS VARCHAR) AS convention, CASE WHEN ok THEN d END AS debits, CASE WHEN ok THEN r END AS credits FROM z""")(
    lambda s, d: proof.decide(_running(s, d), _openings(s, d)))


# Statements in columns: each customer's orders, debits and credits in columns of their own (the other way round for every third), with
# blanks; every fifth prints a due that is wrong, every seventh no figures but a balance behind each row.
def _columned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("file")
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line"), F.to_date("o_orderdate").alias("d"), cents("o_totalprice").alias("c"), (F.col("o_orderkey") % 4 == 0).alias("credit"), F.lower("o_orderpriority").alias("p"))
    own = F.when(F.col("credit"), -F.col("c")).otherwise(F.col("c"))
    o = o.withColumn("b", 10**9 + F.sum(own).over(Window.partitionBy("file").orderBy("line")))
    right = F.col("credit") != (s % 3 == 0)
    start = F.rpad(F.concat(F.date_format("d", "dd/MM/yyyy"), F.lit("  "), "p"), 40, " ")
    text = F.when(s % 7 == 0, F.concat(start, F.lpad(_amount(F.col("c")), 20, " "), F.lpad(_amount(F.col("b")), 20, " "))).otherwise(F.concat(start, F.lpad(_amount(F.col("c")), F.when(right, 40).otherwise(20), " ")))
    body = o.select("file", "line", text.alias("text"))
    net = o.groupBy("file").agg(F.sum(own).alias("n"))
    heads = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("line"), F.when(s % 7 == 0, "Opening balance: 10000000.00").otherwise("Previous balance: 5000000.00").alias("text")),
        F.struct(F.lit(10**12).alias("line"), F.when(s % 7 == 0, "Thank you").otherwise(F.concat(F.lit("Total due: "), _amount(F.lit(5 * 10**8) + F.col("n") + F.when(s % 5 == 0, 177).otherwise(0)))).alias("text")),
    )
    return body.unionByName(net.filter("n > -400000000").select("file", F.inline(heads)))


query("statements_in_columns", """WITH o AS (SELECT o_custkey AS f, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, o_orderkey % 4 = 0 AS cr FROM orders),
g AS (SELECT f, count(*) AS n, count(*) FILTER (cr) AS k, CAST(coalesce(sum(c) FILTER (NOT cr), 0) AS BIGINT) AS d, CAST(coalesce(sum(c) FILTER (cr), 0) AS BIGINT) AS r FROM o GROUP BY 1),
h AS (SELECT *, CASE WHEN f % 7 = 0 THEN CASE WHEN n >= 2 THEN 'balance' WHEN k = 0 THEN 'none' ELSE 'none' END WHEN f % 5 = 0 OR k = n THEN 'open' ELSE 'figures' END AS how FROM g)
SELECT f AS statement, CASE how WHEN 'none' THEN 'nothing to check by' WHEN 'open' THEN 'unproven' ELSE 'proven' END AS status, CASE how WHEN 'balance' THEN 'running balance' WHEN 'figures' THEN 'figures' END AS proof,
CASE how WHEN 'balance' THEN 'shape:amount@0+balance@1' WHEN 'figures' THEN CASE WHEN k = 0 THEN 'shape:amount@0' WHEN f % 3 = 0 THEN 'shape:credit@0+debit@1' ELSE 'shape:debit@0+credit@1' END END AS reading, CASE WHEN how IN ('balance', 'figures') THEN d END AS debits, CASE WHEN how IN ('balance', 'figures') THEN r END AS credits FROM h""")(
    lambda s, d: columns.statements_read(_columned(s, d)).drop("convention"))


# Text broken over lines: each order as a row of its own way by remainders of its key: details on the next line, the amount there, an
# undated row below, a clock; a summary box above with labels of two lines, a header of two lines, and a part that ends the last row.
def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("d"), cents("o_totalprice").alias("c"), F.lower("o_orderpriority").alias("p"))
    at = lambda *parts: F.concat(*[F.rpad(F.lit(x) if isinstance(x, str) else x, w, " ") if w else x for x, w in parts])
    day, amount = F.date_format("d", "dd/MM/yyyy"), F.lpad(_amount(F.col("c")), 14, " ")
    plain, more = at((day, 12), (F.col("p"), 30), (amount, 0)), at(("", 12), (F.lit("of the town"), 0))
    texts = (
        F.when(k % 4 == 0, F.array(plain, more)).when(k % 4 == 1, F.array(at((day, 12), (F.col("p"), 0)), at(("", 12), (F.lit("next line"), 30), (amount, 0))))
        .when(k % 4 == 2, F.array(plain, at(("", 12), (F.lit("igst"), 30), (F.lpad(F.lit("18.00"), 14, " "), 0)))).otherwise(F.array(plain, F.lit("10:15 am"), F.lit(""), F.lit("            no details")))
    )
    body = o.select("file", F.posexplode(texts).alias("i", "text"), "k").select("file", (k * 10 + F.col("i")).alias("line"), "text")
    total = o.groupBy("file").agg(F.sum(F.col("c") + F.when(k % 4 == 2, 1800).otherwise(0)).alias("t"))
    box = ["Previous            Total amount", "balance             due", None, "", "Txn         Transaction                     Amount", "Date        Details                         (in Rs)"]
    figures = at(("5000.00", 20), (_amount(F.col("t") + 500_000), 0))
    heads = F.array(*[F.struct(F.lit(i - 100).cast("bigint").alias("line"), (figures if x is None else F.lit(x)).alias("text")) for i, x in enumerate(box)], F.struct(F.lit(10**15).alias("line"), F.lit("Total credits: 0.00").alias("text")))
    return body.unionByName(total.select("file", F.inline(heads)))


_BROKEN = """WITH o AS (SELECT o_custkey AS file, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, lower(o_orderpriority) AS p FROM orders), t AS (SELECT file, CAST(sum(c + CASE WHEN k % 4 = 2 THEN 1800 ELSE 0 END) AS BIGINT) AS t FROM o GROUP BY 1)"""
query("rows_of_broken_lines", f"""{_BROKEN} SELECT file, k * 10 AS line, d AS day, CASE WHEN k % 4 = 3 THEN '10:15 am' END AS clock, p || CASE k % 4 WHEN 0 THEN ' of the town' WHEN 1 THEN ' next line' ELSE '' END AS details, {_A.format(c='c')} AS amounts FROM o UNION ALL SELECT file, k * 10 + 1, d, NULL, 'igst', '18.00' FROM o WHERE k % 4 = 2""")(
    lambda s, d: wrapped.rows_wrapped(_broken(s, d)).select("file", "line", "day", "clock", "details", F.array_join(F.transform("amounts", lambda a: a["text"]), ",").alias("amounts")))
query("figures_of_broken_labels", f"{_BROKEN} SELECT file, CAST(500000 AS BIGINT) AS previous, t + 500000 AS due, CAST(NULL AS BIGINT) AS printed_debits, CAST(NULL AS BIGINT) AS printed_credits, CAST(NULL AS BIGINT) AS minimum FROM t")(lambda s, d: wrapped.figures_wrapped(_broken(s, d)))
query("rows_below_broken_headers", f"{_BROKEN} SELECT file, d AS day, p AS details, c AS amount FROM o WHERE k % 4 <> 1")(lambda s, d: wrapped.headed(_broken(s, d)).select("file", "day", "details", "amount"))
query("broken_statements_read", f"{_BROKEN} SELECT file AS statement, 'proven' AS status, 'figures' AS proof, t AS debits, CAST(0 AS BIGINT) AS credits FROM t")(lambda s, d: columns.statements_read(_broken(s, d)).select("statement", "status", "proof", "debits", "credits"))
