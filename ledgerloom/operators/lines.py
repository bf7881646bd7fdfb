"""Statements as lines of text (file, line, text): tokens, rows by shape and by header, printed figures, parts of a file.

Everything is column expressions and windows over the lines of one file; files are independent, so they are read in
parallel, and no file is brought to one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import read_date
from ..functions.money import signed_cents
from .proof import signed_rows

DATE = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9]{4}"
TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AaPp][Mm])?"
MONEY = r"[-+(]?(?:₹|Rs\.? ?|INR ?)?[0-9][0-9,]*\.[0-9]{2}\)?(?: ?(?:Cr|Dr|CR|DR)\b)?"
#: A token, the first that fits at its place: a date, a time, money, another number, a word.
TOKEN = rf"({DATE}|{TIME}|{MONEY}|[0-9][0-9,]*|[^\s0-9]+)"


def tokens(lines: DataFrame) -> DataFrame:
    """(file, line, place, kind, token): what a line is made of, in order; kinds are date, time, money, number and text."""
    each = lines.select("file", "line", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).alias("place", "token"))
    is_ = lambda p: F.col("token").rlike(f"^(?:{p})$")
    kind = F.when(is_(DATE), "date").when(is_(TIME), "time").when(is_(MONEY), "money").when(is_(r"[0-9][0-9,]*"), "number").otherwise("text")
    return each.select("file", "line", "place", kind.alias("kind"), "token")


def rows_by_shape(lines: DataFrame) -> DataFrame:
    """(file, line, day, details, amounts): lines that begin with a date and have amounts of money behind; the text between is
    the details, and amounts keep their marks."""
    # Generated as one value each: below a plain select a filter would have them worked out twice. Lines without a day go first.
    day = read_date(F.regexp_extract("text", rf"^\s*({DATE})\b", 1))
    dated = lines.select("file", "line", "text", F.inline(F.array(F.struct(day.alias("day"))))).filter("day is not null")
    found = F.regexp_extract_all("text", F.lit(f"({MONEY})"), F.lit(1))
    rows = dated.select("file", "line", "text", "day", F.inline(F.array(F.struct(found.alias("amounts"))))).filter(F.size("amounts") > 0)
    rest = F.regexp_replace(F.regexp_replace("text", rf"^\s*(?:{DATE})\b", ""), MONEY, " ")
    return rows.select("file", "line", "day", F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("details"), "amounts")


#: Ways in which the amounts of a row can be meant, and the columns of each from the right.
LAYOUTS = {"amount": 1, "debit+credit": 2, "amount+balance": 2}


def readings(rows: DataFrame) -> DataFrame:
    """(statement, reading, line, day, details, cents, mark, sign, balance): rows by shape under each layout that has its columns
    in them: the last amount; the last two as debit and credit, of which one is zero; the last two as amount and balance."""
    # What an amount says is read once, before its row is read under every layout.
    mark = lambda t: F.nullif(F.lower(F.regexp_extract(t, r"(?i)(cr|dr)$", 1)), F.lit(""))
    said = F.transform(F.slice("amounts", -F.least(F.size("amounts"), F.lit(2)), 2), lambda t: F.struct(signed_cents(t).alias("cents"), mark(t).alias("mark"), F.nullif(F.regexp_extract(t, r"^([-+])", 1), F.lit("")).alias("sign")))
    each = rows.filter(F.size("amounts") > 0).select("file", "line", "day", "details", F.inline(F.array(F.struct(said.alias("_said")))))
    each = each.select("*", F.explode(F.array(*[F.lit(x) for x in LAYOUTS])).alias("reading"))
    last, before = F.try_element_at("_said", F.lit(-1)), F.try_element_at("_said", F.lit(-2))
    by_columns = F.abs(before["cents"]) > 0
    is_ = lambda name: F.col("reading") == name
    one = F.when(is_("amount"), last).when(is_("amount+balance"), before).otherwise(F.when(by_columns, before).otherwise(last))
    fits = is_("amount") | ((F.size("_said") >= 2) & (~is_("debit+credit") | ((before["cents"] == 0) != (last["cents"] == 0))))
    marked = F.when(~is_("debit+credit"), one["mark"]).otherwise(F.when(by_columns, "dr").otherwise("cr"))
    sign = F.when(~is_("debit+credit"), one["sign"])
    return each.filter(fits).select(F.col("file").alias("statement"), "reading", "line", "day", "details", F.abs(one["cents"]).alias("cents"), marked.alias("mark"), sign.alias("sign"), F.when(is_("amount+balance"), last["cents"]).alias("balance"))


#: Words of a header and what stands below them (fixed values).
COLUMNS = [("date", "date"), ("details", "details|description|narration|particulars"), ("debit", "debit|withdrawal"), ("credit", "credit|deposit"), ("balance", "balance"), ("amount", "amount")]


def rows_by_header(lines: DataFrame) -> DataFrame:
    """(file, line, header, day, details, debit, credit, amount, balance): lines below a header, cut where two spaces or more
    stand, each part under the header's word in its place. A header names a date and two other columns at least."""
    cells = F.split(F.trim("text"), r"\s{2,}")

    def what(cell: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(COLUMNS):
            out = F.when(F.lower(cell).rlike(f"^(?:{words})"), F.lit(name)).otherwise(out)
        return out

    named = F.transform(cells, what)
    is_header = F.array_contains(named, "date") & (F.size(F.filter(named, lambda c: c.isNotNull())) >= 3)
    line = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumns({"_cells": cells, "_head": F.when(is_header, named), "_at": F.when(is_header, F.col("line"))})
    rows = rows.withColumns({"_above": F.last("_head", ignorenulls=True).over(line), "header": F.last("_at", ignorenulls=True).over(line)}).filter("_head is null and _above is not null")
    cell = lambda name: F.get("_cells", (F.array_position("_above", name) - 1).cast("int"))
    out = rows.select("file", "line", "header", read_date(cell("date")).alias("day"), cell("details").alias("details"), *[signed_cents(cell(c)).alias(c) for c in ("debit", "credit", "amount", "balance")])
    return out.filter("day is not null and coalesce(debit, credit, amount) is not null")


#: Figures of a statement by their label (fixed values).
FIGURES = {"previous": "previous balance|opening balance", "due": "total (?:amount )?due|closing balance", "printed_debits": "total debits|purchases", "printed_credits": "total credits|payments received", "minimum": "minimum (?:amount )?due"}


def figures(lines: DataFrame) -> DataFrame:
    """(file, a column for each of FIGURES): the first money behind a label on its line, else the first on the line below; of
    several lines with a label the first that has money."""
    line = Window.partitionBy("file").orderBy("line")
    rows = lines.withColumn("_below", F.lead("text").over(line))
    found = []
    for name, words in FIGURES.items():
        has = F.lower("text").rlike(words)
        beside = F.regexp_extract("text", rf"(?i)(?:{words})[^0-9₹(+-]*({MONEY})", 1)
        below = F.regexp_extract(F.coalesce("_below", F.lit("")), rf"^\s*({MONEY})", 1)
        value = F.when(has, signed_cents(F.coalesce(F.nullif(beside, F.lit("")), F.nullif(below, F.lit("")))))
        found.append(F.min_by(value, F.when(value.isNotNull(), F.col("line"))).alias(name))
    return rows.groupBy("file").agg(*found)


def months(lines: DataFrame) -> DataFrame:
    """(file, month, debits, credits): the lines of a summary of several statements: a month, then two amounts."""
    p = rf"^\s*((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[- ][0-9]{{4}})\s+({MONEY})\s+({MONEY})"
    part = lambda i: F.regexp_extract("text", p, i)
    rows = lines.filter(F.col("text").rlike(p))
    return rows.select("file", F.try_to_timestamp(F.regexp_replace(part(1), "-", " "), F.lit("MMM yyyy")).cast("date").alias("month"), F.abs(signed_cents(part(2))).alias("debits"), F.abs(signed_cents(part(3))).alias("credits"))


def segments(lines: DataFrame, starts: str) -> DataFrame:
    """Adds part, from 1: which statement of its file a line belongs to; lines before the first start belong to it."""
    line = Window.partitionBy("file").orderBy("line")
    return lines.withColumn("part", F.greatest(F.lit(1), F.sum(F.lower("text").rlike(starts).cast("int")).over(line)).cast("int"))


#: Headings of parts that hold no rows, and of those that do again (fixed values).
TERMS, BACK = "terms and conditions|schedule of charges|important information", "transactions|account summary"


def outside_terms(lines: DataFrame) -> DataFrame:
    """The lines that do not lie between a heading of terms or charges and the next heading of rows."""
    line = Window.partitionBy("file").orderBy("line")
    flag = F.when(F.lower("text").rlike(TERMS), True).when(F.lower("text").rlike(BACK), False)
    return lines.withColumn("_in", F.coalesce(F.last(flag, ignorenulls=True).over(line), F.lit(False))).filter("not _in").drop("_in")


def without_page_numbers(lines: DataFrame) -> DataFrame:
    """Lines without `Page 3 of 9`, and without those that are nothing else."""
    t = F.trim(F.regexp_replace("text", r"(?i)\bpage\s*[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?", ""))
    return lines.withColumn("text", t).filter("text <> ''")


def median_start(rows: DataFrame, key: str, position: str) -> DataFrame:
    """(key, start): the middle position at which details begin in a table, the lower of two; wrapped lines begin there too."""
    return rows.groupBy(key).agg(F.expr(f"percentile_disc(0.5) within group (order by {position})").alias("start"))


def nearest_reading(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement, reading, convention, off, rows): for statements that nothing proves the reading that comes nearest to the
    balances, or without printed ones that with the most rows; then by name."""
    tried = signed_rows(rows).groupBy("statement", "reading", "convention").agg(
        F.sum(F.when(F.col("credit"), -F.col("cents")).otherwise(F.col("cents"))).alias("_net"), F.count(F.lit(1)).alias("rows"))
    off = F.col("previous") + F.col("_net") - F.col("due")
    held = statements.join(tried, "statement").withColumn("off", off)
    order = F.struct(F.abs(F.coalesce("off", F.lit(0))).alias("a"), (-F.col("rows")).alias("n"), "reading", "convention", "off", "rows")
    return held.groupBy("statement").agg(F.min(order).alias("_b")).select("statement", "_b.reading", "_b.convention", "_b.off", "_b.rows")


def arithmetic(statements: DataFrame, totals: DataFrame) -> DataFrame:
    """(statement, holds, difference): whether previous - credits + debits is what is due, by the control totals of its rows; null
    where a figure is not printed."""
    off = F.col("previous") - F.col("credits") + F.col("debits") - F.col("due")
    return statements.join(totals, "statement", "left").select("statement", (off == 0).alias("holds"), off.alias("difference"))
