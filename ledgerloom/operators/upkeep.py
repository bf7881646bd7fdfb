"""Edits of a kept ledger as tables: answers, verdicts applied anew, files forgotten, stays and statements changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import state_code
from ..functions.text import last_digits, normal_name, place_name


def own_digits(rows: DataFrame, cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """(digits): the last four digits of everything that is one's own: what rows were paid from, cards, and accounts told."""
    paid = F.regexp_replace(F.coalesce("paid_from", F.lit("")), "[^0-9]", "")
    return rows.filter(F.length(paid) >= 4).select(F.right(paid, F.lit(4)).alias("digits")).union(cards.select("last4")).union(accounts.select("last4")).filter("digits is not null").distinct()


def to_own_account(rows: DataFrame, digits: DataFrame) -> DataFrame:
    """The rows whose payee's number ends in one's own digits."""
    return rows.withColumn("digits", last_digits(F.coalesce("payee_handle", F.lit("")))).join(digits, "digits", "left_semi").drop("digits")


def recategorised(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (id, category, decided_by, confidence, needs_review) with new verdicts (id, category, decided_by, confidence,
    needs_review), and changed: whether category or review differ.

    What a user said stays. A verdict holds if the row or it is by a name's answer, or if it is as sure as what was there; a
    row without one keeps its place, unless only an account of one's own gave it. A review is done when an answer by name
    places a row, when a verdict repeats a reviewed place, or a sure one moves it.
    """
    v = verdicts.select("id", *[F.col(c).alias(f"_{c}") for c in ("category", "decided_by", "confidence", "needs_review")])
    joined = rows.join(v, "id", "left")
    told = ["payee", "user", "self"]
    fixed, none = F.col("decided_by") == "user", F.col("_category").isNull()
    lost = ~fixed & none & (F.col("decided_by") == "self")
    takes = ~fixed & ~none & (F.col("decided_by").isin(*told, "refund") | F.col("_decided_by").isin(told) | (F.col("_confidence") >= F.col("confidence")))
    moved = F.col("_category") != F.col("category")
    done = F.col("_decided_by").isin("payee", "user") | (~F.col("needs_review") & ~moved) | (moved & (F.col("_confidence") >= 0.9) & ~F.col("_needs_review"))
    pick = lambda c, otherwise: F.when(lost, otherwise).when(takes, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    review = F.when(lost, F.lit(True)).when(takes, (F.col("needs_review") | F.col("_needs_review")) & ~done).otherwise(F.col("needs_review"))
    out = joined.select(
        "id", pick("category", F.lit("uncategorised")), pick("decided_by", F.lit("none")), pick("confidence", F.lit(0.0)), review.alias("needs_review"),
        F.col("category").alias("_was"), F.col("needs_review").alias("_review"))
    changed = ~(F.col("category").eqNullSafe(F.col("_was")) & F.col("needs_review").eqNullSafe(F.col("_review")))
    return out.withColumn("changed", changed).drop("_was", "_review")


def applied(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows with their verdicts (id, category, decided_by, confidence, needs_review, kind): a review once asked for stays, and a
    verdict's kind, if it has one, goes before the row's."""
    v = verdicts.select("id", *[F.col(c).alias(f"_{c}") for c in ("category", "decided_by", "confidence", "needs_review", "kind")])
    got = F.col("_category").isNotNull()
    joined = rows.join(v, "id", "left")
    cols = {c: F.when(got, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("category", "decided_by", "confidence")}
    cols |= {"needs_review": F.col("needs_review") | F.coalesce("_needs_review", F.lit(False)), "kind": F.coalesce("_kind", "kind")}
    return joined.withColumns(cols).drop("_category", "_decided_by", "_confidence", "_needs_review", "_kind")


def answered(rows: DataFrame, by_row: DataFrame, by_shop: DataFrame) -> DataFrame:
    """Adds category as answered and undo (what it was) to rows (id, shop, category): an answer for the very row (id, category)
    before one for its shop (shop, category, at), of which the latest holds."""
    latest = by_shop.groupBy("shop").agg(F.max_by("category", F.struct("at", "category")).alias("_shop"))
    own = by_row.groupBy("id").agg(F.max("category").alias("_row"))
    out = rows.join(own, "id", "left").join(latest, "shop", "left").withColumn("_new", F.coalesce("_row", "_shop"))
    undo = F.when(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("category")), F.col("category"))
    return out.withColumns({"undo": undo, "category": F.coalesce("_new", "category")}).drop("_row", "_shop", "_new")


def undone(rows: DataFrame) -> DataFrame:
    """Rows as they were before answered()."""
    return rows.withColumn("category", F.coalesce("undo", "category")).drop("undo")


def spellings(rows: DataFrame, by_shop: DataFrame) -> DataFrame:
    """(shop, payee, rows, to_change): the spellings that an answer for a shop would reach, with how many rows it would move."""
    a = by_shop.groupBy("shop").agg(F.max_by("category", F.struct("at", "category")).alias("_c"))
    return rows.join(a, "shop").groupBy("shop", "payee").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("category") != F.col("_c"), 1)).alias("to_change"))


def rules_print(table: DataFrame) -> DataFrame:
    """(rows, print): a table of rules in one mark, whatever its order; rules are applied anew where it differs. A sum of hashes,
    so no task sees the whole table."""
    h = F.xxhash64(*table.columns).cast("decimal(38,0)")
    return table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("print"))


def forgotten(rows: DataFrame, file: str) -> DataFrame:
    """Rows (id, sources, refund_of, ...) without what only a file vouched for; a refund whose payment went stands for itself."""
    left = rows.withColumn("sources", F.filter("sources", lambda s: s != file)).filter(F.size("sources") > 0)
    there = left.select(F.col("id").alias("refund_of"), F.lit(True).alias("_there"))
    plain, refunds = left.filter("refund_of is null"), left.filter("refund_of is not null").join(there, "refund_of", "left")
    return plain.unionByName(refunds.withColumn("refund_of", F.when(F.col("_there"), F.col("refund_of"))).drop("_there").select(*plain.columns))


def kept_answers(current: DataFrame, slow: DataFrame) -> DataFrame:
    """(id, category, decided_by) of a slow step's rows, but for those that a user has set meanwhile; rows that went are left out."""
    c = current.select("id", F.col("category").alias("_c"), F.col("decided_by").alias("_b"))
    user = F.col("_b") == "user"
    return slow.join(c, "id").select("id", F.when(user, F.col("_c")).otherwise(F.col("category")).alias("category"), F.when(user, F.col("_b")).otherwise(F.col("decided_by")).alias("decided_by"))


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows were added, removed, and changed in any of the columns."""
    a, b = (d.select("id", F.struct(*columns).alias(n)) for d, n in ((before, "_a"), (after, "_b")))
    both = a.join(b, "id", "full")
    return both.agg(F.count(F.when(F.col("_a").isNull(), 1)).alias("added"), F.count(F.when(F.col("_b").isNull(), 1)).alias("removed"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")), 1)).alias("changed"))


def last_told(edits: DataFrame, key: str) -> DataFrame:
    """Of edits (key, at, op, ...) the last of each key, without those whose last is a removal: claims and releases of accounts."""
    columns = [c for c in edits.columns if c != key]
    last = edits.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("at", F.xxhash64(*edits.columns))).alias("_l")).select(key, "_l.*")
    return last.filter("op <> 'remove'").drop("op")


def accounts_of_ignored(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """(last4): accounts of payees whose name was answered as one's own (`ignored`): the digits of their handles."""
    names = answers.filter("category = 'ignored'").select(normal_name("name").alias("_n")).distinct()
    return rows.withColumn("_n", normal_name("payee")).join(names, "_n", "left_semi").select(last_digits(F.coalesce("payee_handle", F.lit(""))).alias("last4")).filter("last4 is not null").distinct()


#: Limits of a stay (fixed values): days, and letters of a name.
MOST_DAYS, MOST_LETTERS = 3660, 60


def checked_stay() -> Column:
    """Why a stay (place, first, last) cannot be kept; null if it can."""
    t = F.trim(F.coalesce("place", F.lit("")))
    return (
        F.when(t == "", "no name").when(F.length(t) > MOST_LETTERS, "name too long").when(F.col("first").isNull() | F.col("last").isNull() | (F.col("first") > F.col("last")), "days the wrong way")
        .when(F.datediff("last", "first") >= MOST_DAYS, "too long")
    )


def stays_after(edits: DataFrame) -> DataFrame:
    """(stay, place, region, first, last, at) after edits (stay, at, op, place, region, first, last): the last add or change of each that can
    be kept, unless the stay was removed after it; a stay changed is told anew."""
    fine = edits.filter((F.col("op") == "remove") | checked_stay().isNull())
    return last_told(fine, "stay").select("stay", place_name("place").alias("place"), state_code("region").alias("region"), "first", "last", "at")


def statements_after(statements: DataFrame, actions: DataFrame) -> DataFrame:
    """(statement, status, rows): held statements (statement, status) after actions (statement, at, action, rows): a correction gives other
    rows and keeps the hold, a confirmation counts it, and nothing changes what is counted already."""
    last = actions.groupBy("statement").agg(F.max_by("rows", F.when(F.col("action") == "correct", F.col("at"))).alias("_rows"), F.bool_or(F.col("action") == "confirm").alias("_ok"))
    joined = statements.join(last, "statement", "left")
    held = F.col("status") == "held"
    return joined.select("statement", F.when(held & F.coalesce("_ok", F.lit(False)), "counted").otherwise(F.col("status")).alias("status"), F.when(held, F.coalesce("_rows", "rows")).otherwise(F.col("rows")).alias("rows"))


def rebuilt(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """(statement, debits, credits, rows) of held rows (statement, line, cents, credit) with corrections (statement, line, cents, credit; null cents
    drop the line, new lines are added)."""
    fix = corrections.select("statement", "line", F.struct("cents", "credit").alias("_f"))
    both = rows.join(fix, ["statement", "line"], "full")
    now = both.select("statement", F.when(F.col("_f").isNotNull(), F.col("_f.cents")).otherwise(F.col("cents")).alias("cents"), F.when(F.col("_f").isNotNull(), F.col("_f.credit")).otherwise(F.col("credit")).alias("credit")).filter("cents is not null")
    part = lambda c: F.sum(F.when(c, F.col("cents")).otherwise(0))
    return now.groupBy("statement").agg(part(~F.col("credit")).alias("debits"), part(F.col("credit")).alias("credits"), F.count(F.lit(1)).alias("rows"))


def pages(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """One page of rows in an order, from 1; only the rows up to its end are kept anywhere."""
    return rows.orderBy(*order).limit(size * number).withColumn("_n", F.row_number().over(Window.orderBy(*order))).filter(F.col("_n") > size * (number - 1)).drop("_n")
