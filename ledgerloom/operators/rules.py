"""Ordered rules: the first that fits decides. A rule table becomes one column expression, so a cascade costs one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_name


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule (pattern, value) whose pattern is found in a text."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


#: Words in a payee's or row's text and the category they stand for (our own seed table).
KEYWORDS = [
    (r"\b(salary|payroll)\b", "income.salary"),
    (r"\b(interest|dividend)\b", "income.interest"),
    (r"\b(rent|landlord)\b", "home.rent"),
    (r"\b(electric|power|water|gas)\b", "home.utilities"),
    (r"\b(fuel|petrol|diesel)\b", "travel.fuel"),
    (r"\b(hotel|resort|inn)\b", "travel.stay"),
    (r"\b(air|flight|rail|bus|taxi|cab)\b", "travel.tickets"),
    (r"\b(cafe|coffee|restaurant|kitchen|pizza)\b", "food.eating_out"),
    (r"\b(grocer|mart|fresh)", "food.groceries"),
    (r"\b(pharma|clinic|hospital|dental)", "health"),
    (r"\b(school|college|course|tuition)\b", "education"),
    (r"\b(cinema|movie|music|game)", "fun"),
    (r"\b(atm|cash withdrawal)\b", "transfers.cash"),
]


def decide(rows: DataFrame, row_answers: DataFrame, payees: DataFrame, own_digits: DataFrame, memory: DataFrame, rules: Sequence[tuple[str, str]] = tuple(KEYWORDS)) -> DataFrame:
    """Adds category, decided_by, confidence and needs_review to movements (id, payee, payee_handle, direction, kind, note).

    In order: an answer for the very row (row_answers: id, category), cashback, a refund, a known payee (payees: name,
    category), an own account (own_digits: digits), what was told of the name before (memory: name, category, by), a
    credit as income, the keyword rules, a person, else nothing (needs review). The tables of names are joined on the
    normalised name, all else is one expression. Names repeat, so each table must have a name once; the first wins.
    """
    one = lambda d, key: d.groupBy(key).agg(F.min("category").alias("category"))
    key = normal_name("payee")
    rows = rows.withColumn("_key", key)
    answers = one(row_answers, "id").withColumnRenamed("category", "_answer")
    known = one(payees.select(normal_name("name").alias("_key"), "category"), "_key").withColumnRenamed("category", "_known")
    told = memory.groupBy(normal_name("name").alias("_key")).agg(F.min_by(F.struct("category", "by"), F.struct(F.col("by") != "user", "category")).alias("_told"))
    own = own_digits.select(F.col("digits").alias("_digits")).distinct().withColumn("_own", F.lit(True))
    joined = rows.join(answers, "id", "left").join(known, "_key", "left").join(told, "_key", "left")
    joined = joined.withColumn("_digits", F.right(F.regexp_replace(F.coalesce("payee_handle", F.lit("")), "[^0-9]", ""), F.lit(4))).join(own, "_digits", "left")

    def verdict(category: Column | str, by: str, confidence: float, review: bool = False) -> Column:
        c = F.lit(category) if isinstance(category, str) else category
        return F.struct(c.alias("category"), F.lit(by).alias("decided_by"), F.lit(confidence).alias("confidence"), F.lit(review).alias("needs_review"))

    text = F.lower(F.concat_ws(" ", "payee", "note"))
    keyword = first_match(text, rules)
    person = F.col("_key").rlike("^[a-z]+ [a-z]+( [a-z]+)?$") & ~text.rlike("[0-9]")
    decided = F.coalesce(
        F.when(F.col("_answer").isNotNull(), verdict(F.col("_answer"), "answer", 1.0)),
        F.when(F.col("kind") == "cashback", verdict("income.cashback", "kind", 1.0)),
        F.when(F.col("kind") == "refund", verdict("income.refund", "kind", 0.9)),
        F.when(F.col("_known").isNotNull(), verdict(F.col("_known"), "payee", 1.0)),
        F.when(F.col("_own"), verdict("transfers.self", "own account", 1.0)),
        F.when(F.col("_told").isNotNull(), verdict(F.col("_told.category"), "memory", 0.95)),
        F.when(F.col("direction") == "credit", verdict("income.received", "credit", 0.8)),
        F.when(keyword.isNotNull(), verdict(keyword, "keyword", 0.85)),
        F.when(person, verdict("transfers.p2p", "person", 0.7, True)),
        verdict("uncategorised", "none", 0.0, True),
    )
    return joined.withColumn("_v", decided).select(*[c for c in rows.columns if c != "_key"], "_v.*")


def remember(answers: DataFrame) -> DataFrame:
    """Of answers (name, category, by, at) one for each normalised name: a user's before a model's, then the latest."""
    named = answers.withColumn("name", normal_name("name")).filter("name <> ''")
    return named.groupBy("name").agg(F.max_by(F.struct("category", "by", "ts"), F.struct(F.col("by") == "user", F.col("ts"), F.col("category"))).alias("_r")).select("name", "_r.*")


def rule_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decided_by").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("needs_review"), 1)).alias("to_review"))
