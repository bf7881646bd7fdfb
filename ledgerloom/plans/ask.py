"""Analytic questions about counted rows: one record says what is asked, one plan answers it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import Period, month_key, months_in
from ..functions.money import money
from ..functions.text import payee_matches
from ..operators.counted import is_under
from . import views

KINDS = ("total", "count", "average", "top", "largest", "compare", "trend", "list", "last", "why")


@dataclass(frozen=True)
class Query:
    kind: str = "total"
    period: Period | None = None
    other: Period | None = None
    channel: str = "all"
    money: str = "out"
    categories: tuple[str, ...] = field(default=())
    payees: tuple[str, ...] = field(default=())
    cards: tuple[str, ...] = field(default=())
    by: str = "payee"
    per: str = "payment"
    limit: int = 5

    def normal(self) -> Query:
        """Repeats dropped, money in for income, the limit between 1 and 50."""
        in_ = any(c.split(".")[0] == "income" for c in self.categories)
        once = lambda xs: tuple(dict.fromkeys(xs))
        return replace(self, categories=once(self.categories), payees=once(self.payees), cards=once(self.cards), money="in" if in_ else self.money, limit=min(50, max(1, self.limit)))

    def buckets(self) -> list[str]:
        """People are counted only when a payee or transfers are named."""
        if self.money == "in":
            return ["in", "cashback"]
        named = bool(self.payees) or any(c.split(".")[0] == "transfers" for c in self.categories)
        return ["spent", "people"] if named else ["spent"]


def selected(rows: DataFrame, q: Query, period: Period | None = None) -> DataFrame:
    """The rows that a question is about. All conditions are on columns, so they reach the scan where they can."""
    period = period or q.period
    rows = rows.filter(F.col("bucket").isin(q.buckets()))
    if period:
        rows = rows.filter(period.has("eff_day"))
    if q.channel != "all":
        rows = rows.filter(F.col("owner_channel") == q.channel)
    if q.cards:
        rows = rows.filter(F.col("owner_card").isin(list(q.cards)))

    def any_of(found: list[Column]) -> Column:
        out = found[0]
        for c in found[1:]:
            out = out | c
        return out

    if q.categories:
        rows = rows.filter(any_of([is_under(c) for c in q.categories]))
    if q.payees:
        rows = rows.filter(any_of([payee_matches("owner_payee", p) for p in q.payees]))
    return rows


def answer(spark: SparkSession, rows: DataFrame, q: Query) -> DataFrame:
    """The answer to one question, lazily."""
    q = q.normal()
    found = selected(rows, q)
    figures = [money(F.coalesce(F.sum("signed"), F.lit(0))).alias("amount"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments")]
    if q.kind in ("total", "count"):
        return found.agg(*figures)
    if q.kind == "average":
        if q.per == "payment":
            return found.agg(F.try_divide(money(F.sum("signed")), F.sum("n").cast("double")).alias("average"), F.coalesce(F.sum("n"), F.lit(0)).alias("payments"))
        months = (F.max(F.year("eff_day") * 12 + F.month("eff_day")) - F.min(F.year("eff_day") * 12 + F.month("eff_day")) + 1).cast("bigint")
        return found.agg((money(F.sum("signed")) / months).alias("average"), months.alias("months"))
    if q.kind == "top":
        key = {"payee": "owner_shop", "name": "owner_payee", "category": "top", "child": "category"}[q.by]
        groups = found.groupBy(F.col(key).alias("name")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("payments")).filter("_s > 50")
        return groups.orderBy(F.desc("_s"), "name").limit(q.limit).select("name", money("_s").alias("amount"), "payments")
    if q.kind == "largest":
        return found.filter("n = 1").orderBy(F.desc("cents"), "ts", "id").limit(q.limit).select("id", "owner_payee", "eff_day", money("cents").alias("amount"))
    if q.kind == "compare":
        now, then = q.period, q.other or q.period.before()
        part = lambda p: F.coalesce(F.sum(F.when(p.has("eff_day"), F.col("signed"))), F.lit(0))
        either = selected(rows, q, Period(min(now.first, then.first), max(now.last, then.last)))
        both = either.agg(part(now).alias("_a"), part(then).alias("_b"))
        return both.select(money("_a").alias("now"), money("_b").alias("before"), money(F.col("_a") - F.col("_b")).alias("difference"))
    if q.kind == "why":
        key = "owner_payee" if q.payees or len(q.categories) == 1 else "top"
        return views.contribution(selected(rows, replace(q, period=None)), key, q.period, q.other or q.period.before())
    if q.kind == "trend":
        by = found.groupBy(month_key("eff_day").alias("month")).agg(F.sum("signed").alias("_s"), F.sum("n").alias("_n"))
        covered = rows.agg(F.min(month_key("day")).alias("_lo"), F.max(month_key("day")).alias("_hi"))
        months = months_in(spark, q.period).join(F.broadcast(covered), F.expr("month between _lo and _hi"))  # one row
        return months.join(by, "month", "left").select("month", money(F.coalesce("_s", F.lit(0))).alias("amount"), F.coalesce("_n", F.lit(0)).alias("payments"))
    if q.kind == "list":
        return found.orderBy(F.desc("eff_day"), F.desc("cents"), "id").limit(q.limit).select("id", "owner_payee", "eff_day", money("signed").alias("amount"))
    if q.kind == "last":
        return found.filter("n = 1").orderBy(F.desc("ts"), F.desc("id")).limit(1).select("id", "owner_payee", "eff_day", money("signed").alias("amount"))
    raise ValueError(f"unknown kind: {q.kind}")
