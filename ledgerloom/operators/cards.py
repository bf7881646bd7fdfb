"""Cards: a register of those seen, the card of each record, and bills held against statements and one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import cycle_end, cycle_start
from ..functions.text import most_mentioned, words_only
from .components import cut
from .matching import BILL_PERCENT, POSTING_DAYS

#: Days that a statement may lie off the usual day of its card (fixed value).
SAME_CYCLE = 3


def card_id() -> Column:
    """Issuer and last four digits as one name."""
    return F.concat(F.lit("card-"), F.regexp_replace(words_only(F.coalesce("issuer", F.lit("card"))), " ", "-"), F.lit("-"), F.col("last4"))


def registered(seen: DataFrame) -> DataFrame:
    """One row for each card of `seen` (issuer, product, last4, network, file, at): attributes from the first that tells them,
    the files that it was seen in."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "file"))).alias(c)
    return seen.withColumn("card", card_id()).groupBy("card", "last4").agg(first("issuer"), first("product"), first("network"), F.min("at").alias("first_seen"), F.array_sort(F.collect_set("file")).alias("files"))


def cards_in(texts: DataFrame, issuers: dict[str, str], networks: dict[str, str]) -> DataFrame:
    """(file, issuer, last4, network) of the cards that lines of a bill history (file, text) name, each once; a line without a
    known issuer names none."""
    found = texts.select("file", most_mentioned("text", issuers).alias("issuer"), F.regexp_extract("text", r"(?:XX|ending|[*•]{2,})\s*([0-9]{4})", 1).alias("last4"), most_mentioned("text", networks).alias("network"))
    return found.filter("issuer is not null and last4 <> ''").groupBy("file", "issuer", "last4").agg(F.min("network").alias("network"))


def card_of(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Adds found_card to records (paid_from, channel): the card that a mask XXXX and two digits means, if it can be only one.

    By UPI that is a card of the network that UPI takes, or, if none ends so, one of no known network; else any that ends so.
    """
    ends = cards.select(F.right("last4", F.lit(2)).alias("_ends"), F.lower("network").alias("_n"), "card")
    pick = lambda cond: F.collect_set(F.when(cond, F.col("card")))
    by_end = ends.groupBy("_ends").agg(pick(F.lit(True)).alias("_any"), pick(F.col("_n") == "rupay").alias("_taken"), pick(F.col("_n").isNull()).alias("_unknown"))
    rows = rows.withColumn("_ends", F.regexp_extract(F.coalesce("paid_from", F.lit("")), "^X{4}([0-9]{2})$", 1)).join(by_end, "_ends", "left")
    among = F.when(F.col("channel") != "upi", F.col("_any")).when(F.size("_taken") > 0, F.col("_taken")).otherwise(F.col("_unknown"))
    return rows.withColumn("found_card", F.when(F.size(among) == 1, F.get(among, F.lit(0)))).drop("_ends", "_any", "_taken", "_unknown")


def in_turn(pairs: DataFrame, left: str, right: str, turn: list, wish: list) -> DataFrame:
    """(left, right): the left ones choose in order of `turn`, each the first by `wish` of what is not chosen yet.

    In rounds: a choice stands when it is the left one's first wish and no earlier open one could choose it too.
    """
    pairs, out = cut(pairs), None
    while True:
        own, other = Window.partitionBy(left).orderBy(*wish, right), Window.partitionBy(right).orderBy(*turn, left)
        taken = cut(pairs.withColumns({"_w": F.row_number().over(own), "_t": F.row_number().over(other)}).filter("_w = 1 and _t = 1").select(left, right))
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out
        pairs = cut(pairs.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"))


def in_turn_by_runs(pairs: DataFrame, left: str, right: str, turn: list, wish: list) -> DataFrame:
    """(left, right, from_left, from_right, n): as in_turn(), for runs of alike rows that stand next to each other in the order of turns
    and in that of wishes. `pairs` have how many rows each is (n_left, n_right); n of them from the given places on, counted
    from 0, are one another's. Rounds depend on how runs meet, not on how many rows a run is.
    """
    pairs, out = cut(pairs.withColumns({"_fl": F.lit(0).cast("bigint"), "_fr": F.lit(0).cast("bigint")})), None
    while True:
        own, other = Window.partitionBy(left).orderBy(*wish, right), Window.partitionBy(right).orderBy(*turn, left)
        first = pairs.withColumns({"_w": F.row_number().over(own), "_t": F.row_number().over(other)}).filter("_w = 1 and _t = 1")
        n = F.least(F.col("n_left") - F.col("_fl"), F.col("n_right") - F.col("_fr"))
        taken = cut(first.select(left, right, F.col("_fl").alias("from_left"), F.col("_fr").alias("from_right"), n.alias("n")))
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out
        # In a round each run gives or takes once at most.
        used = lambda side, name: taken.select(side, F.col("n").alias(name))
        left_over = pairs.join(used(left, "_nl"), left, "left").join(used(right, "_nr"), right, "left")
        left_over = left_over.withColumns({"_fl": F.col("_fl") + F.coalesce("_nl", F.lit(0)), "_fr": F.col("_fr") + F.coalesce("_nr", F.lit(0))}).drop("_nl", "_nr")
        pairs = cut(left_over.filter("_fl < n_left and _fr < n_right"))


def settled(rows: DataFrame, bills: DataFrame, percent: int = BILL_PERCENT, days: int = POSTING_DAYS) -> DataFrame:
    """(row, bill): rows of statements that pay a card (id, ts, day, card, cents), in order of time, with the app's bill (id, day,
    card, cents) that each is: of the card, within percent and days, the exact amount first, then the nearest day; a row
    without one is a bill of its own and has a null."""
    span = F.floor(F.unix_date("day") / (days + 1))
    a = rows.select(F.col("id").alias("row"), "ts", "card", F.col("cents").alias("_rc"), F.col("day").alias("_rd"), span.alias("_span"))
    b = bills.select(F.col("id").alias("bill"), "card", F.col("cents").alias("_bc"), F.col("day").alias("_bd"), F.explode(F.array(span - 1, span, span + 1)).alias("_span"))
    pairs = a.join(b, ["card", "_span"]).withColumn("_apart", F.abs(F.datediff("_rd", "_bd")))
    pairs = pairs.filter((F.col("_apart") <= days) & (F.abs(F.col("_rc") - F.col("_bc")) * 100 <= F.col("_bc") * percent)).withColumn("_inexact", F.col("_rc") != F.col("_bc"))
    taken = in_turn(pairs.select("row", "bill", "ts", "_inexact", "_apart"), "row", "bill", ["ts"], ["_inexact", "_apart"])
    return rows.select(F.col("id").alias("row")).join(taken, "row", "left")


def all_bills(apps: DataFrame, rows: DataFrame) -> DataFrame:
    """(bill, card, day, cents, origin): the bills that apps tell and those that only statements list."""
    alone = rows.join(settled(rows, apps).filter("bill is null").select(F.col("row").alias("id")), "id")
    return apps.select(F.col("id").cast("string").alias("bill"), "card", "day", "cents", F.lit("app").alias("origin")).unionByName(
        alone.select(F.concat(F.lit("row-"), F.col("id").cast("string")).alias("bill"), "card", "day", "cents", F.lit("statement").alias("origin")))


def placed_by_statements(bills: DataFrame, statements: DataFrame, slack: int = SAME_CYCLE) -> DataFrame:
    """(bill, statement, cycle_first, cycle_last) of bills (bill, card, paid) of cards with statements (statement, card, last).

    The card's day is that of the statement end nearest to the payment (the earlier on a tie); the bill pays the last cycle
    that ended on that day before it was paid, and a statement that ended within `slack` days of that, before the payment.
    """
    ends = statements.select("card", F.col("last").alias("_at"), F.col("last").alias("_end"), F.lit(None).cast("string").alias("bill"), F.lit(0).alias("_side"))
    line = ends.unionByName(bills.select("card", F.col("paid").alias("_at"), F.lit(None).cast("date").alias("_end"), F.col("bill").cast("string"), F.lit(1).alias("_side")))
    by = Window.partitionBy("card").orderBy("_at", "_side")
    line = line.withColumns({"_before": F.last("_end", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_end", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))})
    near = F.when(F.coalesce(F.datediff("_at", "_before") <= F.datediff("_after", "_at"), F.col("_before").isNotNull()), F.col("_before")).otherwise(F.col("_after"))
    own = line.filter("_side = 1").withColumn("_near", near).filter("_near is not null").withColumn("_day", F.day("_near"))
    own = own.withColumn("_cycle", cycle_end(F.date_sub("_at", 1), "_day")).select("bill", "card", "_at", "_day", "_cycle")
    span = lambda c: F.floor(F.unix_date(c) / (slack + 1))
    theirs = statements.select("card", "statement", F.col("last").alias("_end"), F.explode(F.array(*[span("last") + k for k in (-1, 0, 1)])).alias("_span"))
    hits = own.withColumn("_span", span("_cycle")).join(theirs, ["card", "_span"]).filter((F.abs(F.datediff("_end", "_cycle")) <= slack) & (F.col("_end") < F.col("_at")))
    best = hits.groupBy("bill").agg(F.min(F.struct(F.abs(F.datediff("_end", "_cycle")).alias("a"), "_end", "statement")).alias("_b")).select("bill", "_b.statement", F.col("_b._end").alias("_end"))
    last = F.coalesce("_end", "_cycle")
    return own.join(best, "bill", "left").select("bill", "statement", cycle_start(last, F.coalesce(F.day("_end"), F.col("_day"))).alias("cycle_first"), last.alias("cycle_last"))
