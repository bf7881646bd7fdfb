"""Links between records: exact keys, nearness, mutual uniqueness, and assignments that use up what they take.

Candidates come from joins on an equal key with the range conditions beside it. Where each choice takes something that
later choices could have had (a payment's remaining amount, a bill), the result is that of choices made one after the
other, but they are made in rounds: each takes all choices that no earlier open one can change, and what they use up
goes. Rounds are joins, so a component of candidates of any size needs no task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, long_words
from .components import cut

#: Windows of the rules (fixed values): minutes, days, and shares in percent.
LOOSE_MINUTES, CARD_DAYS, UPI_DAYS, FILE_DAYS, REFUND_DAYS = 10, 3, 1, 3, 180
BILL_MINUTES, BILL_PERCENT, POSTING_DAYS = 15, 5, 5


def match_keys(rows: DataFrame) -> DataFrame:
    """(id, rank, key): every key by which a record can be known again, the surest first: bank reference, transaction id,
    row of a statement, and a print of minute, amount, direction and payee."""
    ref = lambda name: F.col("refs")[name]
    prints = F.concat_ws(":", F.date_format("ts", "yyyyMMddHHmm"), "cents", "direction", compact("payee"))
    keys = F.array(
        F.when(ref("utr").isNotNull(), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("utr:"), ref("utr")).alias("key"))),
        F.when(ref("txnId").isNotNull(), F.struct(F.lit(2).alias("rank"), F.concat(F.lit("txn:"), ref("txnId")).alias("key"))),
        F.when(ref("cardRow").isNotNull(), F.struct(F.lit(3).alias("rank"), F.concat(F.lit("row:"), ref("cardRow")).alias("key"))),
        F.struct(F.lit(4).alias("rank"), F.concat(F.lit("print:"), prints).alias("key")),
    )
    return rows.select("id", F.inline(F.filter(keys, lambda k: k.isNotNull())))


def exact_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, old_id, rank): each new record with the old one that shares its surest key, of equal direction and cents;
    among several the one with the largest id, as later records replace earlier ones under a key."""
    a = match_keys(old).join(old.select("id", F.col("direction").alias("_d"), F.col("cents").alias("_c")), "id").withColumnRenamed("id", "old_id")
    b = match_keys(new).join(new.select("id", F.col("direction").alias("_d"), F.col("cents").alias("_c")), "id").withColumnRenamed("id", "new_id")
    hits = b.join(a.drop("rank"), ["key", "_d", "_c"])
    best = F.max_by(F.struct("old_id", "rank"), F.struct(-F.col("rank"), F.col("old_id")))
    return hits.groupBy("new_id").agg(best.alias("_b")).select("new_id", "_b.old_id", "_b.rank")


def loose_matches(old: DataFrame, new: DataFrame, minutes: int = LOOSE_MINUTES) -> DataFrame:
    """(new_id, old_id, apart): same direction and cents, within minutes, one compact payee inside the other; the nearest
    in time, then the smallest id. Seconds are cut into spans of the window, so the join is on equal keys alone: a pair
    lies in the same span or in neighbouring ones."""
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (minutes * 60))
    side = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), "direction", "cents", F.col("ts").alias(f"{p}_at"), compact("payee").alias(f"{p}_payee"), span.alias("_span"))
    a = side(old, "old").withColumn("_span", F.explode(F.array(F.col("_span") - 1, F.col("_span"), F.col("_span") + 1)))
    apart = F.abs(F.unix_seconds(F.col("new_at").cast("timestamp")) - F.unix_seconds(F.col("old_at").cast("timestamp")))
    pairs = side(new, "new").join(a, ["direction", "cents", "_span"]).withColumn("apart", apart)
    pairs = pairs.filter((F.col("apart") <= minutes * 60) & (F.col("new_payee").contains(F.col("old_payee")) | F.col("old_payee").contains(F.col("new_payee"))))
    best = F.min_by(F.struct("old_id", "apart"), F.struct("apart", "old_id"))
    return pairs.groupBy("new_id").agg(best.alias("_b")).select("new_id", "_b.old_id", "_b.apart")


def file_overlaps(old: DataFrame, new: DataFrame, days: int = FILE_DAYS) -> DataFrame:
    """(new_id, old_id): the same purchase in two files: equal card, direction and cents, within days, a payee inside the
    other or a long word in common; the nearest day, then the smallest id."""
    side = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), "card", "direction", "cents", F.to_date("ts").alias(f"{p}_day"), F.col("file").alias(f"{p}_file"), compact("payee").alias(f"{p}_key"), long_words("payee").alias(f"{p}_words"))
    # Days are cut into spans of the window: a pair lies in the same span or in neighbouring ones.
    span = lambda p: F.floor(F.unix_date(f"{p}_day") / days)
    near = side(old, "old").withColumn("_span", F.explode(F.array(*[span("old") + k for k in (-1, 0, 1)])))
    pairs = side(new, "new").withColumn("_span", span("new")).join(near, ["card", "direction", "cents", "_span"])
    apart = F.abs(F.datediff("new_day", "old_day"))
    same = F.col("new_key").contains(F.col("old_key")) | F.col("old_key").contains(F.col("new_key")) | F.arrays_overlap("new_words", "old_words")
    pairs = pairs.withColumn("_a", apart).filter((F.col("_a") <= days) & (F.col("new_file") != F.col("old_file")) & same)
    return pairs.groupBy("new_id").agg(F.min_by("old_id", F.struct("_a", "old_id")).alias("old_id"))


def mutually_unique(payments: DataFrame, bills: DataFrame, tolerance: int = 100, days: int = POSTING_DAYS) -> DataFrame:
    """(payment, bill): within `tolerance` cents and 0 to `days` days after the bill, if neither has any other candidate.

    Nothing is paired that cannot be unique. Records of one day and amount are counted as one, as they have the same candidates,
    and two of them spoil each other. Bands half as wide as the tolerance and days make cells; all of a cell are candidates
    of one another's cells within a band and the window, so these counts alone rule out whoever has two there. Who is left
    meets the days and amounts within reach, counted: at most (days + 1) * (2 * tolerance + 1) of them, however many records.
    """
    if tolerance < 2:
        raise ValueError("a tolerance of two cents at least makes cells")
    half = tolerance // 2
    place = ["_day", "_band"]

    def counted(rows: DataFrame) -> DataFrame:
        """One row for each day and amount, with the number of records and the smallest id."""
        each = rows.filter("id IS NOT NULL AND day IS NOT NULL AND cents IS NOT NULL").groupBy("day", "cents").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
        return cut(each.select("id", "n", "cents", F.unix_date("day").alias("_day"), F.floor(F.col("cents") / half).alias("_band")))

    def near(rows: DataFrame, first: int, bands: int) -> DataFrame:
        """Rows once for each cell within `bands`, and from `first` days on."""
        cells = F.array(*[F.struct((F.col("_day") + first + i).alias("_day"), (F.col("_band") + j).alias("_band")) for i in range(days + 1) for j in range(-bands, bands + 1)])
        return rows.withColumn("_at", F.explode(cells)).drop(*place).select("*", "_at.*").drop("_at")

    def only(own: DataFrame, other: DataFrame, first: int) -> DataFrame:
        """(id, other): those of `own` with one candidate among `other`, whose days lie from `first` on from their own."""
        sums = other.groupBy(*place).agg(F.sum("n").alias("_c"))
        full = near(sums, -first - days, 1).groupBy(*place).agg(F.sum("_c").alias("_c")).filter("_c > 1").select(*place)
        left = own.filter("n = 1").join(full, place, "left_anti").select("id", F.col("cents").alias("_own"), *place)
        met = near(left, first, 3).join(other.select(F.col("id").alias("other"), "n", "cents", *place), place).filter(F.abs(F.col("cents") - F.col("_own")) <= tolerance)
        return met.groupBy("id").agg(F.sum("n").alias("_n"), F.min("other").alias("other")).filter("_n = 1").select("id", "other")

    a, b = counted(payments), counted(bills)
    paid, billed = only(a, b, -days), only(b, a, 0)
    return paid.select(F.col("id").alias("payment"), F.col("other").alias("bill")).join(billed.select(F.col("id").alias("bill"), F.col("other").alias("payment")), ["payment", "bill"])


def _refund_sides(payments: DataFrame, refunds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides under names of their own: payments, refunds."""
    has = lambda d: F.coalesce("emi", F.lit(False)) if "emi" in d.columns else F.lit(False)
    p = payments.select(has(payments).alias("_emi"), F.col("id").alias("payment"), F.col("ts").alias("paid_at"), F.col("cents").alias("budget"), F.col("shop").alias("_shop"), F.col("card").alias("_card"), F.col("ref").alias("_ref"))
    return p, refunds.select(F.col("id").alias("refund"), F.col("ts").alias("back_at"), F.col("cents"), "shop", "card", "ref", has(refunds).alias("emi"))


def _refund_span(c: str, days: int) -> Column:
    """Time is cut into spans of the window: a refund lies in its payment's span or in the next."""
    return F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (days * 86400))


def _named_candidates(p: DataFrame, r: DataFrame, days: int) -> DataFrame:
    """(refund, payment, tier, ...) by reference (1) and by shop (2)."""
    r = r.filter("NOT emi")
    in_time = (F.col("paid_at") <= F.col("back_at")) & (F.col("paid_at") >= F.col("back_at") - F.expr(f"interval {days} days")) & (F.col("budget") >= F.col("cents"))
    later = p.withColumn("_span", F.explode(F.array(_refund_span("paid_at", days), _refund_span("paid_at", days) + 1)))
    keep = ["refund", "payment", "back_at", "paid_at", "cents", "budget"]
    by_ref = r.join(p, F.col("ref") == F.col("_ref")).filter("budget >= cents").select(*keep, F.lit(1).alias("tier"))
    by_shop = r.withColumns({"_span": _refund_span("back_at", days), "_shop": F.col("shop")}).join(later, ["_shop", "_span"]).filter(in_time).select(*keep, F.lit(2).alias("tier"))
    return by_ref.unionByName(by_shop)


def assign_refunds(payments: DataFrame, refunds: DataFrame, days: int = REFUND_DAYS) -> DataFrame:
    """(refund, payment, tier): refunds in order of time each take a payment that can still cover them, not later than the refund and at
    most `days` before it: the one of their reference (1; at any time), else of their shop (2; the exact amount first, then the
    latest), else of their card and exact amount (3, the latest). A purchase turned into instalments (`emi`, a column that both
    may have) is credited back whole and without its shop's name: such a credit may only take the latest purchase of exactly
    its amount on its card that is no instalment itself (4).

    A payment is used up as refunds take from it, whichever way they found it, so all ways are decided together. References and
    shops are pairs; payments and refunds of one amount on one card are never paired: they stand in one order of time, in which
    a refund sees the last payment before it that nothing was taken from.
    """
    p, r = _refund_sides(payments, refunds)
    same = ["refund", "payment", "back_at", "paid_at", "cents", F.col("budget").alias("left"), (F.col("cents") != F.col("budget")).alias("inexact")]
    pairs = _named_candidates(p, r, days).groupBy(*same).agg(F.min("tier").alias("tier"))
    # One order for each card and amount: payments before refunds of the same time, of equal payments the smaller number last.
    whole = p.select(F.col("_card").alias("card"), F.col("budget").alias("cents"), F.col("paid_at").alias("at"), F.lit(0).alias("kind"), F.col("payment").alias("id"), F.col("_emi").alias("emi"))
    back = r.select("card", "cents", F.col("back_at").alias("at"), F.lit(1).alias("kind"), F.col("refund").alias("id"), "emi")
    group = ["card", "cents"]
    told = lambda d, other: d.filter("card is not null and cents is not null and at is not null").join(other.select(*group).distinct(), group, "left_semi")
    order = told(whole, back).unionByName(told(back, whole))
    own = Window.partitionBy("refund").orderBy("tier", "inexact", F.desc("paid_at"), "payment")
    # A refund's first payment that can cover it is its own for sure if it can cover all earlier ones besides.
    earlier = Window.partitionBy("payment").orderBy(F.asc_nulls_last("back_at"), "refund").rowsBetween(Window.unboundedPreceding, 0)
    paid, credit = F.col("kind") == 0, F.col("kind") == 1
    paid_id, credit_id = F.when(paid, F.col("id")), F.when(credit, F.col("id"))
    line = Window.partitionBy(*group).orderBy("at", "kind", paid_id.desc(), credit_id.asc())
    above = line.rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(*group).orderBy(F.desc("at"), F.desc("kind"), paid_id.asc(), credit_id.desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, value, over: F.last(F.when(c, value), ignorenulls=True).over(over)
    when = lambda at, id_: F.struct(F.col(at).isNull().alias("_0"), F.col(at).alias("_1"), F.col(id_).alias("_2"))
    it, spot = F.struct(F.col("id").alias("payment"), F.col("at").alias("paid_at"), F.col("emi").alias("emi"), F.col("_k").alias("k")), when("at", "id")
    out = None
    while True:
        pairs = cut(pairs.withColumns({"_n": F.row_number().over(own), "_taken": F.sum("cents").over(earlier)}))
        seen = order.withColumn("_k", F.row_number().over(line))
        seen = seen.withColumns({"_any": last(paid, it, above), "_plain": last(paid & ~F.col("emi"), it, above), "_r": last(credit, F.col("_k"), above), "_rp": last(credit & ~F.col("emi"), F.col("_k"), above)})
        seen = cut(seen.withColumns({"_next": last(credit, spot, below), "_nextp": last(credit & ~F.col("emi"), spot, below)}))
        # By reference or shop: also, no earlier refund may want the payment for its amount.
        wanted = seen.filter(paid).select(F.col("id").alias("payment"), "at", F.when(F.col("emi"), F.col("_nextp")).otherwise(F.col("_next")).alias("_want"))
        wanted = wanted.filter(F.col("_want._1") - F.expr(f"interval {days} days") <= F.col("at")).drop("at")
        named = pairs.filter("_n = 1 and _taken <= left").join(wanted, "payment", "left").filter((F.col("cents") <= 0) | F.col("_want").isNull() | (F.col("_want") >= when("back_at", "refund")))
        # By amount: refunds without another choice, of which the first behind a payment has it for sure, unless an earlier one wants it by name.
        pick = F.when(F.col("emi"), F.col("_plain")).otherwise(F.col("_any"))
        free = seen.filter(credit).select("card", "cents", "at", "emi", "id", "_r", "_rp", pick.alias("_p")).join(pairs.select(F.col("refund").alias("id")).distinct(), "id", "left_anti")
        free = free.filter(F.col("_p").isNotNull() & (F.col("_p.paid_at") >= F.col("at") - F.expr(f"interval {days} days")))
        held = pairs.groupBy("payment").agg(F.min(when("back_at", "refund")).alias("_held"))
        between = F.when(F.col("_p.emi"), F.col("_rp")).otherwise(F.col("_r"))
        open_ = free.withColumn("payment", F.col("_p.payment")).join(held, "payment", "left")
        first = (F.coalesce(between, F.lit(0)) < F.col("_p.k")) & (F.col("_held").isNull() | (F.col("_held") >= spot))
        exact = open_.filter((F.col("cents") <= 0) | first).select(F.col("id").alias("refund"), "payment", F.when(F.col("emi"), 4).otherwise(3).alias("tier"), "cents")
        accepted = cut(named.select("refund", "payment", "tier", "cents").unionByName(exact))
        taken = accepted.select("refund", "payment", "tier")
        out = taken if out is None else out.unionByName(taken)
        if accepted.isEmpty():
            return out
        debits = accepted.groupBy("payment").agg(F.sum("cents").alias("_debit"))
        pairs = pairs.drop("_n", "_taken").join(accepted.select("refund"), "refund", "left_anti").join(debits, "payment", "left")
        pairs = pairs.withColumn("left", F.col("left") - F.coalesce("_debit", F.lit(0))).drop("_debit").filter("left >= cents")
        # What is decided leaves the order, and so do payments behind which no refund is left, and refunds before which no payment is.
        gone = accepted.select(F.lit(1).alias("kind"), F.col("refund").alias("id")).unionByName(debits.filter("_debit > 0").select(F.lit(0).alias("kind"), F.col("payment").alias("id")))
        span = F.expr(f"interval {days} days")
        met = F.when(paid, F.col("_next._1") - span <= F.col("at")).otherwise(F.col("_any.paid_at") >= F.col("at") - span)
        order = seen.filter(met).select(*order.columns).join(gone, ["kind", "id"], "left_anti").select(*order.columns)


def reassigned(payments: DataFrame, refunds: DataFrame, assigned: DataFrame, gone: DataFrame, days: int = REFUND_DAYS) -> DataFrame:
    """(refund, payment, tier) after records (id) have gone, as a file's do that is forgotten: what assign_refunds() gives for the rest.

    Only what chains of references, of shops, or of amounts on a card (both within a span of time) reach from a record that is
    gone is decided anew: all that could have met it is among these. Records are held against such keys, never against each
    other. All other links are taken from `assigned` as they are. `payments` and `refunds` still hold what is gone; ids are
    distinct over both.
    """
    p, r = _refund_sides(payments, refunds)
    text, none = lambda c: F.col(c).cast("string"), F.lit(None).cast("bigint")
    key = lambda kind, name, cents, span: F.struct(F.lit(kind).alias("kind"), name.alias("name"), cents.cast("bigint").alias("cents"), span.cast("bigint").alias("span"))
    at = _refund_span("paid_at", days)
    paid = p.select(F.col("payment").alias("id"), F.lit(False).alias("_back"), F.inline(F.array(key("ref", text("_ref"), none, F.lit(0)), *[k for i in (0, 1) for k in (key("shop", text("_shop"), none, at + i), key("card", text("_card"), F.col("budget"), at + i))])))
    named, back = F.when(~F.col("emi"), F.lit(True)), _refund_span("back_at", days)
    credit = r.select(F.col("refund").alias("id"), F.lit(True).alias("_back"), F.inline(F.array(key("ref", F.when(named, text("ref")), none, F.lit(0)), key("shop", F.when(named, text("shop")), none, back), key("card", text("card"), F.col("cents"), back))))
    keys = paid.unionByName(credit).filter("name is not null and span is not null and (kind <> 'card' or cents is not null)")
    keys = keys.select("id", "_back", F.xxhash64("kind", "name", "cents", "span").alias("key"))
    both = keys.groupBy("key").agg(F.count_distinct("_back").alias("_n")).filter("_n = 2").select("key")
    keys = cut(keys.select("id", "key").join(both, "key", "left_semi"))
    # From what is gone outwards, a step at a time: keys by their records and records by their keys.
    reached = edge = cut(gone.select("id").distinct())
    met = None
    while True:
        near = keys.join(edge, "id", "left_semi").select("key").distinct()
        near = cut(near if met is None else near.join(met, "key", "left_anti"))
        met = near if met is None else met.unionByName(near)
        edge = cut(keys.join(near, "key", "left_semi").select("id").distinct().join(reached, "id", "left_anti"))
        if edge.isEmpty():
            break
        reached = cut(reached.unionByName(edge))
    again = lambda d: cut(d.join(reached, "id", "left_semi").join(gone.select("id"), "id", "left_anti"))
    kept = assigned.join(reached.select(F.col("id").alias("refund")), "refund", "left_anti")
    return kept.select("refund", "payment", "tier").unionByName(assign_refunds(again(payments), again(refunds), days))


def refunds_placed(payments: DataFrame, refunds: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, refund_of, category, decided_by, confidence, needs_review) of refunds (id, category, decided_by, emi if at hand) after
    assign_refunds(): one with a payment is filed with the payment's category; an instalments' credit without its purchase is
    left out, as its instalments carry the cost; any other that was filed with a payment before is a plain refund again.
    What a user said of a refund stays, and of others nothing changes but the payment."""
    owner = payments.select(F.col("id").alias("payment"), F.col("category").alias("_of"))
    found = assigned.select(F.col("refund").alias("id"), "payment").join(owner, "payment")
    rows = refunds.join(found, "id", "left")
    emi = F.coalesce("emi", F.lit(False)) if "emi" in refunds.columns else F.lit(False)
    user, has = F.coalesce(F.col("decided_by") == "user", F.lit(False)), F.col("payment").isNotNull()
    row = lambda category, by, sure: F.struct(category.alias("category"), F.lit(by).alias("decided_by"), F.lit(sure).alias("confidence"), F.lit(False).alias("needs_review"))
    told = F.when(user, None).when(has, row(F.col("_of"), "refund", 1.0)).when(emi, row(F.lit("ignored"), "rule", 0.9)).when(F.col("decided_by") == "refund", row(F.lit("income.refund"), "heuristic", 0.9))
    keep = lambda c: F.when(told.isNotNull(), told[c]).otherwise(F.col(c)).alias(c)
    return rows.select("id", F.col("payment").alias("refund_of"), keep("category"), keep("decided_by"), keep("confidence"), keep("needs_review"))


def one_to_one(pairs: DataFrame, left: str, right: str, order: Iterable[str]) -> DataFrame:
    """Pairs taken in order of `order`, then of the two numbers; each left and each right is used once."""
    columns = [*order, left, right]
    pairs, out = cut(pairs.select(F.struct(*dict.fromkeys(columns)).alias("_o"), left, right)), None
    while True:
        # The first pair of both its sides is taken whatever becomes of the others.
        first = lambda side: pairs.groupBy(side).agg(F.min("_o").alias("_o"))  # noqa: B023, E731
        taken = cut(first(left).join(first(right), "_o").select(left, right))
        out = taken if out is None else out.unionByName(taken)
        if taken.isEmpty():
            return out
        pairs = cut(pairs.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti"))


def link_bills(payments: DataFrame, bills: DataFrame, minutes: int = BILL_MINUTES, percent: int = BILL_PERCENT) -> DataFrame:
    """(payment, bill): one to one, within minutes and within percent of the bill; exact amounts first, then the nearest in
    time."""
    span = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (minutes * 60))
    # Amounts within percent of one another lie in the same band of their logarithm, or in neighbouring ones.
    band = F.floor(F.log(F.greatest(F.col("cents"), F.lit(1)).cast("double")) / F.lit(math.log(1 + percent / 100) * 1.1))
    a = payments.select(F.col("id").alias("payment"), F.col("cents").alias("_pc"), F.col("ts").alias("_pa"), span.alias("_span"), band.alias("_band"))
    near = F.explode(F.array(*[F.struct((span + i).alias("_span"), (band + j).alias("_band")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = bills.select(F.col("id").alias("bill"), F.col("cents").alias("_bc"), F.col("ts").alias("_ba"), near.alias("_at")).select("bill", "_bc", "_ba", "_at.*")
    apart = F.abs(F.unix_seconds(F.col("_pa").cast("timestamp")) - F.unix_seconds(F.col("_ba").cast("timestamp")))
    pairs = a.join(b, ["_span", "_band"]).withColumns({"apart": apart, "inexact": (F.col("_pc") != F.col("_bc")).cast("int")})
    pairs = pairs.filter((F.col("apart") <= minutes * 60) & (F.abs(F.col("_pc") - F.col("_bc")) * 100 <= F.col("_bc") * percent))
    return one_to_one(pairs.select("payment", "bill", "inexact", "apart"), "payment", "bill", ["inexact", "apart"])


def merged(rows: DataFrame) -> DataFrame:
    """Records that share bank reference, direction and cents become one: the earliest id, all sources once, references of
    the first record that has each, the first card and category on file."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    same = rows.withColumn("_utr", F.coalesce(F.col("refs")["utr"], F.concat(F.lit("id:"), F.col("id").cast("string"))))
    return same.groupBy("_utr", "direction", "cents").agg(
        F.min("id").alias("id"), F.min("ts").alias("ts"), first("payee").alias("payee"), first("card").alias("card"), first("category").alias("category"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count(F.lit(1)).alias("records"),
    ).drop("_utr")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, of each key the one with the largest `order`."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("_r")).select("_r.*")


def retracted(rows: DataFrame, file: str) -> DataFrame:
    """Without what only `file` vouches for: it goes from all sources, and rows left with none go."""
    left = rows.withColumn("sources", F.filter("sources", lambda s: s != file))
    return left.filter(F.size("sources") > 0)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables have the same rows as often, and how many rows only one of them has."""
    left, right = a.exceptAll(b).select(F.lit(1).alias("_a"), F.lit(0).alias("_b")), b.exceptAll(a).select(F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    n = left.unionByName(right).agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("only_left"), F.coalesce(F.sum("_b"), F.lit(0)).alias("only_right"))
    return n.select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def unique_ids(rows: DataFrame) -> DataFrame:
    """Repeated ids get a suffix: the first keeps its own, the others its hash with their number."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("ts", "cents", "payee"))
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col("id").cast("string")).otherwise(F.sha1(F.concat_ws("|", F.col("id").cast("string"), "_n")))).drop("_n")
