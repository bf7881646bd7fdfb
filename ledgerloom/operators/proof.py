"""Statement proof: of several readings of a statement, and several conventions of signs, exactly one must add up: to the
statement's balances or totals, over the cycles that it sums up, or row by row along a running balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut

#: How the sign of a row can be meant, where no mark or column says it (fixed values): not at all; a minus is a credit; a plus is.
CONVENTIONS = ["marked", "minus", "plus"]
#: For rows with details: a wording of money back is a credit.
BY_WORDS = "words"
#: Wordings of payments of a bill and of money back.
CREDIT_WORDS = r"(?i)\b(?:payment (?:received|thank)|autopay|bill ?pay|cash ?back|reward|payment|refund|reversal|reversed|rev)\b"
#: The reading of rows under a header is taken before those by shape, where several prove the same.
TABLE = "table"


def _said(rows: DataFrame) -> Column:
    """Whether a row's details are a wording of money back; false for rows without details."""
    return F.coalesce(F.col("details").rlike(CREDIT_WORDS), F.lit(False)) if "details" in rows.columns else F.lit(False)


def signed_rows(rows: DataFrame) -> DataFrame:
    """Rows (statement, reading, day, cents, mark, sign; details if at hand) once for each convention, with credit true or false. A mark
    of its own (cr, dr), printed or of its column, goes before any sign."""
    known = [*CONVENTIONS, BY_WORDS] if "details" in rows.columns else CONVENTIONS
    each = rows.withColumn("convention", F.explode(F.array(*[F.lit(c) for c in known])))
    mark, sign, how = F.lower(F.coalesce("mark", F.lit(""))), F.coalesce("sign", F.lit("")), F.col("convention")
    credit = F.when(mark == "cr", True).when(mark == "dr", False).when(how == "minus", sign == "-").when(how == "plus", sign == "+").when(how == BY_WORDS, _said(rows)).otherwise(False)
    return each.withColumn("credit", credit)


def _order(*more: str) -> Column:
    """Of several readings that prove the same: the header's, the plain convention, then by name."""
    return F.struct((F.col("reading") != TABLE).alias("_1"), F.array_position(F.array(*[F.lit(c) for c in [*CONVENTIONS, BY_WORDS]]), F.col("convention")).alias("_2"), *more, "reading")


def prove(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement, status, reading, convention, debits, credits): readings x conventions held against the statement's own
    figures (previous, due, printed_debits, printed_credits, all cents, null where not printed).

    A reading proves itself by balances (previous - credits + debits = due) or, where they are not printed, by both printed
    totals; to the cent, or within half a unit where a due in whole units was rounded. `proven` needs all readings that do
    so to be the same set of rows; `ambiguous` if they differ, `unproven` if none does, `nothing to check by` if the
    statement prints no figures. Aggregates alone decide: no statement is ever brought to one place.
    """
    print_ = F.xxhash64("day", "cents", "credit")
    tried = signed_rows(rows).groupBy("statement", "reading", "convention").agg(
        F.sum(F.when(~F.col("credit"), F.col("cents")).otherwise(0)).alias("debits"), F.sum(F.when(F.col("credit"), F.col("cents")).otherwise(0)).alias("credits"),
        F.count(F.lit(1)).alias("rows"), F.sum(print_.cast("decimal(38,0)")).alias("_print"),
    )
    held = statements.join(tried, "statement", "left")
    slack = F.when(F.col("due") % 100 == 0, 50).otherwise(0)
    off = F.abs(F.col("previous") - F.col("credits") + F.col("debits") - F.col("due"))
    by_totals = (F.col("printed_debits") == F.col("debits")) & (F.col("printed_credits") == F.col("credits"))
    balances = F.col("previous").isNotNull() & F.col("due").isNotNull()
    checkable = balances | (F.col("printed_debits").isNotNull() & F.col("printed_credits").isNotNull())
    # To the cent goes before within half a unit: the looser fits count only where none is exact.
    exact = F.coalesce(F.when(balances, off == 0).otherwise(by_totals), F.lit(False))
    held = held.withColumns({"_check": checkable, "_exact": exact, "_near": F.coalesce(balances & (off <= slack), F.lit(False))})
    held = held.withColumn("_ok", F.when(F.max("_exact").over(Window.partitionBy("statement")), F.col("_exact")).otherwise(F.col("_exact") | F.col("_near")))
    best = F.min_by(F.struct("reading", "convention", "debits", "credits"), F.when(F.col("_ok"), _order()))
    found = held.groupBy("statement").agg(
        F.bool_or("_check").alias("_check"), F.count_distinct(F.when(F.col("_ok"), F.struct("rows", "_print"))).alias("_sets"), best.alias("_b"))
    status = F.when(~F.col("_check"), "nothing to check by").when(F.col("_sets") == 0, "unproven").when(F.col("_sets") == 1, "proven").otherwise("ambiguous")
    one = F.when(status == "proven", F.col("_b"))
    return found.select("statement", status.alias("status"), *[one[c].alias(c) for c in ("reading", "convention", "debits", "credits")])


def running_balances(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """(statement, reading, line, credit): rows (statement, reading, line, cents, balance, mark, sign; details if at hand) of readings in
    which every balance moves by exactly its row's amount, with the directions that follow.

    Lines may be printed oldest or newest first, and the balance may be what is owed (debits raise it) or what is left (they
    lower it): both orders and both meanings are tried for all rows of a reading at once. Of the meanings the one that
    agrees with more of the rows' own marks, signs and words is taken, what is owed on a tie; oldest first goes before
    newest first. An opening balance (`previous`) must fit the first row; without one that row's own mark, sign or words
    decide, and where it has none nothing is proven. A reading of fewer than two rows, or with a balance missing, proves
    nothing. Rows of one reading of one statement are ordered in one task, no others.
    """
    said = _said(rows)
    mark, sign = F.lower(F.coalesce("mark", F.lit(""))), F.coalesce("sign", F.lit(""))
    own = F.when(mark == "cr", True).when(mark == "dr", False).when(sign != "", True).when(said, True).otherwise(False)
    speaks = mark.isin("cr", "dr") | (sign != "") | said
    option = Window.partitionBy("statement", "reading")
    line = option.orderBy("line")
    laid = rows.select("statement", "reading", "line", "cents", "balance", own.alias("_own"), speaks.alias("_speaks"), F.lag("balance").over(line).alias("_above"), F.lead("balance").over(line).alias("_below"), F.row_number().over(line).alias("_k"), F.count(F.lit(1)).over(option).alias("_n"), F.count("balance").over(option).alias("_m"))
    laid = laid.filter("_n >= 2 and _n = _m").join(statements.select("statement", "previous"), "statement", "left")
    laid = laid.withColumn("newest", F.explode(F.array(F.lit(False), F.lit(True))))
    first = F.when(F.col("newest"), F.col("_k") == F.col("_n")).otherwise(F.col("_k") == 1)
    move = F.col("balance") - F.when(first, F.col("previous")).when(F.col("newest"), F.col("_below")).otherwise(F.col("_above"))
    laid = laid.withColumns({"_first": first, "_move": move}).withColumn("owed", F.explode(F.array(F.lit(True), F.lit(False))))
    credit = F.coalesce((F.col("_move") > 0) != F.col("owed"), F.col("_own"))
    holds = F.when(F.col("_move").isNull(), F.col("_speaks")).otherwise(F.abs("_move") == F.col("cents"))
    laid = laid.withColumns({"credit": credit, "_holds": holds})
    tried = laid.groupBy("statement", "reading", "newest", "owed").agg(F.bool_and("_holds").alias("_ok"), F.sum((F.col("_speaks") & (F.col("_own") == F.col("credit"))).cast("int")).alias("_agree")).filter("_ok")
    best = tried.groupBy("statement", "reading").agg(F.min(F.struct("newest", (-F.col("_agree")).alias("_a"), (~F.col("owed")).alias("_left"))).alias("_b"))
    chosen = best.select("statement", "reading", F.col("_b.newest").alias("newest"), (~F.col("_b._left")).alias("owed"))
    return laid.join(chosen, ["statement", "reading", "newest", "owed"]).select("statement", "reading", "line", "credit")


def decide(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """As prove(), with a third proof for statements that no figure proves or that print none: a running balance. Adds `proof`:
    figures or running balance. Of several readings whose balances run the header's is taken, then the first by name."""
    # Written once, as it is read for what is open and for the answer; statements that figures decide are left out before any ordering.
    told = cut(prove(rows, statements))
    open_ = told.filter(F.col("status").isin("unproven", "nothing to check by")).select("statement")
    left = rows.join(open_, "statement", "left_semi")
    run = running_balances(left, statements).join(left.select("statement", "reading", "line", "cents"), ["statement", "reading", "line"])
    part = lambda c: F.sum(F.when(c, F.col("cents")).otherwise(0))
    run = run.groupBy("statement", "reading").agg(part(~F.col("credit")).alias("debits"), part(F.col("credit")).alias("credits"))
    run = run.groupBy("statement").agg(F.min(F.struct((F.col("reading") != TABLE).alias("t"), "reading", "debits", "credits")).alias("_b"))
    both = told.join(run, "statement", "left")
    runs, by = F.col("_b").isNotNull(), F.col("status") == "proven"
    pick = lambda c: F.when(runs, F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("statement", F.when(runs, "proven").otherwise(F.col("status")).alias("status"), F.when(runs, "running balance").when(by, "figures").alias("proof"), pick("reading"), F.when(~runs, F.col("convention")).alias("convention"), pick("debits"), pick("credits"))


def over_cycles(rows: DataFrame, spans: DataFrame, give: int = 3) -> DataFrame:
    """(statement, status, reading, convention, first, last, inside, beyond) for rows (statement, reading, day, cents, mark, sign) of files
    that sum up several statements: spans (statement, first, last, debits, credits) say which days the totals cover.

    The rows within a window must come to both totals; a window may begin and end up to `give` days from the span. All windows
    and readings that fit must take the same rows and leave the same ones: then the statement is `proven`, by the header's
    reading, the plain convention and the nearest window; else it is `ambiguous`. `inside` and `beyond` count the rows. What
    fits nowhere has no row here.

    Rows of an option (statement, reading, convention) are summed by how their day lies to both ends of the span, all that is
    further off than `give` days being one; sums before each start and up to each end follow inside the option's one row.
    """
    option, span = ["statement", "reading", "convention"], ["first", "last", "debits", "credits"]
    kinds = {"_d": "bigint", "_c": "bigint", "_n": "bigint", "_p": "decimal(38,0)"}
    print_ = F.xxhash64("day", "cents", "credit").cast("decimal(38,0)")
    # Rows may come from a small file and be many; neither side is sent to all machines.
    each = signed_rows(rows).select(*option, "day", "cents", "credit", print_.alias("_print")).join(spans.select("statement", *span).hint("merge"), "statement")
    near = lambda end, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.datediff("day", end)))
    # A row without a day lies before all days, and so does an end without one.
    of_start = F.when(F.col("first").isNull(), give).when(F.col("day").isNull(), -give - 1).otherwise(near("first", -give - 1, give))
    of_end = F.when(F.col("day").isNull(), -give).when(F.col("last").isNull(), give + 1).otherwise(near("last", -give, give + 1))
    slots = each.groupBy(*option, *span, of_start.alias("_s"), of_end.alias("_e")).agg(
        F.sum(F.when(F.col("credit"), 0).otherwise(F.col("cents"))).cast("bigint").alias("_d"), F.sum(F.when(F.col("credit"), F.col("cents")).otherwise(0)).cast("bigint").alias("_c"), F.count(F.lit(1)).alias("_n"), F.sum("_print").alias("_p"))
    laid = slots.groupBy(*option, *span).agg(F.collect_list(F.struct("_s", "_e", *kinds)).alias("_slots"), F.sum("_n").alias("_nt"), F.sum("_p").alias("_pt"))
    shifts = F.array(*[F.lit(k) for k in range(-give, give + 1)])

    def sums(end: str, inside) -> Column:
        """The end under each shift, with the sums of what lies before it (a start) or up to it (an end)."""
        total = lambda k, c: F.aggregate(F.filter("_slots", lambda x: inside(x, k)), F.lit(0).cast(kinds[c]), lambda t, x: (t + x[c]).cast(kinds[c])).alias(c)
        return F.transform(shifts, lambda k: F.struct(k.alias("shift"), F.date_add(F.col(end), k).alias("day"), *[total(k, c) for c in kinds]))

    ends = laid.select(*option, "debits", "credits", "_nt", "_pt", F.inline(F.array(F.struct(sums("first", lambda x, k: x["_s"] < k).alias("_from"), sums("last", lambda x, k: x["_e"] <= k).alias("_to")))))
    # (2 give + 1)^2 windows of an option, beside each other in its row; most fit nothing and are gone at once.
    within = lambda a, b, c: F.when(b["day"] < a["day"], F.lit(0).cast(kinds[c])).otherwise(b[c] - a[c])
    window = lambda a, b: F.struct(a["day"].alias("first"), b["day"].alias("last"), (F.abs(a["shift"]) + F.abs(b["shift"])).alias("apart"), *[within(a, b, c).alias(c) for c in kinds])
    pairs = F.flatten(F.transform("_from", lambda a: F.transform(F.filter("_to", lambda b: (within(a, b, "_d") == F.col("debits")) & (within(a, b, "_c") == F.col("credits"))), lambda b: window(a, b))))
    # Generated as one value first: exploded as it stands it would be worked out for the filter of empty arrays too.
    fits = ends.select(*option, "_nt", "_pt", F.inline(F.array(F.struct(pairs.alias("_w"))))).select(*option, F.inline("_w"), "_nt", "_pt")
    sets = F.count_distinct(F.struct("_n", "_p", F.col("_nt") - F.col("_n"), F.col("_pt") - F.col("_p")))
    chosen = F.struct("reading", "convention", "first", "last", F.col("_n").alias("inside"), (F.col("_nt") - F.col("_n")).alias("beyond"))
    out = fits.groupBy("statement").agg(sets.alias("_sets"), F.min_by(chosen, _order("apart", "first", "last")).alias("_b"))
    sure = F.col("_sets") == 1
    return out.select("statement", F.when(sure, "proven").otherwise("ambiguous").alias("status"), *[F.when(sure, F.col(f"_b.{c}")).alias(c) for c in ("reading", "convention", "first", "last", "inside", "beyond")])


def control_totals(rows: DataFrame) -> DataFrame:
    """Debits, credits and rows of each statement."""
    part = lambda c: F.sum(F.when(c, F.col("cents")).otherwise(0))
    return rows.groupBy("statement").agg(part(~F.col("credit")).alias("debits"), part(F.col("credit")).alias("credits"), F.count(F.lit(1)).alias("rows"))


def outliers(rows: DataFrame, days: int = 400) -> DataFrame:
    """Adds outlier: a row further than `days` from the median day of its statement."""
    middle = F.percentile_approx(F.unix_date("day"), 0.5, 10_000).over(Window.partitionBy("statement"))
    return rows.withColumn("outlier", F.abs(F.unix_date("day") - middle) > days)
