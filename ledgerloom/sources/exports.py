"""Export folders of a payment service: an activity list, and sends, purchases, rewards and split bills beside it, as one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import method_mask, read_time, status_of
from ..functions.money import signed_cents
from ..functions.text import compact
from ..operators.cards import in_turn_by_runs
from ..operators.components import cut
from .files import records

#: What a sentence of the activity list begins with, and what it means: direction and kind (fixed values).
ACTIONS = [("paid", "debit", "spend"), ("sent", "debit", "spend"), ("received", "credit", "income"), ("refund", "credit", "refund"), ("won|earned|cashback", "credit", "cashback")]
#: Minutes within which rows of two folders are one payment, and days for rewards (fixed values).
MERGE_MINUTES, REWARD_DAYS = 5, 2


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns, worked out once a row: a filter on them does not work them out again, as it would below a plain select."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def activity(items: DataFrame) -> DataFrame:
    """(id, ts, cents, direction, kind, payee, paid_from) of items (id, sentence, at, status): "Paid ₹120.00 to Ann using Bank
    1234"; items that were not completed, and sentences without an amount, give none."""
    done = _once(items.filter(status_of("status") == "completed"), F.col("id").alias("id"), F.col("at").alias("at"), F.trim(F.regexp_replace("sentence", r"\s+", " ")).alias("_t"))
    low = F.lower("_t")
    action = F.coalesce(*[F.when(low.rlike(f"^(?:{word})"), F.struct(F.lit(d).alias("direction"), F.lit(k).alias("kind"))) for word, d, k in ACTIONS])
    amount = F.regexp_extract("_t", r"((?:₹|Rs\.? ?|INR ?)[0-9][0-9,]*(?:\.[0-9]{1,2})?)", 1)
    payee = F.regexp_extract("_t", r"(?i)\b(?:to|from) (.+?)(?: using .*)?$", 1)
    rows = _once(done, F.col("id").alias("id"), read_time("at").alias("ts"), F.abs(signed_cents(amount)).alias("cents"), action.alias("_a"), F.col("_t").alias("_t"))
    # Behind the filter, so that names and ways of paying are read only where they are asked for.
    paid = F.regexp_extract("_t", r"(?i)\busing (.+)$", 1)
    return rows.filter("ts is not null and cents is not null and _a is not null").select("id", "ts", "cents", "_a.direction", "_a.kind", payee.alias("payee"), method_mask(paid).alias("paid_from"))


def read_activity_html(spark: SparkSession, path: str) -> DataFrame:
    """(id, sentence, at, status) of the cells of activity files in HTML, in the order of each file; a cell's first line is its
    sentence, the next the time; tags and entities go."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?i)<div class=\"[^\"]*content-cell[^\"]*\">")).alias("n", "cell")).filter("n > 0")
    lines = F.transform(F.split(F.regexp_replace("cell", r"(?is)</div>.*$", ""), r"(?i)<br\s*/?>"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", ""), "&nbsp;| ", " "), "&amp;", "&")))
    return text.select(F.sha1(F.concat_ws("#", "file", "n")).alias("id"), F.get(lines, F.lit(0)).alias("sentence"), F.get(lines, F.lit(1)).alias("at"), F.lit(None).cast("string").alias("status"))


def entries(rows: DataFrame, source: str, default: str | None = None) -> DataFrame:
    """(id, ts, cents, direction, kind, payee, note, source) of table rows (id, at, amount, description, status, memo): completed ones
    with a time and an amount; a plus before the amount makes it money that came."""
    status = status_of(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit(default)))
    cents = F.abs(signed_cents(F.regexp_replace(F.trim("amount"), r"^\+\s*", "")))
    came = F.trim("amount").startswith("+") | F.lit(source == "rewards")
    party = F.coalesce(F.nullif(F.regexp_extract("description", r"(?i)\b(?:to|from)\s+(.+)$", 1), F.lit("")), F.col("description"))
    out = _once(rows.filter(status == "completed"), F.col("id").alias("id"), read_time("at").alias("ts"), cents.alias("cents"), F.when(came, "credit").otherwise("debit").alias("direction"), F.when(F.lit(source == "rewards"), "cashback").when(came, "income").otherwise("spend").alias("kind"), F.trim(party).alias("payee"), F.coalesce("memo", F.lit("")).alias("note"), F.lit(source).alias("source"))
    return out.filter("ts is not null and cents is not null")


def split_bills(groups: DataFrame) -> DataFrame:
    """(group, item, payer, cents) of groups (group, items array<struct<title, payer, amount>>)."""
    return groups.select("group", F.explode("items").alias("i")).select("group", F.col("i.title").alias("item"), F.col("i.payer").alias("payer"), signed_cents("i.amount").alias("cents"))


#: Parties that stand for any: the app itself, and a name that an app could not tell (fixed values, as compact keys).
ANY_PARTY = ["", "googlepay", "unknown"]


def _same_party(a: Column, b: Column) -> Column:
    x, y = compact(F.coalesce(a, F.lit(""))), compact(F.coalesce(b, F.lit("")))
    return x.isin(ANY_PARTY) | y.isin(ANY_PARTY) | x.contains(y) | y.contains(x)


def _in_runs(rows: DataFrame, within: list[str], order: list[str], alike: list[str], key: str) -> DataFrame:
    """Adds _run (the first key of the run) and _place (from 0) to rows: those of equal `alike` that follow each other are a run."""
    line = Window.partitionBy(*within).orderBy(*order)
    same = [F.col(c).eqNullSafe(F.lag(c).over(line)) for c in alike]
    new = (F.lag(key).over(line).isNull() | ~reduce(Column.__and__, same)).cast("int")
    each = rows.withColumn("_new", new).withColumn("_i", F.sum("_new").over(line))
    run = Window.partitionBy(*within, "_i").orderBy(*order)
    return each.withColumns({"_run": F.first(key).over(run), "_place": (F.row_number().over(run) - 1).cast("bigint")}).drop("_new", "_i")


def merged(main: DataFrame, others: DataFrame) -> DataFrame:
    """(other, entry): rows of other folders, in order of time, with the entry of the activity list that each is: equal direction
    and cents, within minutes (rewards: days), a party inside the other or none; the nearest in time, each entry once; null for
    rows that the list does not have.

    Rows that tell the same and choose (or are wished for) one after the other are a run, and runs are paired, not rows: many
    copies of a payment make as many pairs as one. Entries that could be equally near to a row stand in order of their ids.
    """
    width = REWARD_DAYS * 86400
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    # Both sides are read several times; what it takes to read them is not.
    a = main.select(F.col("id").alias("entry"), "direction", "cents", seconds("ts").alias("_a"), F.col("payee").alias("_pa"))
    # Entries further apart than twice the width are never equally near.
    far = F.coalesce(F.col("_a") - F.lag("_a").over(Window.partitionBy("direction", "cents").orderBy("_a", "entry")) > 2 * width, F.lit(False))
    a = a.withColumn("_far", far.cast("int")).withColumn("_near", F.sum("_far").over(Window.partitionBy("direction", "cents").orderBy("_a", "entry"))).drop("_far")
    a = cut(_in_runs(a, ["direction", "cents", "_near"], ["entry"], ["_a", "_pa"], "entry"))
    b = others.select(F.col("id").alias("other"), "direction", "cents", seconds("ts").alias("_b"), F.col("payee").alias("_pb"), "source")
    b = cut(_in_runs(b, ["direction", "cents"], ["_b", "other"], ["_b", "_pb", "source"], "other"))
    of = lambda rows, run, n, *more: rows.groupBy(F.col("_run").alias(run), "direction", "cents", *more).agg(F.count(F.lit(1)).alias(n))
    entries_, rows = cut(of(a, "run_entry", "n_right", "_a", "_pa")), cut(of(b, "run_other", "n_left", "_b", "_pb", "source"))

    def near(rows: DataFrame, within: int) -> DataFrame:
        # The rows of other folders, of which there are fewer, are spread over the spans that reach them.
        span = lambda c: F.floor(F.col(c) / within)
        spread = rows.withColumn("_span", F.explode(F.array(*[span("_b") + k for k in (-1, 0, 1)])))
        return spread.join(entries_.withColumn("_span", span("_a")), ["direction", "cents", "_span"]).filter(F.abs(F.col("_a") - F.col("_b")) <= within)

    pairs = near(rows.filter("source = 'rewards'"), width).unionByName(near(rows.filter("source <> 'rewards'"), MERGE_MINUTES * 60).filter(_same_party(F.col("_pa"), F.col("_pb"))))
    pairs = pairs.select("run_other", "run_entry", "n_left", "n_right", F.col("_b").alias("at"), F.abs(F.col("_a") - F.col("_b")).alias("apart"))
    taken = in_turn_by_runs(pairs, "run_other", "run_entry", ["at"], ["apart"])
    met = b.select("other", F.col("_run").alias("run_other"), "_place").join(taken, "run_other").filter((F.col("_place") >= F.col("from_left")) & (F.col("_place") < F.col("from_left") + F.col("n")))
    met = met.select("other", F.col("run_entry").alias("_run"), (F.col("from_right") + F.col("_place") - F.col("from_left")).alias("_place")).join(a.select("entry", "_run", "_place"), ["_run", "_place"])
    return b.select("other").join(met.select("other", "entry"), "other", "left")


def merged_list(main: DataFrame, others: DataFrame) -> DataFrame:
    """(id, ts, cents, direction, kind, payee, paid_from, note, refs, source) of everything that moved: the entries of the activity list
    as the rows of other folders complete them, and the rows that the list does not have.

    `main` and `others` as activity() and entries() give them, with `refs` (a map) if at hand. A row that is an entry of the list
    adds its references, of which the entry's own go before, and its memo, if the entry has none; a reward makes the entry
    cashback and names it, if its own name stands for any. Each entry takes one row; ids are distinct within each table.
    """
    text = lambda d, c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    refs = lambda d: F.coalesce(F.col("refs"), F.create_map().cast("map<string,string>")) if "refs" in d.columns else F.create_map().cast("map<string,string>")
    shape = lambda d, source: d.select("id", "ts", "cents", "direction", "kind", "payee", text(d, "paid_from").alias("paid_from"), F.coalesce(F.nullif(text(d, "note"), F.lit("")), F.lit("")).alias("note"), refs(d).alias("refs"), source.alias("source"))
    main, others = cut(main), cut(others)
    links = cut(merged(main, others))
    a, b = shape(main, F.lit("activity")), shape(others, F.col("source"))
    more = b.join(links.filter("entry IS NOT NULL"), b["id"] == links["other"]).select("entry", *[F.col(c).alias(f"_{c}") for c in ("payee", "note", "refs", "source")])
    both = a.join(more, a["id"] == more["entry"], "left")
    reward = F.coalesce(F.col("_source") == "rewards", F.lit(False))
    unnamed = compact(F.coalesce("payee", F.lit(""))).isin([k for k in ANY_PARTY if k])
    own = F.map_filter(F.coalesce("_refs", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("refs", k))
    out = both.select(
        "id", "ts", "cents", "direction", F.when(reward, "cashback").otherwise(F.col("kind")).alias("kind"), F.when(reward & unnamed, F.col("_payee")).otherwise(F.col("payee")).alias("payee"), "paid_from",
        F.when(F.col("note") != "", F.col("note")).otherwise(F.coalesce("_note", F.lit(""))).alias("note"), F.map_concat("refs", own).alias("refs"), "source",
    )
    return out.unionByName(b.join(links.filter("entry IS NULL").select(F.col("other").alias("id")), "id", "left_semi"))


def merge_counts(main: DataFrame, others: DataFrame) -> DataFrame:
    """(source, merged, added): of each other folder, how many rows were entries of the list and how many were added to it."""
    others = cut(others)
    links = merged(main, others).join(others.select(F.col("id").alias("other"), "source"), "other")
    return links.groupBy("source").agg(F.count("entry").alias("merged"), F.count(F.when(F.col("entry").isNull(), 1)).alias("added"))


#: A bill's payment in a history of bills (fixed patterns): its day begins a record, and the amount is printed twice.
BILL_START = r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$"
BILL_FIELDS = {"day": r"^([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})$", "clock": r"^([0-9]{1,2}:[0-9]{2} ?[APap][Mm])$", "title": r"^(.*(?:XX|ending )[0-9]{4}.*)$", "txn": r"^Transaction ID:? (\S+)$", "utr": r"^UTR:? (\S+)$", "amount": r"^(₹[0-9,.]+)$", "again": r"^Amount paid:? (₹[0-9,.]+)$"}


def bill_history(lines: DataFrame) -> DataFrame:
    """(file, record, day, clock, title, txn, utr, cents, checked) of lines (file, line, text): `checked` tells whether the amount stands
    there twice and is the same; a record with no amount is none."""
    found = records(lines, BILL_START, BILL_FIELDS)
    cents, again = signed_cents("amount"), signed_cents("again")
    return found.select("file", "record", "day", "clock", "title", "txn", "utr", F.coalesce(cents, again).alias("cents"), F.coalesce(cents == again, F.lit(False)).alias("checked")).filter("cents is not null")
