"""Queries of the functions on texts, dates and amounts: printed forms made from the driver's tables, read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import dates, labels, money, text
from .queries import query
from .sources import movements as src


def _one_of(key: str, *texts: str) -> str:
    """One of several texts by the row's number; {n} in a text is that number with six digits. The same SQL everywhere."""
    parts = [f"WHEN {i} THEN '" + t.replace("{n}", f"' || lpad(CAST({key} AS STRING), 6, '0') || '") + "'" for i, t in enumerate(texts)]
    return f"CASE {key} % {len(texts)} {' '.join(parts)} END"


def _reads(name: str, table: str, key: str, made: str, what: Callable[[Column], dict[str, Column]], sql: dict[str, str]) -> None:
    """A query of columns read from the text `made` of each row of a table; in `sql` the text is t."""
    columns = ", ".join(f"{v} AS {k}" for k, v in sql.items())
    query(name, f"WITH s AS (SELECT {key}, {made} AS t FROM {table}) SELECT {key}, {columns} FROM s")(
        lambda s, d: src.table(s, d, table).select(key, F.expr(made).alias("t")).select(key, *[c.alias(k) for k, c in what(F.col("t")).items()]))


def _chain(t: str, steps: list[tuple[str, str]]) -> str:
    for pattern, stays in steps:
        t = f"regexp_replace({t}, '{pattern.replace(chr(39), chr(39) * 2)}', '{stays}', 'g')"
    return t


def _case(rules: list[tuple[str, str]], t: str = "lower(t)", otherwise: str = "NULL") -> str:
    """The first of (value, pattern) whose pattern is found."""
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{v}'" for v, p in rules) + f" ELSE {otherwise} END"


def _map(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_LEGAL, _GATE = "|".join(text.LEGAL_WORDS), "|".join(text.GATEWAYS)
_NORMAL = f"trim({_chain(_chain('trim(' + _chain(_chain('lower(t)', [('[' + chr(39) + '’`]', '')]), [('[^a-z0-9]+', ' ')]) + ')', [('^(' + _GATE + ') ', '')]), [(chr(92) + 'b(' + _LEGAL + ')' + chr(92) + 'b', ''), (chr(92) + 'b[a-z]?[0-9]{3,}' + chr(92) + 'b', ''), (' +', ' ')])})"
_NAMES = _one_of("c_custkey", "Razorpay*Joes Cafe Pvt Ltd {n}", "Mr. Ann  Lee", "Paid to Dr Bob", "Green Grocers India", "to smt Uma", "PAYTM fresh-mart B{n}", "Café Ñandú", "new  town ")
_reads("names_normalised", "customer", "c_custkey", _NAMES, lambda t: {"name": text.normal_name(t), "plain": text.plain(t), "place": text.place_key(t)},
       {"name": _NORMAL, "plain": f"translate(lower(t), '{text.MARKED}', '{text.PLAIN}')", "place": f"trim(regexp_replace(translate(lower(t), '{text.MARKED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"})
_reads("person_names", "customer", "c_custkey", _NAMES, lambda t: {"person": text.person_name(t), "is_person": labels.looks_like_person(t)},
       {"person": "trim(" + _chain("lower(trim(t))", [("^(paid to|sent to|received from|transfer to|to|from) ", ""), (r"^(mr|mrs|ms|dr|shri|smt)\.? ", ""), (" +", " ")]) + ")",
        "is_person": r"regexp_matches(lower(trim(t)), '^(?:mr|mrs|ms|dr|shri|smt)\.? ') OR (regexp_matches(trim(t), '^[A-Za-z]+(?: [A-Za-z]+){1,3}$') AND NOT regexp_matches(lower(trim(t)), '\b(?:store|stores|mart|shop|cafe|hotel|bank|services|foods|motors|traders|enterprises|limited|ltd|pvt)\b'))"})
_reads("place_names", "customer", "c_custkey", _one_of("c_custkey", "new  town", "North GOA", " pune", "St. Mary"), lambda t: {"place": text.place_name(t)},
       {"place": r"CASE WHEN t = lower(t) THEN array_to_string(list_transform(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE trim(regexp_replace(t, '\s+', ' ', 'g')) END"})
_SHOPS = [("fresh-?mart", "Fresh Mart", False), ("grocer", "grocers", True), ("cafe", "Joes", False)]
_reads("same_shop_keys", "customer", "c_custkey", _NAMES, lambda t: {"shop": labels.same_shop(t, _SHOPS)},
       {"shop": f"coalesce(CASE WHEN regexp_matches(lower(trim(t)), 'fresh-?mart') THEN 'Fresh Mart' WHEN regexp_matches(lower(trim(t)), 'grocer') THEN NULL WHEN regexp_matches(lower(trim(t)), 'cafe') THEN 'Joes' END, nullif({_NORMAL}, ''), lower(trim(t)))"})
_MERCHANTS = _one_of("o_orderkey", "UPI/P2M/900000{n}/SHOP NAME", "PYU*Fake Food Pune IN", "UPI-FAKE MART-fakemart@ybl", "WWW.FAKESHOP.IN", "BOOKS,MUMBAI", "AIR LINE USD 1,204.50", "Refund: Hotel - Branch 9", "STORE ref #{n}", "IN", "UPI/P2M/900000000301/TEA  STALL/ref 12", "pos 900123/ 7 Seas India", "www.razorpay.com/x@y")
_T = r"trim(regexp_replace(t, '\s+', ' ', 'g'))"
_U = f"trim(regexp_replace({_T}, '{labels.FOREIGN_AMOUNT}', '', 'g'))"
_PART = "trim(p)"
for _pattern, _stays in labels.PART_ENDS:
    _PART = f"trim(regexp_replace({_PART}, '{_pattern}', '{_stays}', 'g'))"
_reads("merchants_cleaned", "orders", "o_orderkey", _MERCHANTS, lambda t: {"merchant": labels.clean_merchant(t)},
       {"merchant": f"coalesce(list_filter(list_transform(regexp_split_to_array(CASE WHEN regexp_matches(lower({_U}), '^upi[-/ ]') THEN translate({_U}, '-', '/') ELSE {_U} END, '{labels.PART_MARKS}'), lambda p: {_PART}), lambda q: NOT regexp_matches(q, '{labels.NO_NAME}'))[1], {_T})"})
_reads("text_drawn_once", "orders", "o_orderkey", _one_of("o_orderkey", "SSTTAATTEE", "1100", "11,,223344..55", "XXXX", "Abc", "aabbc", "TTOOTTAALL  "), lambda t: {"once": labels.undoubled(t)},
       {"once": """CASE WHEN length(t) >= 4 AND length(t) % 2 = 0 AND array_to_string(list_transform(range(1, length(t), 2), lambda i: t[i]), '') = array_to_string(list_transform(range(2, length(t) + 1, 2), lambda i: t[i]), '')
        AND (regexp_matches(array_to_string(list_transform(range(1, length(t), 2), lambda i: t[i]), ''), '^[A-Za-z]+$') OR contains(t, '..') OR contains(t, ',,')) AND len(list_distinct(string_split(t, ''))) > 1
        THEN array_to_string(list_transform(range(1, length(t), 2), lambda i: t[i]), '') ELSE t END"""})  # fmt: skip
_KEY = f"trim(regexp_replace(translate(lower(regexp_replace(t, '&', ' and ', 'g')), '{text.MARKED}', '{text.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
_PLACES = _one_of("s_suppkey", "Darjeeling, WB", "goa", "Orissa", "Jammu & Kashmir", "ts", "Hyderabad (Telangana)", "Lucknow UP", "North Goa and West Bengal", "kerala or tamil nadu", "Go UP now")
_reads("states_named", "supplier", "s_suppkey", _PLACES, lambda t: {"state": labels.state_code(t), "states": F.concat_ws(",", labels.states_in(t))},
       {"state": _map(labels.STATE_KEYS, _KEY), "states": "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(' ' || {_KEY} || ' ', ' {k} ') THEN '{v}' END" for k, v in labels.STATE_KEYS.items() if len(k) > 2) + "], lambda x: x IS NOT NULL), ',')"})
_PARTED = r"^(.+?)\s*(?:,\s*|\(\s*)([^,()]+?)\s*\)?$"
_TIDY = "CASE WHEN {x} = lower({x}) THEN array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE {x} END"
query("places_with_states", f"""WITH s AS (SELECT s_suppkey, trim({_PLACES}) AS t FROM supplier), p AS (SELECT s_suppkey, t, regexp_extract(t, '{_PARTED}', 1) AS a, regexp_extract(t, '{_PARTED}', 2) AS b, regexp_extract(t, '^(.+) ([A-Z]{{2}})$', 1) AS c, regexp_extract(t, '^(.+) ([A-Z]{{2}})$', 2) AS d FROM s),
q AS (SELECT *, {_map(labels.STATE_KEYS, _KEY.replace('(t,', '(b,'))} AS sb, CASE WHEN d IN ({', '.join(f"'{k}'" for k in labels.STATES)}) THEN d END AS sd, CASE WHEN length(t) > 2 THEN {_map(labels.STATE_KEYS, _KEY)} END AS st FROM p)
SELECT s_suppkey, CASE WHEN b <> '' AND sb IS NOT NULL THEN {_TIDY.format(x='a')} WHEN sd IS NOT NULL THEN {_TIDY.format(x='c')} ELSE {_TIDY.format(x='t')} END AS place, CASE WHEN b <> '' AND sb IS NOT NULL THEN sb WHEN sd IS NOT NULL THEN sd ELSE st END AS region,
CASE WHEN b <> '' AND sb IS NOT NULL THEN sb WHEN sd IS NOT NULL THEN sd ELSE st END IS NOT DISTINCT FROM 'WB' AS in_bengal FROM q""")(
    lambda s, d: src.table(s, d, "supplier").select("s_suppkey", labels.place_parts(F.expr(_PLACES)).alias("p")).select("s_suppkey", "p.place", "p.region", labels.place_matches("p.place", "p.region", "West Bengal").alias("in_bengal")))
_reads("payment_status", "orders", "o_orderkey", _one_of("o_orderkey", "Unpaid", "PAID", "Payment failed", "processing", "Cancelled by you", "Refund done", "?", "Successful"), lambda t: {"status": labels.status_of(t)}, {"status": _case(labels.STATUS_WORDS, otherwise="'completed'")})
_reads("payment_method_masks", "orders", "o_orderkey", _one_of("o_orderkey", "Visa card ending {n}", "HDFC Bank a/c {n}", "UPI Lite", "wallet  balance", "RuPay 7", "  ", "savings account 12"), lambda t: {"mask": labels.method_mask(t)},
       {"mask": r"""CASE WHEN trim(t) = '' THEN NULL WHEN contains(lower(t), 'upi lite') THEN 'UPI Lite' WHEN len(regexp_extract_all(t, '[0-9]+')) > 0 AND regexp_matches(lower(t), 'card|visa|mastercard|rupay|amex|diners') THEN 'XXXX' || right(regexp_extract_all(t, '[0-9]+')[-1], 2)
        WHEN length(regexp_extract_all(t, '[0-9]+')[-1]) >= 4 AND regexp_matches(lower(t), 'bank|account|a/c') THEN 'XX' || right(regexp_extract_all(t, '[0-9]+')[-1], 4) ELSE trim(regexp_replace(t, '\s+', ' ', 'g')) END"""})  # fmt: skip
_ROWS = _one_of("o_orderkey", "FOREX MARKUP FEE", "IGST ON FEE", "Late payment fee", "ATM 12 cash withdrawal", "PAYMENT RECEIVED - THANK YOU", "EMI 3 of 9", "Cashback reward", "BPPY CC PAYMENT {n}", "Payment reversed", "LOAN {n} instalment", "loan interest", "Grocer & co", "Membership fee", "Airline hotel", "interest")
_reads("card_fees_and_labels", "orders", "o_orderkey", _ROWS, lambda t: {"fee": labels.card_fee(t), "label": labels.bank_label(t)}, {"fee": _case(labels.CARD_FEES), "label": _case(labels.BANK_LABELS)})
_K = labels.KIND_WORDS
query("statement_row_kinds", f"""WITH s AS (SELECT o_orderkey, {_ROWS} AS t, o_orderkey % 2 = 0 AS credit FROM orders) SELECT o_orderkey, CASE WHEN credit THEN CASE WHEN regexp_matches(lower(t), '{_K['payment']}') THEN 'bill_payment' WHEN regexp_matches(lower(t), '{_K['emi']}') THEN 'refund'
WHEN regexp_matches(lower(t), '{_K['cashback']}') THEN 'cashback' WHEN regexp_matches(lower(t), '{_K['paid']}') AND NOT regexp_matches(lower(t), '{_K['back']}') THEN 'bill_payment' ELSE 'refund' END
WHEN regexp_matches(lower(t), '{_K['loan']}') AND NOT contains(lower(t), 'interest') THEN 'transfer' ELSE 'spend' END AS kind FROM s""")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", labels.row_kind(F.expr(_ROWS), F.col("o_orderkey") % 2 == 0).alias("kind")))
query("pays_last_bill", "SELECT o_orderkey, abs(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) - CAST(floor(o_totalprice) * 100 AS BIGINT)) <= 100 AND floor(o_totalprice) > 0 AND o_orderkey % 3 > 0 AS pays FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", labels.pays_last_bill(money.cents("o_totalprice"), F.when(F.col("o_orderkey") % 3 > 0, (F.floor("o_totalprice") * 100).cast("bigint"))).alias("pays")))
_reads("file_kind_by_name", "orders", "o_orderkey", _one_of("o_orderkey", "Statement {n}.pdf", "gpay.pdf", "IMG_{n}.JPG", "takeout.zip", "Bill-{n}.pdf", "x.pdf", "Credit Card.csv"), lambda t: {"kind": labels.kind_of_file(t)},
       {"kind": _case([("image", r"\.(?:png|jpe?g|heic|webp)$"), ("upi", r"\.(?:zip|json|html?)$|gpay|google.?pay|paytm|upi"), ("card", r"statement|credit.?card"), ("bills", r"bill")], otherwise="'auto'")})
_reads("first_date_range", "orders", "o_orderkey", _one_of("o_orderkey", "Period 05 Mar 2024 to 04 Apr 2024", "31/12/2024 - 01/12/2024 then 01/01/2024 - 31/01/2024", "none", "32/01/2024 to 05/02/2024"), lambda t: {"first": labels.first_range(t)["first"], "last": labels.first_range(t)["last"]},
       {"first": "CASE o_orderkey % 4 WHEN 0 THEN DATE '2024-03-05' WHEN 1 THEN DATE '2024-01-01' END", "last": "CASE o_orderkey % 4 WHEN 0 THEN DATE '2024-04-04' WHEN 1 THEN DATE '2024-01-31' END"})
query("times_read", """WITH s AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS ts FROM orders) SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN ts + INTERVAL 330 MINUTE WHEN 3 THEN ts + INTERVAL 30 MINUTE WHEN 4 THEN CASE WHEN epoch(ts) >= 1000000000 THEN ts + INTERVAL 330 MINUTE END WHEN 5 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP)
WHEN 6 THEN ts + INTERVAL 330 MINUTE WHEN 7 THEN ts WHEN 8 THEN ts - INTERVAL 30 MINUTE WHEN 9 THEN ts WHEN 10 THEN ts WHEN 11 THEN ts + INTERVAL 250 MILLISECOND END AS ts FROM s""")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))).alias("ts")).select("o_orderkey", labels.read_time(_printed_time()).alias("ts")))


def _printed_time() -> Column:
    """Thirteen ways of printing a time: twelve hours, twenty-four, universal, an offset of five hours, seconds since 1970, a day; ISO in
    universal time, without a zone and with one; a whole month's name, a zone that nobody knows, a part of a second; none."""
    f = lambda style: F.date_format("ts", style)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    ways = [f("MMM d, yyyy, h:mm:ss a"), F.concat(f("d MMM yyyy, HH:mm"), F.lit(" IST")), F.concat(f("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.concat(f("MMM d, yyyy, h:mm a"), F.lit(" GMT+5")), seconds, f("d MMM yyyy"),
            f("yyyy-MM-dd'T'HH:mm:ss'Z'"), f("yyyy-MM-dd'T'HH:mm:ss"), f("yyyy-MM-dd'T'HH:mm'+06:00'"), f("MMMM d, yyyy, h:mm:ss a"), f("d-M-yyyy H:mm:ss 'AEST'"), f("yyyy-MM-dd'T'HH:mm:ss'.25'"), F.lit("some day")]
    out = F.lit(None).cast("string")
    for i, way in enumerate(ways):
        out = F.when(F.col("o_orderkey") % 13 == i, way).otherwise(out)
    return out


query("clock_times", "SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)) AS ts FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"))).alias("t"))
    .select("o_orderkey", labels.at_clock("o_orderdate", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("t", "h:mm a")).otherwise(F.date_format("t", "HH:mm"))).alias("ts")))
query("statement_row_refs", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'r' || o_orderkey WHEN 1 THEN 'a,r' || o_orderkey ELSE '' END AS rows FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", F.concat_ws(",", labels.statement_rows(F.expr("""CASE o_orderkey % 3 WHEN 0 THEN map('utr', 'U', 'cardRow', 'r' || o_orderkey) WHEN 1 THEN map('cardRow', 'r' || o_orderkey, 'cardRow2', 'a', 'cardRow3', '') ELSE map('txnId', 'T') END"""))).alias("rows")))
query("categories_by_words", """WITH c AS (SELECT DISTINCT o_orderpriority || ' ' || c_mktsegment AS label FROM orders JOIN customer ON o_custkey = c_custkey) SELECT label, contains(' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ', ' mach') AS by_start,
contains(' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ', ' buildings') OR contains(' ' || trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) || ' ', ' building ') AS by_plural, false AS by_two FROM c""")(
    lambda s, d: src.table(s, d, "orders").join(src.table(s, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("label")).distinct()
    .select("label", labels.named_categories(F.col("label"), "Mach").alias("by_start"), labels.named_categories(F.col("label"), "buildings").alias("by_plural"), labels.named_categories(F.col("label"), "ma").alias("by_two")))
query("paid_with_card", f"WITH {src.MOVEMENTS_SQL} SELECT channel, id % 4 = 0 AS on_card, id % 5 = 0 AS masked, count(*) AS rows, count(*) FILTER (channel = 'card' OR id % 4 = 0 OR id % 5 = 0) AS with_card FROM m GROUP BY 1, 2, 3")(
    lambda s, d: src.movements(s, d).withColumns({"card": F.when(F.col("id") % 4 == 0, F.col("card")), "paid_from": F.when(F.col("id") % 5 == 0, "XXXX12").otherwise("XX1234")})
    .groupBy("channel", F.col("card").isNotNull().alias("on_card"), (F.col("paid_from") == "XXXX12").alias("masked")).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(labels.paid_with_card(), 1)).alias("with_card")))

# Dates and amounts.
query("dates_read", """SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CAST(o_orderkey % 40000 AS INT) + DATE '1899-12-30' AS serial,
CASE WHEN CAST(o_orderdate AS DATE) > DATE '1996-06-06' THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) ELSE CAST(o_orderdate AS DATE) END AS rolled FROM orders""")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", dates.read_date(_printed_day()).alias("day"), dates.excel_date(F.col("o_orderkey") % 40000).alias("serial"), dates.roll_back(F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date")).alias("rolled")))


def _printed_day() -> Column:
    out = F.lit("31/02/2024")
    for i, style in enumerate(dates.DATE_STYLES):
        out = F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", style)).otherwise(out)
    return out


_AMOUNTS = "CASE o_orderkey % 7 WHEN 0 THEN '₹ 1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.50' WHEN 1 THEN 'Rs. ' || CAST(o_orderkey AS STRING) || ' Cr' WHEN 2 THEN '(' || CAST(o_orderkey AS STRING) || '.05)' WHEN 3 THEN '-' || CAST(o_orderkey AS STRING) WHEN 4 THEN CAST(o_orderkey AS STRING) || '.1 Dr' WHEN 5 THEN 'total' ELSE '+' || CAST(o_orderkey AS STRING) END"
_reads("amounts_read", "orders", "o_orderkey", _AMOUNTS, lambda t: {"cents": money.signed_cents(t)},
       {"cents": "CASE o_orderkey % 7 WHEN 0 THEN 100050 + (o_orderkey % 1000) * 100 WHEN 1 THEN -o_orderkey * 100 WHEN 2 THEN -o_orderkey * 100 - 5 WHEN 3 THEN -o_orderkey * 100 WHEN 4 THEN o_orderkey * 100 + 10 WHEN 5 THEN NULL ELSE o_orderkey * 100 END"})
query("amounts_rounded", "SELECT o_orderkey, floor((o_orderkey - 700) / 8.0::DOUBLE * 100 + 0.5) / 100 AS up, round_even((o_orderkey - 700) / 8.0::DOUBLE, 2) AS even FROM orders")(
    lambda s, d: src.table(s, d, "orders").select("o_orderkey", money.round_up((F.col("o_orderkey") - 700) / F.lit(8.0)).alias("up"), money.round_even((F.col("o_orderkey") - 700) / F.lit(8.0)).alias("even")))
query("stable_ids", "SELECT c_custkey, sha1(c_name || '|' || c_nationkey || '|') AS id FROM customer")(
    lambda s, d: src.table(s, d, "customer").select("c_custkey", text.stable_id("c_name", "c_nationkey", F.lit(None)).alias("id")))
_reads("most_mentioned_network", "orders", "o_orderkey", _one_of("o_orderkey", "visa rupay Visa", "RuPay", "nothing", "rupay visa"), lambda t: {"network": text.most_mentioned(t, {"rupay": "rupay", "visa": "visa"})},
       {"network": "CASE o_orderkey % 4 WHEN 0 THEN 'visa' WHEN 1 THEN 'rupay' WHEN 3 THEN 'rupay' END"})
