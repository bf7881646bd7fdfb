"""What a text says: shops, states, kinds of rows, states of payments, masks and times, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import read_date, read_styled
from .text import _col, normal_name, place_key, place_name

#: How a purchase is printed on a card statement: parts with marks between them, of which one is the shop. Samples:
#: `UPI/P2M/900000000301/SHOP NAME/ref 12`, `UPI-SHOP NAME-shop@bank`, `GATEWAY*Shop Name Pune IN`, `WWW.SHOP.IN`,
#: `SHOP,MUMBAI`, `SHOP NAME USD 1,204.50`, `Refund: Shop - Branch 9`, `SHOP ref #900000301`.
PART_MARKS = r"[/*|,:]| - "
FOREIGN_AMOUNT = r"(?i)\b(?:usd|eur|gbp|sgd|aed|aud|jpy) ?[0-9][0-9,]*\.[0-9]{2}\b"
#: What is at the ends of a part and not of the shop's name: a site's address around it, a number behind it, places behind it.
PART_ENDS = [
    (r"(?i)^www\.", ""), (r"(?i)\.(?:com|net|org|in|io)$", ""), (r"(?i)(?:^| )(?:ref|txn|rrn|utr)?[ .#]*[0-9]{6,}.*$", ""),
    (r"(?i)(?: (?:in|ind|india|us|usa|uk|sg|bangalore|bengaluru|chennai|delhi|goa|gurgaon|hyderabad|kolkata|mumbai|noida|pune))+$", ""),
]
#: Parts that are no name: ways of paying, gateways, what is being done, numbers, addresses of accounts.
NO_NAME = r"(?i)^(?:|upi|p2[amp]|pos|ecom|www|billdesk|cashfree|ccavenue|juspay|paytm|payu|pyu|raz|razorpay|rzp|refund|reversal|emi|(?:ref|txn|rrn|utr)?[ .#]*[0-9]+|[^ ]*@[^ ]*|in|ind|india)$"


def clean_merchant(c: Column | str) -> Column:
    """The shop of a purchase as a card statement prints it: the first part that is a name, without an address around it or
    numbers and places behind it; the text itself if no part is one."""
    whole = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    t = F.trim(F.regexp_replace(whole, FOREIGN_AMOUNT, ""))
    t = F.when(F.lower(t).rlike("^upi[-/ ]"), F.translate(t, "-", "/")).otherwise(t)

    def bare(part: Column) -> Column:
        part = F.trim(part)
        for pattern, stays in PART_ENDS:
            part = F.trim(F.regexp_replace(part, pattern, stays))
        return part

    names = F.filter(F.transform(F.split(t, PART_MARKS), bare), lambda p: ~p.rlike(NO_NAME))
    return F.coalesce(F.get(names, F.lit(0)), whole)


def same_shop(c: Column | str, merchants: Sequence[tuple[str, str, bool]]) -> Column:
    """The key that spellings of one shop share: the name of the first rule (pattern, name, whether it names a kind of shop
    alone) that is found, unless that is a kind; else the normalised name, else the name in lower case."""
    t = F.lower(F.trim(_col(c)))
    known = F.lit(None).cast("string")
    for pattern, name, kind in reversed(merchants):
        known = F.when(t.rlike(pattern), F.lit(None if kind else name)).otherwise(known)
    plain = normal_name(c)
    return F.coalesce(known, F.when(plain != "", plain), t)


def undoubled(c: Column | str) -> Column:
    """A text of which each character is drawn twice, once; others stay. Figures only where two marks stand together."""
    t = _col(c)
    once = F.regexp_replace(t, r"(?s)(.)\1", "$1")
    twice = (F.length(t) >= 4) & t.rlike(r"(?s)^(?:(.)\1)+$") & (once.rlike(r"^[A-Za-z]+$") | t.contains("..") | t.contains(",,")) & ~once.rlike(r"^(.)\1*$")
    return F.when(twice, once).otherwise(t)


#: States by their code (fixed values), codes that stand for others, and names that are still written.
STATES = {
    "AN": "Andaman and Nicobar Islands", "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CH": "Chandigarh", "CG": "Chhattisgarh",
    "DD": "Dadra and Nagar Haveli and Daman and Diu", "DL": "Delhi", "GA": "Goa", "GJ": "Gujarat", "HR": "Haryana", "HP": "Himachal Pradesh", "JK": "Jammu and Kashmir",
    "JH": "Jharkhand", "KA": "Karnataka", "KL": "Kerala", "LA": "Ladakh", "LD": "Lakshadweep", "MP": "Madhya Pradesh", "MH": "Maharashtra", "MN": "Manipur", "ML": "Meghalaya",
    "MZ": "Mizoram", "NL": "Nagaland", "OD": "Odisha", "PY": "Puducherry", "PB": "Punjab", "RJ": "Rajasthan", "SK": "Sikkim", "TN": "Tamil Nadu", "TG": "Telangana",
    "TR": "Tripura", "UP": "Uttar Pradesh", "UK": "Uttarakhand", "WB": "West Bengal",
}
STATE_ALIASES = {"CT": "CG", "UT": "UK", "TS": "TG", "OR": "OD", "DN": "DD", "DH": "DD"}
OLD_STATE_NAMES = {"Orissa": "OD", "Pondicherry": "PY", "Uttaranchal": "UK", "Andaman and Nicobar": "AN", "Dadra and Nagar Haveli": "DD", "Daman and Diu": "DD"}
#: Every code and every name, by what place_key() makes of it.
STATE_KEYS = {k.lower(): v for k, v in {**{s: s for s in STATES}, **STATE_ALIASES, **{n: s for s, n in STATES.items()}, **OLD_STATE_NAMES}.items()}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def state_code(c: Column | str) -> Column:
    """The code of a state written as its code or its name, old ones too, in any case; null for anything else."""
    return _looked_up(F.regexp_replace(place_key(F.regexp_replace(_col(c), "&", " and ")), " +", " "), STATE_KEYS)


def states_in(c: Column | str) -> Column:
    """Codes of the states that a text names as whole words, in the order of the table."""
    key = F.concat(F.lit(" "), place_key(F.regexp_replace(_col(c), "&", " and ")), F.lit(" "))
    names = [(k, v) for k, v in STATE_KEYS.items() if len(k) > 2]
    every = F.array(*[F.when(key.contains(f" {k} "), F.lit(v)) for k, v in names])
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull()))


def place_parts(c: Column | str) -> Column:
    """{place, region} of a place written with its state behind a comma, in brackets, or (a code in capitals) behind a space;
    of one that is a state itself; else the place alone."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    behind = F.regexp_extract(t, r"^(.+?)\s*(?:,\s*|\(\s*)([^,()]+?)\s*\)?$", 2)
    before = F.regexp_extract(t, r"^(.+?)\s*(?:,\s*|\(\s*)([^,()]+?)\s*\)?$", 1)
    code, place = F.regexp_extract(t, r"^(.+) ([A-Z]{2})$", 2), F.regexp_extract(t, r"^(.+) ([A-Z]{2})$", 1)
    both = lambda name, state: F.struct(place_name(name).alias("place"), state.alias("region"))
    return F.coalesce(
        F.when((behind != "") & state_code(behind).isNotNull(), both(before, state_code(behind))),
        F.when(code.isin(list(STATES)), both(place, code)),
        both(t, F.when(F.length(t) > 2, state_code(t))),
    )


def place_matches(place: Column | str, region: Column | str, word: str) -> Column:
    """Whether a word means a place: its name, its name with its state (code or name), or its state alone."""
    key = " ".join("".join(ch if ch.isalnum() else " " for ch in word.lower()).split())
    own, state = place_key(place), F.lower(_col(region))
    full = F.lower(_looked_up(_col(region), STATES))
    hits = [own == key, F.concat_ws(" ", own, state) == key, F.concat_ws(" ", own, full) == key, F.lit(STATE_KEYS.get(key)) == _col(region)]
    return F.coalesce(hits[0], F.lit(False)) | (_col(region).isNotNull() & F.coalesce(hits[1] | hits[2] | hits[3], F.lit(False)))


#: Words of a payment's state, in the order in which they are looked for (fixed values): unpaid comes before paid.
STATUS_WORDS = [
    ("failed", "fail|declin|reject|expired|error"), ("pending", "pending|progress|processing|awaiting|initiated|unpaid|not paid"), ("cancelled", "cancel"),
    ("refunded", "refund|revers"), ("completed", "complete|success|paid|credited|debited|done"),
]


def _first(text: Column, rules: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for value, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def status_of(c: Column | str) -> Column:
    """The state that a text tells; no text, or one that tells none, means completed."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.when(t.isin("", "completed"), "completed").otherwise(_first(t, STATUS_WORDS, "completed"))


#: Ways of paying that have a number: (words, digits that it must have, mask, digits shown), the first that fits; and those that
#: have a name of their own instead.
NUMBERED_METHODS = [("card|visa|mastercard|rupay|amex|diners", 1, "XXXX", 2), ("bank|account|a/c", 4, "XX", 4)]
NAMED_METHODS = ["UPI Lite"]


def method_mask(c: Column | str) -> Column:
    """How something was paid, by the tables above: a mask and the last digits of the last number, or a name; the text itself,
    squeezed, where none fits; null for an empty text."""
    # The text is squeezed once: a lambda's variable is worked out before its body.
    return F.transform(F.array(F.trim(F.regexp_replace(_col(c), r"\s+", " "))), _mask_of)[0]


def _mask_of(t: Column) -> Column:
    low = F.lower(t)
    named = [F.when(low.contains(name.lower()), F.lit(name)) for name in NAMED_METHODS]

    def numbered(number: Column) -> Column:
        return F.coalesce(*[F.when((F.length(number) >= least) & low.rlike(words), F.concat(F.lit(mask), F.right(number, F.lit(shown)))) for words, least, mask, shown in NUMBERED_METHODS])

    last = F.regexp_extract(t, r"([0-9]+)[^0-9]*$", 1)
    return F.coalesce(*named, F.transform(F.array(last), numbered)[0], F.nullif(t, F.lit("")))


#: What card statements charge besides purchases, by the words they print for it, in order of what is looked for first; and what
#: a bank's own labels stand for.
FEE_WORDS = {
    "fees.forex": ["forex", "foreign currency", "currency conversion", "cross currency", "markup", "mark up", "dcc"],
    "fees.tax": ["gst", "igst", "cgst", "sgst", "service tax"],
    "fees.late": ["late fee", "late charge", "late payment fee", "late payment charge", "overdue fee", "overdue charge", "overlimit", "over limit"],
    "fees.annual": ["annual fee", "annual charge", "membership fee", "joining fee", "renewal fee"],
    "fees.interest": ["interest", "finance charge", "finance charges"],
    "cash": ["cash withdrawal", "cash advance", "atm"],
}
CARD_FEES = [(category, r"\b(?:" + "|".join(words) + r")\b") for category, words in FEE_WORDS.items()]
#: Any other fee: looked for when nothing else says what a row is.
ANY_FEE = r"\b(?:fees?|charges?|surcharge|processing)\b"
BANK_LABELS = [
    ("food.eating_out", "restaurant|dining|bakery"), ("food.groceries", "grocer|supermarket"), ("travel.fuel", "fuel|petrol"), ("travel.tickets", "airline|railway|taxi|transit"), ("travel.stay", "hotel|lodging"),
    ("home.utilities", "utilit|electric|telecom"), ("health", "pharma|hospital|medical"), ("education", "school|universit"), ("fun", "cinema|entertain"), ("shopping", "retail|apparel|electronic|shop|store"),
]
KIND_WORDS = {"payment": r"payment (?:received|thank)|autopay|bill ?pay", "emi": r"\bemi\b|instal?ment", "cashback": r"cash ?back|reward", "paid": r"\bpayment\b", "back": r"refund|revers", "loan": r"\bloan\b", "interest": "interest"}
#: What a row is: (credit, its wording, a wording that it must not have, kind), the first that fits; null fits any.
ROW_KINDS = [
    (True, "payment", None, "bill_payment"), (True, "emi", None, "refund"), (True, "cashback", None, "cashback"), (True, "paid", "back", "bill_payment"), (True, None, None, "refund"),
    (False, "loan", "interest", "transfer"), (False, None, None, "spend"),
]


def card_fee(c: Column | str) -> Column:
    """The kind of fee, or cash, that a debit of a card statement is; null if it is none."""
    return _first(F.lower(_col(c)), CARD_FEES)


def bank_label(c: Column | str) -> Column:
    """The category that a bank's own label stands for, null if none does."""
    return _first(F.lower(_col(c)), BANK_LABELS)


def row_kind(description: Column | str, credit: Column) -> Column:
    """What a row of a card statement is: a credit is a bill's payment, cashback or a refund (a purchase turned into
    instalments is credited back as one); a debit is spending, but for the instalments of a loan."""
    t = F.lower(_col(description))
    has = lambda word: F.lit(True) if word is None else t.rlike(KIND_WORDS[word])
    return F.coalesce(*[F.when((credit == side) & has(word) & (F.lit(True) if barred is None else ~has(barred)), F.lit(kind)) for side, word, barred, kind in ROW_KINDS])


def pays_last_bill(cents: Column | str, previous: Column | str) -> Column:
    """A credit of the balance before, to the unit: the last bill paid in full."""
    return F.coalesce((_col(previous) > 0) & (F.abs(_col(cents) - _col(previous)) <= 100), F.lit(False))


def looks_like_person(c: Column | str) -> Column:
    """A title before a name, or two to four words of letters alone with no word of business among them."""
    t = F.trim(_col(c))
    titled = F.lower(t).rlike(r"^(?:mr|mrs|ms|dr|shri|smt)\.? ")
    words = t.rlike(r"^[A-Za-z]+(?: [A-Za-z]+){1,3}$") & ~F.lower(t).rlike(r"\b(?:store|stores|mart|shop|cafe|hotel|bank|services|foods|motors|traders|enterprises|limited|ltd|pvt)\b")
    return titled | words


def paid_with_card() -> Column:
    """A row of a card, by its channel, its card, or the mask that it was paid from."""
    return (F.col("channel") == "card") | F.col("card").isNotNull() | F.coalesce(F.col("paid_from").rlike("^X{4}[0-9]{2}$"), F.lit(False))


def kind_of_file(name: Column | str) -> Column:
    """A first guess at what a file holds, from its name."""
    t = F.lower(_col(name))
    return _first(t, [("image", r"\.(?:png|jpe?g|heic|webp)$"), ("upi", r"\.(?:zip|json|html?)$|gpay|google.?pay|paytm|upi"), ("card", r"statement|credit.?card"), ("bills", r"bill")], "auto")


def first_range(c: Column | str) -> Column:
    """{first, last} of the first two dates with `to` or a dash between them that are in order; null if there are none."""
    date = r"[0-9]{1,2}[ /-](?:[A-Za-z]{3}|[0-9]{2})[ /-][0-9]{4}"
    pairs = F.regexp_extract_all(_col(c), F.lit(rf"({date} (?:to|-) {date})"), F.lit(1))
    both = F.transform(pairs, lambda p: F.struct(read_date(F.regexp_extract(p, f"^({date})", 1)).alias("first"), read_date(F.regexp_extract(p, f"({date})$", 1)).alias("last")))
    return F.get(F.filter(both, lambda d: d["first"] <= d["last"]), F.lit(0))


#: Minutes of named zones before or after universal time, and ways of writing a time (fixed values).
ZONES = {"ist": 330, "utc": 0, "gmt": 0, "z": 0, "bst": 60, "cet": 60, "cest": 120, "gst": 240, "sgt": 480, "est": -300, "edt": -240, "pst": -480, "pdt": -420}
LOCAL_MINUTES = 330
TIME_STYLES = ["MMM d, yyyy, h:mm:ss a", "MMM d, yyyy, h:mm a", "MMM d, yyyy, H:mm:ss", "MMM d, yyyy, H:mm", "d MMM yyyy, H:mm:ss", "d MMM yyyy, H:mm", "d MMM yyyy, h:mm:ss a", "d MMM yyyy, h:mm a", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d-M-yyyy H:mm:ss", "yyyy-M-d", "MMM d, yyyy", "d MMM yyyy"]
ISO_TIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2})(:[0-9]{2})?(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
#: Months may be written whole, or as Sept.
MONTH_ENDS = r"\b(Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)\b"


def read_time(c: Column | str) -> Column:
    """A local time in any of the known styles, or as ISO 8601 has it with a T; a zone behind it or none (then it is local, as it is
    behind a zone of an unknown name); seconds or milliseconds since 1970 too; null for others."""
    # The text, and later what of it is not its zone, are worked out once: a lambda's variable is, before its body.
    return F.transform(F.array(F.trim(F.regexp_replace(_col(c), r"\s+", " "))), _time_of)[0]


def _time_of(t: Column) -> Column:
    minutes_of = lambda sign, hours, minutes: F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0)))
    shifted = lambda local, zone: local + F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(F.lit(LOCAL_MINUTES) - zone, F.lit(0)))
    # In words: the zone's offset, a known zone's name, or a name that says nothing, is taken off the end.
    of_zone = lambda i: F.when(t.contains("GMT") | t.contains("UTC"), F.regexp_extract(t, r"(?:GMT|UTC) ?([+-])([0-9]{1,2}):?([0-9]{2})?$", i)).otherwise("")
    sign, hours, minutes = (of_zone(i) for i in (1, 2, 3))
    known = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    cut_at = lambda name: F.when(sign != "", F.regexp_replace(t, r" ?(?:GMT|UTC) ?[+-][0-9:]+$", "")).when((name != "") & ~name.isin("am", "pm"), F.left(t, F.length(t) - F.length(name) - 1)).otherwise(t)
    # A month's name is shortened only where a word goes on behind three letters.
    short = lambda b: F.when(b.rlike("[A-Za-z]{4}"), F.regexp_replace(b, MONTH_ENDS, "$1")).otherwise(b)
    named = F.transform(F.array(F.lower(F.regexp_extract(t, r" ([A-Za-z]{1,5})$", 1))), lambda name: F.struct(F.try_element_at(known, name).alias("zone"), F.rtrim(cut_at(name), F.lit(", ")).alias("bare")))
    both = F.transform(named, lambda n: F.struct(F.coalesce(F.when(sign != "", minutes_of(sign, hours, minutes)), n["zone"]).alias("zone"), read_styled(short(n["bare"]), TIME_STYLES).cast("timestamp_ntz").alias("read")))
    # ISO.
    day, clock, seconds, part, off = (F.regexp_extract(t, ISO_TIME, i) for i in range(1, 6))
    iso = F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.when(seconds == "", ":00").otherwise(seconds)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    iso = iso + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(F.concat(F.lit("0"), F.left(part, F.lit(7))).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")))
    behind = F.when(off == "Z", 0).when(off != "", minutes_of(F.left(off, F.lit(1)), F.substring(off, 2, 2), F.right(off, F.lit(2))))
    since = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(LOCAL_MINUTES), F.left(t, F.lit(10)).try_cast("bigint").cast("decimal(18,6)"))
    in_words = F.transform(both, lambda x: shifted(x["read"], x["zone"]))[0]
    return F.when(F.length(t).isin(10, 13) & t.rlike("^[0-9]{10}([0-9]{3})?$"), since).when(t.contains("T") & t.rlike(ISO_TIME), shifted(iso, behind)).otherwise(in_words)


def at_clock(day: Column | str, clock: Column | str) -> Column:
    """The local time of a day and a clock of twelve or twenty-four hours ("9:05 pm", "21:05")."""
    both = F.concat(F.date_format(_col(day), "yyyy-MM-dd"), F.lit(" "), F.upper(F.regexp_replace(_col(clock), r"\s+", "")))
    return F.coalesce(F.try_to_timestamp(both, F.lit("yyyy-MM-dd h:mma")), F.try_to_timestamp(both, F.lit("yyyy-MM-dd H:mm"))).cast("timestamp_ntz")


def statement_rows(refs: Column | str) -> Column:
    """The rows of card statements that a record is, in order: the values of cardRow, cardRow2 and so on."""
    return F.array_sort(F.array_distinct(F.filter(F.map_values(F.map_filter(_col(refs), lambda k, v: k.startswith("cardRow"))), lambda v: v != "")))


def named_categories(label: Column, words: str, least: int = 3) -> Column:
    """Whether a category's label has a word that begins with the words asked for, or is their singular."""
    q = " ".join("".join(ch if ch.isalnum() else " " for ch in words.lower()).split())
    if len(q.replace(" ", "")) < least:
        return F.lit(False)
    t = F.concat(F.lit(" "), place_key(label), F.lit(" "))
    return t.contains(f" {q}") | (t.contains(f" {q[:-1]} ") if q.endswith("s") and len(q) > least else F.lit(False))
