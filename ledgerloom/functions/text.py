"""Keys and rewritings of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact(c: Column | str) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def words_only(c: Column | str) -> Column:
    """Lower case, every run of other characters one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


#: Legal words and gateway prefixes that do not tell shops apart (fixed values).
LEGAL_WORDS = ["pvt", "private", "ltd", "limited", "llp", "inc", "india", "co", "company", "technologies", "services", "solutions"]
GATEWAYS = ["razorpay", "payu", "paytm", "cashfree", "billdesk", "ccavenue"]


def normal_name(c: Column | str) -> Column:
    """A payee's name for comparison: quotes dropped, words kept, gateway prefixes, legal words and store codes gone."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "['’`]", "")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    t = F.regexp_replace(t, "^(" + "|".join(GATEWAYS) + ") ", "")
    t = F.regexp_replace(t, r"\b(" + "|".join(LEGAL_WORDS) + r")\b", "")
    t = F.regexp_replace(t, r"\b[a-z]?[0-9]{3,}\b", "")
    return F.trim(F.regexp_replace(t, " +", " "))


#: Titles before a person's name (fixed values).
TITLES = ["mr", "mrs", "ms", "dr", "shri", "smt"]


def person_name(c: Column | str) -> Column:
    """A person's name without the verb before it and without titles."""
    t = F.regexp_replace(F.lower(F.trim(_col(c))), "^(paid to|sent to|received from|transfer to|to|from) ", "")
    t = F.regexp_replace(t, r"^(" + "|".join(TITLES) + r")\.? ", "")
    return F.trim(F.regexp_replace(t, " +", " "))


#: Letters with marks and what stands for them (fixed values).
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def plain(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(_col(c)), MARKED, PLAIN)


def place_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(plain(c), "[^a-z0-9]+", " "))


def place_name(c: Column | str) -> Column:
    """Spaces squeezed; written with capitals if it was all lower case."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    return F.when(t == F.lower(t), F.initcap(t)).otherwise(t)


def payee_matches(name: Column | str, word: str) -> Column:
    """Whether a name has the word as the start of one of its words, or (5 letters or more) anywhere in its compact form."""
    key = "".join(ch for ch in word.lower() if ch.isalnum())
    found = F.concat(F.lit(" "), words_only(name)).contains(" " + word.lower().strip())
    return found | compact(name).contains(key) if len(key) >= 5 else found


def long_words(c: Column | str, stop: tuple[str, ...] = ("bank", "card", "payment", "limited", "india", "store")) -> Column:
    """The set of words of four letters or more that are not stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z]{4,}"), F.lit(0))), F.array(*[F.lit(s) for s in stop]))


def last_digits(c: Column | str, n: int = 4) -> Column:
    """The last `n` digits of an account or card number; null if it has fewer."""
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.when(F.length(digits) >= n, F.right(digits, F.lit(n)))


def masked(c: Column | str) -> Column:
    return F.concat(F.lit("XX"), last_digits(c))


def stable_id(*columns: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]))


def most_mentioned(text: Column | str, patterns: dict[str, str]) -> Column:
    """The name whose pattern occurs most often in a text, the first listed on a tie, null if none occurs."""
    t = F.lower(_col(text))
    counts = [(name, F.regexp_count(t, F.lit(pattern))) for name, pattern in patterns.items()]
    best = F.greatest(*[n for _, n in counts]) if len(counts) > 1 else counts[0][1]
    return F.when(best > 0, F.coalesce(*[F.when(n == best, F.lit(name)) for name, n in counts]))
