"""Money as whole cents. Sums of cents do not depend on partitioning; a figure is divided by 100 once, at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: Column | str) -> Column:
    """Cents of a decimal amount, ties upwards."""
    return F.floor(_col(amount) * 100 + 0.5).cast("bigint")


def money(c: Column | str) -> Column:
    return _col(c).cast("double") / 100


def round_up(x: Column | str, digits: int = 2) -> Column:
    """Ties towards plus infinity, as page figures are rounded."""
    return F.floor(_col(x) * 10**digits + 0.5) / 10**digits


def round_even(x: Column | str, digits: int = 2) -> Column:
    """Ties to the even digit, as estimates are rounded."""
    return F.bround(_col(x), digits)


def share(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where the whole is 0 or missing."""
    return F.when(F.coalesce(_col(whole), F.lit(0)) == 0, F.lit(0.0)).otherwise(_col(part) / _col(whole))


#: An amount as statements print it: sign or brackets, currency mark, digits with separators, mark of a credit or debit.
AMOUNT = r"^\s*([-+(]?)\s*(?:₹|Rs\.?|INR)?\s*([-+]?)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s*\)?\s*(?i:(Cr|Dr)\.?)?\s*$"


#: What stands between the parts of an amount once these are told apart; no amount has it.
_PART = "\x01"


def signed_cents(text: Column | str) -> Column:
    """Cents of a printed amount, negative for a credit (brackets, a minus, or Cr); null if the text is no amount."""
    t = _col(text)
    # Every step is worked out once, as a lambda's variable is before its body. A text that is no amount is left as it is.
    told = lambda x: F.struct(x.alias("x"), F.regexp_replace(x, AMOUNT, _PART + _PART.join(["$1", "$2", "$3", "$4"]) + _PART).alias("told"))
    parts = F.transform(F.transform(F.array(t), told), lambda s: F.when(s["told"] != s["x"], F.split(s["told"], _PART)))

    def value(p: Column) -> Column:
        amount = F.round(F.translate(p[3], ",", "").cast("decimal(18,2)") * 100).cast("bigint")
        return F.when(p[1].isin("-", "(") | (p[2] == "-") | (F.lower(p[4]) == "cr"), -amount).otherwise(amount)

    return F.transform(parts, value)[0]
