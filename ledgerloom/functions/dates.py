"""Months, fiscal years, cycles and calendars, as column expressions and small frames."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyy-MM")


def fiscal_year(day: Column | str, first_month: int = 4) -> Column:
    """The calendar year in which the fiscal year ends: with April first, March 2025 and April 2024 are both 2025."""
    return F.year(F.add_months(_col(day), 13 - first_month)) if first_month > 1 else F.year(_col(day))


#: Ways of writing a date that statements use (fixed values).
DATE_STYLES = ["dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "dd MMM yyyy", "dd-MMM-yyyy", "MMM dd, yyyy"]


def shape_of(style: str) -> str:
    """A pattern that every text of a style fits: names of months and halves of days are letters, the other letters stand for numbers
    (signs among them), marks for themselves. A text of another shape fails at its first letters.

    >>> shape_of("MMM dd, yyyy")
    '^[A-Za-z]+ [-+0-9]+, [-+0-9]+$'
    """
    return "^" + re.sub("[A-Za-z]+", lambda m: "[A-Za-z]+" if m[0] in ("MMM", "a") else "[-+0-9]+", style.replace(".", "[.]")) + "$"


def read_styled(t: Column, styles: list[str]) -> Column:
    """A time in the first style that a text is in, else null. A text that is not of a style's shape is not tried: to fail costs many
    times more than to look. Its first letter and the style's marks are looked at before that."""
    begins = lambda s: t >= "A" if s.startswith("MMM") else t < "A"
    marks = lambda s: [t.contains(m) for m in dict.fromkeys(re.sub("[A-Za-z ]", "", s))]
    fits = lambda s: reduce(Column.__and__, [begins(s), *marks(s), t.rlike(shape_of(s))])
    return F.coalesce(*[F.when(fits(s), F.try_to_timestamp(t, F.lit(s))) for s in styles])


def read_date(text: Column | str) -> Column:
    """A date in any of the known styles; null for others and for days that do not exist."""
    # Once for all styles: a lambda's variable is worked out before its body.
    return F.transform(F.array(F.trim(_col(text))), lambda t: F.when(t != "", read_styled(t, DATE_STYLES)).cast("date"))[0]


def roll_back(day: Column | str, anchor: Column | str, slack: int = 5) -> Column:
    """A day without a year, read in the anchor's year: a year earlier if it lies beyond the anchor and `slack` days."""
    d = _col(day)
    return F.when(d > F.date_add(_col(anchor), slack), F.add_months(d, -12)).otherwise(d)


def cycle_end(day: Column | str, cycle_day: Column | str) -> Column:
    """The last `cycle_day` on or before a day; a month that is shorter ends its cycle on its last day."""
    d, k = _col(day), _col(cycle_day)

    def of_month(first: Column) -> Column:
        return F.least(F.date_add(first, (k - 1).cast("int")), F.last_day(first))

    this = F.trunc(d, "MM")
    return F.when(of_month(this) <= d, of_month(this)).otherwise(of_month(F.add_months(this, -1)))


def cycle_start(end: Column | str, cycle_day: Column | str) -> Column:
    """The day after the cycle end before `end`."""
    return F.date_add(cycle_end(F.date_sub(_col(end), 1), cycle_day), 1)


def excel_date(serial: Column | str) -> Column:
    return F.date_add(F.lit(dt.date(1899, 12, 30)), _col(serial).cast("int"))


@dataclass(frozen=True)
class Period:
    """A closed range of days."""

    first: dt.date
    last: dt.date

    @staticmethod
    def year(y: int) -> Period:
        return Period(dt.date(y, 1, 1), dt.date(y, 12, 31))

    @staticmethod
    def month(y: int, m: int) -> Period:
        return Period(dt.date(y, m, 1), dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1))

    @staticmethod
    def fiscal(ends: int) -> Period:
        return Period(dt.date(ends - 1, 4, 1), dt.date(ends, 3, 31))

    @staticmethod
    def season(name: str, y: int) -> Period:
        """Spring from March, summer from June, autumn from September, winter from December into the next year."""
        first = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}[name]
        after = dt.date(y + (first + 2) // 12, (first + 2) % 12 + 1, 1)
        return Period(dt.date(y, first, 1), after - dt.timedelta(1))

    def before(self) -> Period:
        """The period of the same kind before: whole months go back by as many months, others by as many days."""
        after = self.last + dt.timedelta(1)
        if self.first.day == 1 and after.day == 1:
            n = (after.year - self.first.year) * 12 + after.month - self.first.month
            m = self.first.year * 12 + self.first.month - 1 - n
            return Period(dt.date(m // 12, m % 12 + 1, 1), self.first - dt.timedelta(1))
        return Period(self.first - (self.last - self.first) - dt.timedelta(1), self.first - dt.timedelta(1))

    def has(self, day: Column | str) -> Column:
        """Two comparisons with constants, which reach the scan."""
        return (_col(day) >= F.lit(self.first)) & (_col(day) <= F.lit(self.last))


def months_in(spark: SparkSession, period: Period) -> DataFrame:
    """(month) for each month that a period touches."""
    one = spark.range(1).select(F.sequence(F.trunc(F.lit(period.first), "MM"), F.trunc(F.lit(period.last), "MM"), F.expr("interval 1 month")).alias("m"))
    return one.select(F.explode("m").alias("m")).select(month_key("m").alias("month"))


def prorated(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Each row once for each month its closed interval touches: month, days in it, days of the interval, share.

    Days are counted from the ends of months, so no interval is blown up into days. Rows with a missing or reversed
    interval have no month.
    """
    start = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    rows = rows.filter(F.col(first) <= F.col(last)).withColumn("_m", F.explode(start))
    inside = F.datediff(F.least(F.last_day("_m"), F.col(last)), F.greatest(F.col("_m"), F.col(first))) + 1
    whole = F.datediff(F.col(last), F.col(first)) + 1
    return rows.withColumns({"month": month_key("_m"), "days": inside, "of_days": whole, "share": inside / whole}).drop("_m")
