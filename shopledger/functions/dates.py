"""Calendar expressions (FN-01..10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day number of 1970-01-01, weekday names, month names.
EPOCH_JDN = 2440588
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]


def text_date(col: Column) -> Column:
    """FN-01: DD-Mon-YYYY text to a date, NULL when it does not parse."""
    return F.try_to_date(F.trim(col), "dd-MMM-yyyy")


def yyyymm(day: Column) -> Column:
    """FN-05: year and month as one integer."""
    return F.year(day) * 100 + F.month(day)


def ym_year(ym: Column) -> Column:
    """FN-05: the year of a yyyymm integer."""
    return F.floor(ym / F.lit(100)).cast("int")


def ym_month(ym: Column) -> Column:
    """FN-05: the month of a yyyymm integer."""
    return F.pmod(ym, F.lit(100)).cast("int")


def jdn(day: Column) -> Column:
    """FN-03: Julian day number."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(EPOCH_JDN)


def jdn_to_date(number: Column) -> Column:
    """The date of a Julian day number."""
    return F.date_add(F.lit("1970-01-01").cast("date"), (number - EPOCH_JDN).cast("int"))


def dow0(day: Column) -> Column:
    """FN-04: weekday with 0 = Monday (jdn mod 7)."""
    return F.weekday(day)


def dow1(day: Column) -> Column:
    """FN-04: weekday with 1 = Monday, as the semantic layer counts."""
    return F.weekday(day) + 1


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), F.weekday(day) + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), month)


def is_weekend(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "Y").otherwise("N")


def week_seq(number: Column, base: Column) -> Column:
    """FN-07: anchored 7-day week number of a Julian day."""
    return F.floor((number - base) / F.lit(7)).cast("int")


def week_of_year(day: Column) -> Column:
    """FN-07: week of the year by day count (day 1..7 is week 1)."""
    return (F.floor((F.dayofyear(day) - 1) / F.lit(7)) + 1).cast("int")


def quarter_label(day: Column) -> Column:
    """FN-08: 2020Q3."""
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def season(month: Column) -> Column:
    """FN-09: meteorological season of a month number."""
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def period(day: Column, cut: str, before: str, after: str) -> Column:
    """FN-09: a named period split by one cut date."""
    return F.when(day >= F.lit(cut).cast("date"), after).otherwise(before)


def month_label(day: Column) -> Column:
    """FN-10: a label that sorts by month (01 Jan)."""
    return F.concat(
        F.lpad(F.month(day).cast("string"), 2, "0"), F.lit(" "), F.left(month_name(F.month(day)), F.lit(3))
    )
