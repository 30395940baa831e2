"""Scalar parsers for the text fields of a loan tape, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_number(text: Column) -> Column:
    """'13.5%' to 13.5; anything that is not a number becomes null."""
    return F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double")


def term_months(text: Column) -> Column:
    """' 36 months' to 36.0."""
    return F.trim(F.replace(text, F.lit("months"), F.lit(""))).try_cast("double")


def employment_years(text: Column) -> Column:
    """'< 1 year' to 0, '10+ years' to 10, otherwise the first run of digits; blank, none or n/a to null."""
    tidy = F.lower(F.trim(text))
    return (
        F.when(tidy.isNull() | tidy.isin("", "none", "nan", "n/a"), F.lit(None))
        .when(tidy.contains("< 1"), F.lit(0.0))
        .when(tidy.contains("10+"), F.lit(10.0))
        .otherwise(F.regexp_extract(tidy, r"(\d+)", 1).try_cast("double"))
    )


def issue_date(text: Column) -> Column:
    """'Dec-2015' to a date; unreadable text to null."""
    return F.try_to_timestamp(text, F.lit("MMM-yyyy")).cast("date")


def issue_year(text: Column) -> Column:
    """Year of a 'Mon-YYYY' text, or of a text that is a bare year."""
    return F.coalesce(F.year(issue_date(text)), text.try_cast("int"))


def clip(value: Column, low, high) -> Column:
    """Limits a value to a range, keeping null as null."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low).cast("double"))
    if high is not None:
        bounded = F.least(bounded, F.lit(high).cast("double"))
    return F.when(value.isNotNull(), bounded)


def finite(value: Column) -> Column:
    """NaN and infinities to null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
