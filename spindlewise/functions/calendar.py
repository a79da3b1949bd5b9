"""Calendar quarters, as a number pair and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIS_PER_DAY = 24 * 60 * 60 * 1000


def quarter_text(year: Column, quarter: Column) -> Column:
    """``2024 Q3``; null as soon as one part is null. Sorts in time order."""
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))


def quarter_of(date: Column) -> Column:
    return quarter_text(F.year(date), F.quarter(date))


def utc_date_of_millis(millis: Column) -> Column:
    """UTC calendar day of an epoch-milliseconds value, whatever the session zone is."""
    return F.date_from_unix_date(F.floor(millis / F.lit(MILLIS_PER_DAY)).cast("int"))


def service_year(ordinal: Column) -> Column:
    """Year of service of the n-th reported quarter (1-based): four quarters to a year."""
    return (F.floor((ordinal - 1) / 4) + 1).cast("int")


def service_quarter(ordinal: Column) -> Column:
    return ((ordinal - 1) % 4 + 1).cast("int")
