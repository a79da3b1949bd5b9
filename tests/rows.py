"""Literal drive-day rows."""

from __future__ import annotations

import datetime

from spindlewise.schema import DRIVE_DAYS

TB = 10**12


def day(text):
    return datetime.date.fromisoformat(text)


def drive_days(spark, rows):
    """Rows of (date, model, serial[, failure[, capacity[, datacenter]]]); the rest defaults."""
    full = []
    for row in rows:
        date, model, serial, *rest = row
        failure, capacity, datacenter = (*rest, *(0, 12 * TB, "AMS5")[len(rest) :])
        full.append((date and day(date), model, serial, failure, capacity, datacenter))
    return spark.createDataFrame(full, DRIVE_DAYS)


def dicts(df):
    return [row.asDict() for row in df.collect()]
