"""The drive-quarter summary: the one reduction of the daily table that every report starts from.

A drive reports about ninety days a quarter, and each of its quarters becomes one row here.
The map-side half of the aggregation already collapses a task's rows, so a serial number
(or the null one) that holds a large part of the table sends one row per task and quarter.

Model names stay raw at this grain: name rules then run once per drive and quarter, not once
per day. Rows of one drive and quarter may repeat (two raw names, two datacenters, a changed
capacity); every report counts drives so that such rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.functions.names import matches_any
from spindlewise.schema import require_columns

KEYS = ["model", "serial_number", "year", "quarter"]
OPTIONAL_KEYS = ["datacenter", "capacity_bytes"]


def kept_on_summary(df: DataFrame, condition: Column) -> DataFrame:
    """Filter a summary by a costly condition on grouping keys, after the aggregation that made it.

    A condition on keys alone is moved below the aggregation: to a regular expression search
    per drive and day, for instance, which costs more than the aggregation itself. ``reports``
    is only known after it, and is at least one.
    """
    return df.filter(F.when(F.col("reports") > 0, condition))


def only_models(df: DataFrame, patterns: Sequence[str], summary: bool = False) -> DataFrame:
    """Rows whose raw model name matches one of the patterns anywhere; ``summary`` says that they are not daily rows."""
    require_columns(df, ["model"])
    of_interest = matches_any(F.col("model"), patterns)
    return kept_on_summary(df, of_interest) if summary else df.filter(of_interest)


def drive_quarters(drive_days: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """One row per (model, serial, year, quarter) and each of ``extra_keys``.

    ``drive_days`` counts the days with a failure flag, ``reports`` all of them.
    """
    require_columns(drive_days, ["model", "serial_number", "date", *extra_keys])
    return drive_days.groupBy(
        "model",
        "serial_number",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        *extra_keys,
    ).agg(
        F.count(F.lit(1)).alias("reports"),
        F.count("failure").alias("drive_days"),
        F.coalesce(F.sum("failure"), F.lit(0)).cast("bigint").alias("failures"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def per_drive_quarter(quarters: DataFrame) -> DataFrame:
    """A summary with optional keys brought back to one row per (model, serial, year, quarter)."""
    return quarters.groupBy(*KEYS).agg(
        *[F.sum(name).alias(name) for name in ("reports", "drive_days", "failures")],
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


def drive_spans(drive_days: DataFrame) -> DataFrame:
    """First and last day of each raw (model, serial), straight from the daily rows."""
    return _spans(drive_days, "model", "serial_number")


def model_spans(drive_days: DataFrame) -> DataFrame:
    """First and last day of each raw model, straight from the daily rows."""
    return _spans(drive_days, "model")


def _spans(drive_days: DataFrame, *keys: str) -> DataFrame:
    require_columns(drive_days, [*keys, "date"])
    return drive_days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reports"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def model_counts(df: DataFrame) -> DataFrame:
    """Distinct raw models of daily rows or a summary."""
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("reports"))


def regroup_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """Coarser spans from finer ones; any frame with first_date and last_date will do."""
    return spans.groupBy(*keys).agg(
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    )
