"""Calendar of table snapshots: which days each quarter's snapshots span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewise.functions.calendar import quarter_of, utc_date_of_millis
from spindlewise.sources.snapshots import METADATA_SUFFIX

LOG = (
    T.StructType()
    .add("file_name", "string")
    .add("version", "long")
    .add("last_updated_ms", "long")
    .add("snapshot_date", "date")
    .add("year_quarter", "string")
)


def snapshot_log(entries: DataFrame) -> DataFrame:
    """Metadata files with version, UTC day and quarter; ``file_name`` may be a path.

    The version is the number that the file name starts with, of any width; null where it starts with none.
    """
    base_name = F.element_at(F.split("file_name", "/"), -1)
    day = utc_date_of_millis(F.col("last_updated_ms"))
    return entries.filter(F.col("file_name").endswith(METADATA_SUFFIX)).select(
        base_name.alias("file_name"),
        F.regexp_extract(base_name, r"^(\d+)", 1).try_cast("bigint").alias("version"),
        "last_updated_ms",
        day.alias("snapshot_date"),
        quarter_of(day).alias("year_quarter"),
    )


def latest_snapshot(log: DataFrame) -> DataFrame:
    """The log row with the highest version; of equal ones, that with the last file name."""
    row = F.struct("version", "file_name", *[name for name in log.columns if name not in ("version", "file_name")])
    return log.agg(F.max(row).alias("latest")).select(*[F.col(f"latest.{name}").alias(name) for name in log.columns])


def snapshot_calendar(log: DataFrame) -> DataFrame:
    """First and last snapshot day per quarter."""
    return log.groupBy("year_quarter").agg(
        F.min("snapshot_date").alias("date_min"), F.max("snapshot_date").alias("date_max")
    )


def updated_calendar(calendar: DataFrame, log: DataFrame, known_version: int | None) -> DataFrame:
    """An earlier calendar brought up to date with the log's versions after ``known_version``, and with files without one.

    Versions that arrive late under a lower number are missed; ``sinks.snapshot_ledger`` goes by names and finds them.
    """
    later = F.col("version").isNull() | (F.col("version") > F.lit(known_version))
    new = log if known_version is None else log.filter(later)
    return (
        calendar.select("year_quarter", "date_min", "date_max")
        .unionByName(snapshot_calendar(new))
        .groupBy("year_quarter")
        .agg(F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))
    )


def latest_version(log: DataFrame) -> int | None:
    """Highest version in the log: the mark up to which a calendar made from it is complete."""
    return log.agg(F.max("version")).first()[0]
