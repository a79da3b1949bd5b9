"""Columns the reports need from the daily drive table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVE_DAYS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("model", T.StringType()),
        T.StructField("serial_number", T.StringType()),
        T.StructField("failure", T.IntegerType()),
        T.StructField("capacity_bytes", T.LongType()),
        T.StructField("datacenter", T.StringType()),
    ]
)


class MissingColumns(ValueError):
    """A table lacks columns that a report reads."""


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; the table has {df.columns}")


def as_drive_days(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Keep the drive-day columns, cast to their declared types; fail if one is absent."""
    wanted = list(columns) if columns is not None else DRIVE_DAYS.fieldNames()
    require_columns(df, wanted)
    return df.select(*[F.col(name).cast(DRIVE_DAYS[name].dataType).alias(name) for name in wanted])
