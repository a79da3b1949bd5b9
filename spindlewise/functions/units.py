"""Decimal storage units and the annualized rate.

Sums of bytes stay exact integers (``decimal(38,0)``: a fleet's total nears the bigint limit)
and are divided once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_TB = 10**12
BYTES_PER_PB = 10**15
BYTES_PER_EB = 10**18

DAYS_PER_YEAR = 365.0


def times_drives(capacity: Column, drives: Column) -> Column:
    """Exact bytes of ``drives`` drives of one capacity; precision 20 + 17 + 1 = 38 digits."""
    return capacity.cast("decimal(20,0)") * drives.cast("decimal(17,0)")


def in_unit(total_bytes: Column, bytes_per_unit: int) -> Column:
    return total_bytes.cast("double") / F.lit(float(bytes_per_unit))


def exact_terabytes(capacity_bytes: Column) -> Column:
    """Bytes as decimal terabytes without rounding: twelve decimals hold every byte."""
    per_byte = F.lit("0.000000000001").cast("decimal(13,12)")
    return (capacity_bytes.cast("decimal(19,0)") * per_byte).cast("decimal(19,12)")


def annualized_failure_percent(failures: Column, drive_days: Column) -> Column:
    """Failures per drive-year in percent; null when no day was observed."""
    per_day = F.try_divide(failures.cast("double"), drive_days.cast("double"))
    return per_day * F.lit(DAYS_PER_YEAR) * F.lit(100.0)
