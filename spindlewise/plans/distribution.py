"""How many drives of each model were in service per quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.operators.naming import with_model_name


def distribution(quarters: DataFrame, min_drives: int = 0, on_unknown: str = "error") -> DataFrame:
    """Distinct drives per quarter and normalized model; a missing serial number is no drive."""
    keys = ["year", "quarter", "model_name"]
    return (
        with_model_name(quarters, on_unknown, summary=True)
        .select(*keys, "serial_number")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("serial_number").alias("unique_serial_numbers"))
        .filter(F.col("unique_serial_numbers") >= min_drives)
    )


def distribution_with_totals(quarters: DataFrame, min_drives: int = 0, on_unknown: str = "error") -> DataFrame:
    """``distribution`` with the quarter's total over the models shown."""
    quarter = Window.partitionBy("year", "quarter")
    return distribution(quarters, min_drives, on_unknown).withColumn(
        "total_drives", F.sum("unique_serial_numbers").over(quarter)
    )
