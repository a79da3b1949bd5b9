"""Raw storage capacity per quarter: the fleet, its datacenters, its drive makers.

Capacities that drives report are partly junk, so each drive counts with the typical capacity
of its group: the mode per quarter and raw model (fleet), the median per quarter, datacenter
and raw model (datacenters), the all-time mode per normalized model (makers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.functions.names import maker_of
from spindlewise.functions.text import datacenter_cell, joined_in_order, maker_cell
from spindlewise.functions.units import BYTES_PER_EB, BYTES_PER_PB, in_unit, times_drives
from spindlewise.operators.capacity import (
    drive_total,
    drives_and_capacities,
    most_frequent,
    with_doubled_median,
    with_doubled_median_by_digits,
    with_mode,
)
from spindlewise.operators.naming import with_model_name
from spindlewise.operators.summary import kept_on_summary

MIN_DATACENTER_LENGTH = 4


def _total(bytes_column: Column) -> Column:
    return F.coalesce(F.sum(bytes_column), F.lit(0).cast("decimal(38,0)"))


def capacity_fleet(quarters: DataFrame) -> DataFrame:
    """Exabytes per quarter, exact bytes, and the change from the quarter before; all models."""
    keys = ["year", "quarter", "model"]
    per_quarter = (
        with_mode(quarters, keys)
        .groupBy("year", "quarter")
        .agg(_total(times_drives(F.col("model_capacity"), F.col("drives"))).alias("raw_storage_bytes"))
        .withColumn("raw_storage_eb", in_unit(F.col("raw_storage_bytes"), BYTES_PER_EB))
    )
    # over calendar quarters: four rows a year, whatever the size of the fleet
    before = F.lag("raw_storage_eb").over(Window.orderBy("year", "quarter"))
    return per_quarter.withColumn("delta_eb", F.when(before != 0, F.col("raw_storage_eb") - before))


def known_datacenter(quarters: DataFrame) -> DataFrame:
    """Rows of a summary with a usable datacenter code, in upper case."""
    code = F.upper("datacenter")
    named = kept_on_summary(quarters.filter(F.col("datacenter").isNotNull()), F.length(code) >= MIN_DATACENTER_LENGTH)
    return named.withColumn("datacenter", code)


def _doubled_bytes_by_datacenter(quarters: DataFrame, large_groups: bool = False) -> DataFrame:
    keys = ["year", "quarter", "datacenter", "model"]
    with_median = with_doubled_median_by_digits if large_groups else with_doubled_median
    per_model = with_median(known_datacenter(quarters), keys)
    return per_model.groupBy("year", "quarter", "datacenter").agg(
        _total(times_drives(F.col("doubled_capacity"), F.col("drives"))).alias("doubled_bytes")
    )


def capacity_by_datacenter(quarters: DataFrame, large_groups: bool = False) -> DataFrame:
    """Exabytes and twice the exact bytes per quarter and datacenter; all models.

    A drive that moved counts in both places. Bytes are doubled as a median may end in one half. With ``large_groups`` no
    task orders the capacities of a model, however many different ones it reports.
    """
    exabytes = in_unit(F.col("doubled_bytes"), 2 * BYTES_PER_EB)
    return _doubled_bytes_by_datacenter(quarters, large_groups).withColumn("raw_storage_eb", exabytes)


def capacity_datacenter_report(quarters: DataFrame) -> DataFrame:
    """One row per quarter: the total and the datacenters as text."""
    exabytes = in_unit(F.col("doubled_bytes"), 2 * BYTES_PER_EB)
    return (
        _doubled_bytes_by_datacenter(quarters)
        .withColumn("cell", datacenter_cell(F.col("datacenter"), exabytes))
        .groupBy("year", "quarter")
        .agg(
            in_unit(F.sum("doubled_bytes"), 2 * BYTES_PER_EB).alias("total_eb"),
            joined_in_order("datacenter", "cell", ", ").alias("datacenters"),
        )
    )


def capacity_by_maker(quarters: DataFrame, on_unknown: str = "error") -> DataFrame:
    """Petabytes and exact bytes per quarter and drive maker, with the quarter's total and the maker's share."""
    keys = ["model_name", "year", "quarter"]
    # a row per model and quarter with its drives, and a row per model with its capacity
    counted = (
        drives_and_capacities(with_model_name(quarters, on_unknown, summary=True), keys, ["model_name"])
        .groupBy(*keys, F.col("drive").isNotNull().alias("of_drives"), "capacity_bytes")
        .agg(drive_total().alias("drives"), F.sum("reports").alias("reports"))
    )
    drives_and_capacity = counted.groupBy(*keys, "of_drives").agg(
        F.sum("drives").alias("drives"), most_frequent("capacity_bytes", "reports").alias("capacity")
    )
    per_model = drives_and_capacity.withColumn(
        "model_capacity", F.max("capacity").over(Window.partitionBy("model_name"))
    ).filter("of_drives")
    per_maker = per_model.groupBy("year", "quarter", maker_of(F.col("model_name")).alias("drive_mfr")).agg(
        _total(times_drives(F.col("model_capacity"), F.col("drives"))).alias("maker_bytes")
    )
    quarter_bytes = F.sum("maker_bytes").over(Window.partitionBy("year", "quarter"))
    petabytes = in_unit(F.col("maker_bytes"), BYTES_PER_PB)
    total = in_unit(quarter_bytes, BYTES_PER_PB)
    return per_maker.select(
        "year",
        "quarter",
        "drive_mfr",
        F.col("maker_bytes").alias("raw_capacity_bytes"),
        petabytes.alias("raw_capacity_pb"),
        total.alias("total_pb"),
        (F.try_divide(petabytes, total) * 100).alias("share_pct"),
    )


def capacity_maker_report(quarters: DataFrame, on_unknown: str = "error") -> DataFrame:
    """One row per quarter: the total and the makers with their shares as text."""
    return (
        capacity_by_maker(quarters, on_unknown)
        .withColumn("cell", maker_cell(F.col("drive_mfr"), F.col("raw_capacity_pb"), F.col("share_pct")))
        .groupBy("year", "quarter")
        .agg(
            F.max("total_pb").alias("total_pb"),
            joined_in_order("drive_mfr", "cell", "    ").alias("makers"),
        )
    )
