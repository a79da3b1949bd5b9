"""Typical capacity of a group of drives, from counted values.

Reported capacities repeat day after day, so they are counted first; mode and median then
work on (value, count) rows and never see the daily rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.operators.selection import apart, same_keys, selected
from spindlewise.operators.shared import checkpointed


def drives_and_capacities(
    quarters: DataFrame, drive_keys: Sequence[str], capacity_keys: Sequence[str]
) -> DataFrame:
    """Two reductions of a summary in one pass, stacked.

    Rows with ``drive`` 1 are the distinct drives per ``drive_keys`` (0 for the missing serial
    number, which is no drive); rows with a ``drive`` of null are the distinct capacities per
    ``capacity_keys`` with the ``reports`` of each. Keys of the other reduction are null. Both
    are plain grouping, so a drive or value with very many rows is reduced where it is read.
    """
    sets = [[*drive_keys, "serial_number"], [*capacity_keys, "capacity_bytes"]]
    columns = dict.fromkeys(sets[0] + sets[1])
    of_drives = F.grouping("serial_number") == 0
    return quarters.groupingSets([[F.col(name) for name in names] for names in sets], *columns).agg(
        F.when(of_drives, F.col("serial_number").isNotNull().cast("int")).alias("drive"),
        F.when(~of_drives, F.sum("reports")).alias("reports"),
    )


def drive_total() -> Column:
    return F.coalesce(F.sum("drive"), F.lit(0)).cast("bigint")


def most_frequent(value: str, count: str) -> Column:
    """Aggregate: the value with the highest count, the lowest such value on ties, no nulls."""
    ranked = F.when(F.col(value).isNotNull(), F.struct((-F.col(count)).alias("rank"), F.col(value).alias("value")))
    return F.min(ranked).getField("value")


def _counted(quarters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drives and reports per ``keys`` and capacity (drives beside the null one), by plain sums.

    What follows orders or compares values, which a hash aggregation cannot; it gets no rows of single drives.
    """
    return (
        drives_and_capacities(quarters, keys, keys)
        .groupBy(*keys, "capacity_bytes")
        .agg(drive_total().alias("drives"), F.sum("reports").alias("reports"))
    )


def with_mode(quarters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``: distinct ``drives`` and the ``model_capacity`` reported most often."""
    return _counted(quarters, keys).groupBy(*keys).agg(
        F.sum("drives").alias("drives"), most_frequent("capacity_bytes", "reports").alias("model_capacity")
    )


def with_doubled_median(quarters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per ``keys``: distinct ``drives`` and twice the median reported capacity.

    Doubled, because the midpoint of two whole numbers may end in one half and byte sums are
    kept exact. A task only orders the distinct capacities of a group; the aggregation after
    that finds its rows in place.
    """
    group = Window.partitionBy(*keys)
    upto_here = group.orderBy("capacity_bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("capacity_bytes").isNotNull(), F.col("reports")).otherwise(0)

    ranked = _counted(quarters, keys).select(
        *keys,
        "capacity_bytes",
        "drives",
        F.sum(known).over(upto_here).alias("upto"),
        F.sum(known).over(group).alias("total"),
    )
    # positions ceil(total / 2) and floor(total / 2) + 1: one value for an odd total, the two
    # neighbours of the midpoint for an even one
    reached = F.when(F.col("capacity_bytes").isNotNull(), F.col("upto") * 2)
    lower = F.min(F.when(reached >= F.col("total"), F.col("capacity_bytes")))
    upper = F.min(F.when(reached >= F.col("total") + 1, F.col("capacity_bytes")))
    return ranked.groupBy(*keys).agg(
        F.sum("drives").alias("drives"),
        (lower.cast("decimal(19,0)") + upper.cast("decimal(19,0)")).alias("doubled_capacity"),
    )


def with_doubled_median_by_digits(quarters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same as ``with_doubled_median`` where a group may have any number of distinct capacities.

    No task orders a group (``operators.selection``), for some more jobs. Counts and choices go to the shared folder.
    """
    counted = checkpointed(_counted(quarters, keys))
    known = F.when(F.col("capacity_bytes").isNotNull(), F.col("reports"))
    totals = checkpointed(counted.groupBy(*keys).agg(F.sum("drives").alias("drives"), F.sum(known).alias("total")))
    half = F.shiftright("total", 1)
    middle = F.array(
        F.struct(F.lit("lower").alias("name"), (F.col("total") - half).alias("place")), F.struct(F.lit("upper").alias("name"), (half + 1).alias("place"))
    )
    places = totals.filter(F.col("total") > 0).select(*keys, F.explode(middle).alias("of")).select(*keys, "of.name", "of.place")
    values = counted.filter(F.col("capacity_bytes").isNotNull())
    medians = (
        selected(values, keys, "capacity_bytes", "reports", places)
        .groupBy(*keys)
        .agg(F.sum(F.col("selected").cast("decimal(19,0)")).cast("decimal(20,0)").alias("doubled_capacity"))
    )
    return totals.join(apart(medians, keys), same_keys(keys), "left").select(*keys, "drives", "doubled_capacity")
