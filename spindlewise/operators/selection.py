"""Values at given places of a group, without any task ordering the group.

A window orders all values of a group in one task. Here the place is found digit by digit: values are counted by their
leading 16 bits, which is plain grouping that starts where the rows are; the bits that hold the place are chosen from at most
65,536 counts, and only the rows with those bits are counted by the next 16. Four rounds give a 64-bit value exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.operators.shared import checkpointed

DIGIT_BITS = 16
ROUNDS = 64 // DIGIT_BITS

#: Groups (keys, two numbers) that may be broadcast to the rows that are narrowed.
BROADCAST_GROUPS = 100_000


def _digit(value: Column, round: int) -> Column:
    """The round's bits of a signed number, leading first; in order because the leading ones keep the sign."""
    shifted = F.shiftright(value, 64 - DIGIT_BITS * (round + 1))
    return (shifted if round == 0 else shifted.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))).cast("int")


def apart(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    """``frame`` with its keys under other names, to be joined by ``same_keys``."""
    return frame.withColumnsRenamed({name: f"_{name}" for name in names})


def same_keys(names: Sequence[str]) -> Column:
    """Join condition between a frame and one set ``apart``: equal keys, a null key being a key."""
    return reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names])


def selected(counted: DataFrame, keys: Sequence[str], value: str, count: str, places: DataFrame) -> DataFrame:
    """(keys, name, selected): the value at each place of its group, when each value stands ``count`` times.

    ``counted`` has (keys, value, count), values not null and of at most 64 bits; ``places`` has (keys, name, place), a few
    rows for each group, places from 1. A place that a group does not have gives no row. Pass stored frames: ``counted`` is
    read in each round. What a round chose is small, and kept in the shared folder.
    """
    at = [*keys, "name"]
    rows = counted.select(*keys, F.col(value).cast("long").alias("_value"), F.col(count).cast("long").alias("_count"))
    found = places.select(*at, F.col("place").cast("long").alias("_left"))
    for round in range(ROUNDS):
        digit = _digit(F.col("_value"), round).alias("_digit")
        if round == 0:  # all rows are counted once, whatever the number of places
            counts = rows.groupBy(*keys, digit).agg(F.sum("_count").alias("_n"))
            digits = counts.join(apart(found, keys), same_keys(keys)).select(
                *at, "_left", F.lit(0).cast("long").alias("_so_far"), "_digit", "_n"
            )
        else:
            few = found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
            leading = F.shiftright("_value", 64 - DIGIT_BITS * round) == F.col("_so_far")
            chosen = apart(found, keys)
            narrowed = rows.join(F.broadcast(chosen) if few else chosen, same_keys(keys) & leading)
            digits = narrowed.groupBy(*at, "_left", "_so_far", digit).agg(F.sum("_count").alias("_n"))
        group = Window.partitionBy(*at).orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = digits.withColumn("_upto", F.sum("_n").over(group))
        reached = (F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left"))
        digit = F.col("_digit").cast("long")
        so_far = digit if round == 0 else F.shiftleft("_so_far", DIGIT_BITS).bitwiseOR(digit)
        found = checkpointed(
            upto.filter(reached).select(*at, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), so_far.alias("_so_far"))
        )
    return found.select(*at, F.col("_so_far").alias("selected"))
