"""Compare every row with the newest value of the whole frame, in one scan of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_in(frame: DataFrame, column: str) -> Column:
    """Largest value of ``column`` in ``frame``, as a scalar subquery.

    A window over the whole frame would put it all into one task, and a plain
    ``max(column)`` would read the source again: with the other columns pruned its shuffle
    differs from the frame's own. The maximum of the whole row, ``column`` first, keeps them,
    so that adaptive execution reuses the shuffle the frame has written anyway.
    """
    whole_row = F.struct(column, *[name for name in frame.columns if name != column])
    return frame.agg(F.max(whole_row).alias("row")).scalar().getField(column)
