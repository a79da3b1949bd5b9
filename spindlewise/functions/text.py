"""Text cells of the printed capacity reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_in_order(order_by: str, cell: str, separator: str) -> Column:
    """Aggregate: the ``cell`` texts of a group, ordered by ``order_by``, as one string.

    Meant for rows already aggregated to one per group member.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order_by), F.col(cell))))
    return F.array_join(F.transform(pairs, lambda pair: pair[cell]), separator)


def datacenter_cell(datacenter: Column, exabytes: Column) -> Column:
    return F.format_string("%s = %4.2f EB", datacenter, F.round(exabytes, 2))


def maker_cell(maker: Column, petabytes: Column, share_percent: Column) -> Column:
    return F.format_string("%s = %,8.1f (%3.0f%%)", maker, F.round(petabytes, 1), F.round(share_percent, 0))
