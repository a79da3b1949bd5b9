"""A stored drive-quarter summary that new days are added to.

Every column of the summary is a state that merges: counts add up, first and last days are minima and maxima, and several
rows of one drive and quarter are one to every report. So a load only appends the summary of its own days, and what is
stored is never read to take new days in. ``compact`` merges the loads once there are many.

A load is a folder of its own, and becomes visible with its lines in the ledger, which are written last: a load that broke
off leaves files that nobody reads, and the next one writes over them. One load runs at a time. The ledger names what was
taken in, days (``add``) or batches of a stream (``add_batch``), so that nothing is counted twice; fill a store in one of the
two ways.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewise.operators.shared import path_exists, remove_folder
from spindlewise.operators.summary import KEYS, OPTIONAL_KEYS, drive_quarters
from spindlewise.schema import as_drive_days

LEDGER = T.StructType().add("item", "string").add("load", "long").add("merged", "boolean")
UNDATED = "undated"
STATES = T.StructType()
for _name, _kind in {
    "model": "string",
    "serial_number": "string",
    "year": "integer",
    "quarter": "integer",
    "datacenter": "string",
    "capacity_bytes": "long",
    "reports": "long",
    "drive_days": "long",
    "failures": "long",
    "first_date": "date",
    "last_date": "date",
}.items():
    STATES = STATES.add(_name, _kind)


def merged(states: DataFrame, keys: Iterable[str] = (*KEYS, *OPTIONAL_KEYS)) -> DataFrame:
    """States of the same keys as one."""
    return states.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in ("reports", "drive_days", "failures")],
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )


class SummaryStore:
    """``DriveFleet(summary=SummaryStore(spark, folder).summary())`` gives every report but the dimensions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    # what is there

    def ledger(self) -> DataFrame:
        """(item, load, merged): a row for each day or batch of each load; rows without a date are one day."""
        path = f"{self.folder}/ledger"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(path)

    def loads(self) -> list[int]:
        """Loads in force: the last merged one and those after it."""
        rows = self.ledger().select("load", "merged").distinct().collect()
        start = max((row.load for row in rows if row.merged), default=0)
        return sorted({row.load for row in rows if row.load >= start})

    def summary(self) -> DataFrame:
        """The states in force. Several rows may share a drive and quarter; ``merged`` makes them one."""
        loads = self.loads()
        if not loads:
            return self.spark.createDataFrame([], STATES)
        paths = [f"{self.folder}/states/load={load}" for load in loads]
        return self.spark.read.schema(STATES).parquet(*paths)

    # what is added

    def add(self, drive_days: DataFrame) -> int:
        """Take in the days of ``drive_days`` that the ledger does not have; the number of them.

        A day is taken in whole, by the load that has it first. The table may be the whole history: its dates are looked up
        in a pass over that column, and only new days are read beyond it (dates, a few hundred a year, become a list in the
        query that file readers use). Rows without a date are a day of their own.
        """
        rows = as_drive_days(drive_days)
        item = F.coalesce(F.col("date").cast("string"), F.lit(UNDATED))
        there = rows.select("date").distinct().withColumn("item", item)
        new = there.join(self.ledger().select("item").distinct(), "item", "left_anti").collect()
        if new:
            wanted = F.col("date").isin([row.date for row in new if row.date is not None])
            undated = any(row.date is None for row in new)
            self._write(drive_quarters(rows.filter(wanted | F.col("date").isNull() if undated else wanted), OPTIONAL_KEYS), [row.item for row in new])
        return len(new)

    def add_batch(self, drive_days: DataFrame, batch: str) -> bool:
        """Take in all rows of a batch, unless one of this name was taken in before; whether it was new."""
        if self.ledger().filter(F.col("item") == batch).isEmpty():
            self._write(drive_quarters(as_drive_days(drive_days), OPTIONAL_KEYS), [batch])
            return True
        return False

    def compact(self) -> None:
        """Merge all loads into one. Loads merged before the last merge are removed; readers of later ones go on undisturbed."""
        items = [row.item for row in self.ledger().select("item").distinct().collect()]
        if items:
            before = max(self._merged_loads(), default=0)
            self._write(merged(self.summary()), items, whole=True)
            for load in range(1, before):
                remove_folder(self.spark, f"{self.folder}/states/load={load}")

    def _merged_loads(self) -> list[int]:
        return [row.load for row in self.ledger().filter("merged").select("load").distinct().collect()]

    def _write(self, states: DataFrame, items: list[str], whole: bool = False) -> None:
        load = 1 + (self.ledger().agg(F.max("load")).first()[0] or 0)
        states = states.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in STATES])
        states.hint("rebalance", "year", "quarter").write.mode("overwrite").parquet(f"{self.folder}/states/load={load}")
        lines = self.spark.createDataFrame([(item, load, whole) for item in items], LEDGER)
        lines.coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")  # one file: there whole or not at all
