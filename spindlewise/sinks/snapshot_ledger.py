"""A stored record of the snapshot metadata files already seen, from which the calendar follows.

A version number only tells which files are newer; a file that arrives late, under a lower number or under none, would be
missed. Here the names decide: a run reads the files whose names the record lacks, and appends one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.operators.shared import path_exists
from spindlewise.plans.snapshots import LOG, snapshot_calendar, snapshot_log
from spindlewise.sources.snapshots import list_snapshot_files, read_snapshot_files


class SnapshotLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def log(self) -> DataFrame:
        """One row per file seen: name, version, UTC day and quarter."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.path).dropDuplicates(["file_name"])

    def calendar(self) -> DataFrame:
        """First and last snapshot day per quarter, over all files seen."""
        return snapshot_calendar(self.log())

    def add(self, entries: DataFrame) -> None:
        """Take in entries (file_name, last_updated_ms) that are not in the record. Entries without a time stay out, so that
        a file that could not be read is tried again."""
        log = snapshot_log(entries.filter(F.col("last_updated_ms").isNotNull())).dropDuplicates(["file_name"])
        new = log.join(self.log().select("file_name"), "file_name", "left_anti").select(*LOG.names)
        new.write.mode("append").parquet(self.path)

    def add_folder(self, folder: str) -> int:
        """Take in the metadata files of ``folder`` that are not in the record, opening no others; how many those are.

        Names are listed, which Spark does on the driver for every folder it reads, and compared with the record; only
        files of new names are opened. Broken ones count as new each time (``sources.snapshots.broken_snapshot_files``).
        """
        listed = list_snapshot_files(self.spark, folder)
        new = [row.path for row in listed.join(self.log().select("file_name"), "file_name", "left_anti").collect()]
        if new:
            self.add(read_snapshot_files(self.spark, new))
        return len(new)
