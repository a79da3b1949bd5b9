"""Snapshot calendar kept up to date by a stream of metadata files.

The query's checkpoint remembers the files already read and the days per quarter, so a run
only opens new files. State is one row per calendar quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.operators.shared import remove_folder
from spindlewise.plans.snapshots import snapshot_calendar, snapshot_log


def update_calendar(entries: DataFrame, output: str, checkpoint: str) -> None:
    """Fold everything new in the ``entries`` stream into the calendar table, then stop.

    Every batch stores the whole calendar as a partition of its own. A batch replayed after a
    failure replaces its own partition, and a partition appears only when it is complete. The one
    before it stays for readers who have just listed it; older ones are removed.
    """

    def write_batch(calendar: DataFrame, batch_id: int) -> None:
        (
            calendar.withColumn("batch", F.lit(batch_id))
            .coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(output)
        )
        remove_folder(entries.sparkSession, f"{output.rstrip('/')}/batch={batch_id - 2}")

    calendar = snapshot_calendar(snapshot_log(entries))
    query = (
        calendar.writeStream.outputMode("complete")
        .foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_calendar(spark: SparkSession, output: str) -> DataFrame:
    """The calendar as of the last batch."""
    batches = spark.read.parquet(output)
    last = batches.agg(F.max("batch")).scalar()
    return batches.filter(F.col("batch") == last).drop("batch")
