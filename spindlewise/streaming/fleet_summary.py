"""The stored drive-quarter summary kept up to date by a stream of daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spindlewise.sinks.summary_store import SummaryStore


def update_summary(drive_days: DataFrame, store: SummaryStore, checkpoint: str, name: str = "stream") -> None:
    """Take everything new in the ``drive_days`` stream into the store, then stop.

    A batch becomes a load of the store under its number, and is passed over when it is replayed after a failure. The
    stream keeps no state of its own but the files it has read: sums are in the store. ``name`` tells streams into one
    store apart.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        store.add_batch(batch, f"{name} {number}")

    query = drive_days.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
