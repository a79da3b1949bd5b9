"""The daily drive table and the relational dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindlewise.schema import as_drive_days


def open_drive_days(
    spark: SparkSession, location: str, format: str = "parquet", snapshot_id: int | None = None, **options: str
) -> DataFrame:
    """The daily table as a lazy frame: a path, or a table name for ``format="iceberg"``.

    Without ``snapshot_id`` the newest snapshot is read. Credentials and endpoints belong in the
    session's Hadoop or catalog settings.
    """
    reader = spark.read.format(format).options(**options)
    if snapshot_id is not None:
        if format != "iceberg":
            raise ValueError("only iceberg tables have snapshots")
        reader = reader.option("snapshot-id", snapshot_id)
    return as_drive_days(reader.load(location))


def read_dimension(spark: SparkSession, url: str, table: str, **properties: str) -> DataFrame:
    """A dimension table back from a relational database; needs its JDBC driver on the classpath."""
    return spark.read.jdbc(url, table, properties=properties)
