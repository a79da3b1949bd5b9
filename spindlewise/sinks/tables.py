"""Writers for summaries, reports and dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.operators.shared import path_exists, staged
from spindlewise.plans.afr_map import wide_lines
from spindlewise.plans.dimensions import constraint_checks


class ConstraintViolation(ValueError):
    """Dimension rows that a database would refuse."""


def write_report(report: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """A finished report to any Hadoop file system, replacing the one there."""
    report.write.mode("overwrite").format(format).options(**options).save(path)


def write_wide_lines(wide: DataFrame, path: str) -> None:
    """A wide table of ``plans.afr_map`` as one comma-separated file with a column for each model and measure."""
    with staged(wide, "wide-report") as wide:
        lines = wide_lines(wide).coalesce(1).sortWithinPartitions("place")  # a line for each quarter of service
        lines.select("value").write.mode("overwrite").text(path)


def write_drive_quarters(quarters: DataFrame, path: str) -> None:
    """Store a summary by quarter. The quarters in the frame are replaced whole, so it must hold all their days.

    Rows are clustered by quarter and drive first, so that a quarter becomes as many files as
    its size asks for (adaptive execution splits and merges them) and not one per task.
    """
    (
        quarters.hint("rebalance", "year", "quarter")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "quarter")
        .parquet(path)
    )


def require_valid(models: DataFrame, drives: DataFrame) -> None:
    """Raise if the dimensions break a constraint; the report has seven rows."""
    broken = constraint_checks(models, drives).filter(F.col("violations") > 0).collect()
    if broken:
        raise ConstraintViolation(", ".join(f"{row.constraint}: {row.violations}" for row in broken))


def write_dimensions(models: DataFrame, drives: DataFrame, folder: str) -> None:
    """Both tables, fresh, once they pass the checks."""
    with staged(models, "drive-models") as models, staged(drives, "drives") as drives:
        require_valid(models, drives)
        models.write.mode("overwrite").parquet(f"{folder}/drive_models")
        drives.write.mode("overwrite").parquet(f"{folder}/drives")


def merge_dimensions(models: DataFrame, drives: DataFrame, folder: str) -> tuple[int, int]:
    """Add what the stored dimension tables lack; how many models and drives that is.

    Rows are new by their id, which follows from their names, so that taking the same rows in again adds none. Before
    anything is written, the tables as they would be are checked: a name under a second id, a drive whose model is neither
    stored nor added, or any other broken constraint leaves both as they were. Models are written before the drives that
    refer to them, so that a run that is lost between the two breaks no constraint; the next one adds the drives.
    """
    spark = models.sparkSession
    before = [_stored(spark, f"{folder}/{name}", frame) for name, frame in (("drive_models", models), ("drives", drives))]
    fresh_models = models.distinct().join(before[0].select("drive_model_id"), "drive_model_id", "left_anti")
    fresh_drives = drives.distinct().join(before[1].select("drive_id"), "drive_id", "left_anti")
    with staged(fresh_models, "drive-models") as new_models, staged(fresh_drives, "drives") as new_drives:
        require_valid(before[0].unionByName(new_models), before[1].unionByName(new_drives))
        added = (new_models.count(), new_drives.count())
        for frame, name, rows in zip((new_models, new_drives), ("drive_models", "drives"), added):
            if rows or not path_exists(spark, f"{folder}/{name}"):
                frame.write.mode("append").parquet(f"{folder}/{name}")
    return added


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path) if path_exists(spark, path) else like.limit(0)


def append_dimension(dimension: DataFrame, url: str, table: str, **properties: str) -> None:
    """Dimension rows into an existing database table; needs its JDBC driver on the classpath."""
    dimension.write.jdbc(url, table, mode="append", properties=properties)
