"""Model and drive dimension tables, and the checks a database would enforce on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.functions.units import exact_terabytes
from spindlewise.operators.capacity import most_frequent

#: Rows of a model table (two short texts each) that may be broadcast.
BROADCAST_MODELS = 100_000


def _key(*natural: str) -> Column:
    """Surrogate key that reruns agree on; parts are length-prefixed so that no two keys run together."""
    parts = []
    for name in natural:
        text = F.coalesce(F.col(name), F.lit(""))
        parts += [F.length(text).cast("string"), text]
    return F.sha2(F.concat_ws(":", *parts), 256)


def drive_models(drive_days: DataFrame) -> DataFrame:
    """One row per raw model with the capacity it reports most often; all models."""
    counts = drive_days.groupBy("model", "capacity_bytes").agg(F.count(F.lit(1)).alias("reports"))
    return (
        counts.groupBy("model")
        .agg(most_frequent("capacity_bytes", "reports").alias("capacity_bytes"))
        .select(
            _key("model").alias("drive_model_id"),
            F.col("model").alias("drive_model_smart"),
            exact_terabytes(F.col("capacity_bytes")).alias("capacity_tb"),
        )
    )


def drives(drive_days: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row per serial number, under the model it reports most often; drives without any drop out.

    Keys follow from names, so the frame above is not needed. With ``models``, a stored table whose keys may be of another
    make, drives of models that it lacks drop out too. It is counted, up to a limit, and broadcast below that.
    """
    counts = drive_days.groupBy("serial_number", "model").agg(F.count(F.lit(1)).alias("reports"))
    per_drive = counts.groupBy("serial_number").agg(most_frequent("model", "reports").alias("drive_model_smart"))
    named = per_drive.where(F.col("drive_model_smart").isNotNull())
    if models is None:
        keyed = named.withColumn("drive_model_id", _key("drive_model_smart"))
    else:
        known = models.select("drive_model_smart", "drive_model_id")
        few = known.limit(BROADCAST_MODELS + 1).count() <= BROADCAST_MODELS
        keyed = named.join(F.broadcast(known) if few else known, "drive_model_smart")
    return keyed.select(_key("drive_model_id", "serial_number").alias("drive_id"), "drive_model_id", "serial_number")


def constraint_checks(models: DataFrame, drives: DataFrame) -> DataFrame:
    """One row per constraint: rows that break it, of the rows checked.

    Each table is aggregated by its natural key and by its id, and the checks are read off the results. Drives are added
    up by model before models are looked up. Pass stored tables; both are read more than once.
    """
    by_name = models.groupBy("drive_model_smart").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("capacity_tb").isNull()).alias("no_size")
    )
    named = F.col("drive_model_smart").isNotNull()
    model_checks = by_name.agg(
        F.sum("rows").alias("rows_checked"),
        F.sum(F.when(named, F.col("rows") - 1)).alias("duplicate_model"),
        F.sum(F.when(~named, F.col("rows"))).alias("missing_model_name"),
        F.sum("no_size").alias("missing_model_size"),
    )

    known = models.select("drive_model_id").distinct().withColumn("known", F.lit(True))
    has_model = F.col("drive_model_id").isNotNull()
    has_serial = F.col("serial_number").isNotNull()
    by_model = (
        drives.groupBy("drive_model_id", "serial_number")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("drive_model_id")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum(F.when(has_serial, F.col("rows") - 1)).alias("again"),
            F.sum(F.when(~has_serial, F.col("rows"))).alias("no_serial"),
        )
        .join(known, "drive_model_id", "left")
    )
    drive_checks = by_model.agg(
        F.sum("rows").alias("rows_checked"),
        F.sum(F.when(has_model, F.col("again"))).alias("duplicate_drive"),
        F.sum("no_serial").alias("missing_serial_number"),
        F.sum(F.when(~has_model, F.col("rows"))).alias("missing_drive_model"),
        F.sum(F.when(has_model & F.col("known").isNull(), F.col("rows"))).alias("orphan_drive"),
    )
    every = [model_checks, _repeated(models, "drive_model_id"), drive_checks, _repeated(drives, "drive_id")]
    return reduce(DataFrame.unionByName, map(_as_rows, every))


def _repeated(table: DataFrame, key: str) -> DataFrame:
    per_key = table.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    again = F.when(F.col(key).isNotNull(), F.col("rows") - 1)
    return per_key.agg(F.sum("rows").alias("rows_checked"), F.sum(again).alias(f"duplicate_{key}"))


def _as_rows(checks: DataFrame) -> DataFrame:
    names = [name for name in checks.columns if name != "rows_checked"]
    counted = checks.select("rows_checked", *[F.coalesce(name, F.lit(0)).alias(name) for name in names])
    return counted.unpivot("rows_checked", names, "constraint", "violations").select(
        "constraint", "violations", F.coalesce("rows_checked", F.lit(0)).alias("rows_checked")
    )
