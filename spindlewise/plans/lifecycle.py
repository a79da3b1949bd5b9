"""When models came into and left service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.functions.calendar import quarter_of
from spindlewise.functions.names import dated_model, maker_label, model_token
from spindlewise.operators.newest import newest_in
from spindlewise.operators.summary import regroup_spans


def model_date_ranges(spans: DataFrame) -> DataFrame:
    """First and last quarter per model, and whether it is still in use."""
    by_name = regroup_spans(
        regroup_spans(spans, "model").withColumn("drive_model", dated_model(F.col("model"))), "drive_model"
    )
    in_service = F.col("last_date") == newest_in(by_name, "last_date")
    last_seen = quarter_of(F.col("last_date"))
    return by_name.select(
        "drive_model",
        quarter_of(F.col("first_date")).alias("first_seen"),
        last_seen.alias("last_seen"),
        F.col("last_date").alias("last_seen_date"),
        in_service.alias("in_service"),
        F.when(in_service, F.lit("currently deployed"))
        .otherwise(F.concat(F.lit("removed from use: "), last_seen))
        .alias("status"),
    )


def models_per_maker(spans: DataFrame) -> DataFrame:
    """Models of each maker; deployed if last seen in the newest quarter of any model."""
    by_model = (
        regroup_spans(spans, "model")
        .select(
            maker_label(F.col("model")).alias("mfr"),
            model_token(F.col("model")).alias("model"),
            quarter_of(F.col("first_date")).alias("first_seen"),
            quarter_of(F.col("last_date")).alias("last_seen"),
        )
        .groupBy("mfr", "model")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    )
    deployed = F.col("last_seen") == newest_in(by_model, "last_seen")
    return by_model.select(
        "mfr",
        "first_seen",
        "last_seen",
        "model",
        deployed.alias("deployed_currently"),
        F.when(deployed, F.lit("currently deployed"))
        .otherwise(F.concat(F.lit("last seen: "), F.col("last_seen")))
        .alias("status"),
    )


def deployments(spans: DataFrame, deploy_count_min: int = 500) -> DataFrame:
    """Drives put into service per quarter and model, for counts of at least ``deploy_count_min``.

    A serial number seen under two raw model names is two deployments here.
    """
    return (
        regroup_spans(spans, "model", "serial_number")
        .groupBy(
            quarter_of(F.col("first_date")).alias("deployed_year_quarter"),
            "model",
        )
        .agg(F.count("serial_number").alias("drives"))
        .groupBy(
            "deployed_year_quarter",
            maker_label(F.col("model")).alias("mfr"),
            model_token(F.col("model")).alias("model"),
        )
        .agg(F.sum("drives").alias("drives_deployed_this_qtr"))
        .filter(F.col("drives_deployed_this_qtr") >= deploy_count_min)
    )


def deployments_with_subtotals(spans: DataFrame, deploy_count_min: int = 500) -> DataFrame:
    """``deployments`` plus one row per quarter with the sum of the rows shown for it."""
    quarter, maker, model = "deployed_year_quarter", "mfr", "model"
    return (
        deployments(spans, deploy_count_min)
        .groupingSets([[F.col(quarter), F.col(maker), F.col(model)], [F.col(quarter)]], quarter, maker, model)
        .agg(
            F.sum("drives_deployed_this_qtr").alias("drives_deployed_this_qtr"),
            (F.grouping(model) == 1).alias("is_subtotal"),
        )
    )
