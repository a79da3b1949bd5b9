"""Annualized failure rate (AFR) per model, with fleet churn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.functions.calendar import quarter_text, service_quarter, service_year
from spindlewise.functions.names import maker_of, model_of
from spindlewise.functions.units import annualized_failure_percent
from spindlewise.operators.naming import with_model_name
from spindlewise.operators.newest import newest_in
from spindlewise.operators.shared import checkpointed
from spindlewise.operators.summary import regroup_spans

WIDE_MEASURES = {
    "afr": "afr",
    "afr_delta": "afr_delta",
    "count": "unique_drives_deployed",
    "count_delta": "drives_delta",
    "new": "qtr_new_drives",
    "retired": "qtr_removed_drives",
    "failed": "failure_count",
}


def afr_quarterly(quarters: DataFrame, on_unknown: str = "error") -> DataFrame:
    """Drives, drive-days and failures per normalized model and quarter.

    A missing serial number counts as one drive here.
    """
    keys = ["model_name", "year", "quarter"]
    per_drive = (
        with_model_name(quarters, on_unknown, summary=True)
        .groupBy(*keys, "serial_number")
        .agg(F.sum("drive_days").alias("drive_days"), F.sum("failures").alias("failures"))
    )
    return (
        per_drive.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("qtr_unique_drives_deployed"),
            F.sum("drive_days").alias("qtr_drive_days"),
            F.sum("failures").alias("qtr_failure_count"),
        )
    )


def drive_lifetimes(spans: DataFrame, on_unknown: str = "error") -> DataFrame:
    """First and last day each drive was seen, under its normalized model."""
    lifetimes = regroup_spans(with_model_name(spans, on_unknown, summary=True), "model_name", "serial_number")
    return lifetimes.withColumnsRenamed({"first_date": "first_seen", "last_date": "last_seen"})


def drives_deployed(lifetimes: DataFrame) -> DataFrame:
    """Drives by the quarter they were first seen in."""
    return lifetimes.groupBy(
        "model_name",
        F.year("first_seen").alias("deploy_year"),
        F.quarter("first_seen").alias("deploy_quarter"),
    ).agg(F.count("serial_number").alias("new_drives"))


def drives_removed(lifetimes: DataFrame) -> DataFrame:
    """Drives by the quarter they were last seen in; drives seen on the newest day are still alive."""
    by_day = lifetimes.groupBy("model_name", "last_seen").agg(F.count("serial_number").alias("drives"))
    gone = F.col("last_seen") < newest_in(by_day, "last_seen")
    return (
        by_day.groupBy(
            "model_name",
            F.year("last_seen").alias("remove_year"),
            F.quarter("last_seen").alias("remove_quarter"),
        )
        .agg(F.sum(F.when(gone, F.col("drives"))).alias("removed_drives"))
        .filter(F.col("removed_drives").isNotNull())
    )


def _enriched_with_newest(quarters: DataFrame, on_unknown: str) -> tuple[DataFrame, Column]:
    """``afr_enriched`` and the newest day of the data.

    A drive's first and last quarter are rows of its own history, so deployments and removals
    are marked on those rows and summed with the other measures: one pass over the drive
    histories instead of three aggregations joined by model and quarter.
    """
    history = Window.partitionBy("model_name", "serial_number").orderBy("year", "quarter")
    to_date = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    this_quarter = F.col("year") * 4 + F.col("quarter")
    marked = with_model_name(quarters, on_unknown, summary=True).select(
        "model_name",
        "serial_number",
        "year",
        "quarter",
        "drive_days",
        "failures",
        this_quarter.alias("this"),
        F.lag(this_quarter).over(history).alias("previous"),
        F.row_number().over(history).alias("place"),
        F.lead(F.lit(1)).over(history).isNull().alias("is_last"),
        F.max("last_date").over(to_date).alias("last_seen"),
    )
    is_drive = F.col("serial_number").isNotNull()
    # several rows of one drive and quarter are one drive; rows without a date come first
    opens_quarter = (F.col("place") == 1) | ~F.col("previous").eqNullSafe(F.col("this"))
    is_first = F.col("previous").isNull() & F.col("this").isNotNull()
    by_closing_day = (
        marked.withColumn("closing_day", F.when(F.col("is_last"), F.col("last_seen")))
        .groupBy("model_name", "year", "quarter", "closing_day")
        .agg(
            F.count_if(opens_quarter).alias("drives"),
            F.sum("drive_days").alias("drive_days"),
            F.sum("failures").alias("failures"),
            F.count_if(is_first & is_drive).alias("deployed"),
            F.count_if(F.col("is_last") & is_drive).alias("closed"),
        )
    )
    newest_day = newest_in(by_closing_day, "closing_day")
    removed = F.sum(F.when(F.col("closing_day") < newest_day, F.col("closed")))
    enriched = by_closing_day.groupBy("model_name", "year", "quarter").agg(
        F.sum("deployed").alias("qtr_new_drives"),
        F.sum("drives").alias("qtr_unique_drives_deployed"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("qtr_removed_drives"),
        F.sum("failures").alias("qtr_failure_count"),
        F.sum("drive_days").alias("qtr_drive_days"),
    )
    return enriched, newest_day


def afr_enriched(quarters: DataFrame, on_unknown: str = "error") -> DataFrame:
    """``afr_quarterly`` with the drives deployed and removed in each quarter."""
    enriched, _ = _enriched_with_newest(quarters, on_unknown)
    return enriched


def afr_cumulative(quarters: DataFrame, min_drives: int = 2000, on_unknown: str = "error") -> DataFrame:
    """Failure rate to date per model and quarter, for quarters with at least ``min_drives``.

    Quarters below the minimum still count toward the running totals; they are dropped before
    deltas and service quarters are numbered. In the newest quarter of the data, where no
    removal can be told from a pause yet, the failures stand in for the removed drives.
    """
    enriched, newest_day = _enriched_with_newest(quarters, on_unknown)
    history = Window.partitionBy("model_name").orderBy("year", "quarter")
    to_date = history.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_newest = (F.col("year") == F.year(newest_day)) & (F.col("quarter") == F.quarter(newest_day))

    kept = (
        enriched.withColumns(
            {
                "days_to_date": F.sum("qtr_drive_days").over(to_date),
                "failures_to_date": F.sum("qtr_failure_count").over(to_date),
            }
        )
        .filter(F.col("qtr_unique_drives_deployed") >= min_drives)
        .withColumn("afr", annualized_failure_percent(F.col("failures_to_date"), F.col("days_to_date")))
        .withColumn("ordinal", F.row_number().over(history))
    )
    drives = F.col("qtr_unique_drives_deployed")
    return kept.select(
        maker_of(F.col("model_name")).alias("mfr"),
        model_of(F.col("model_name")).alias("model"),
        quarter_text(F.col("year"), F.col("quarter")).alias("year_quarter"),
        service_year(F.col("ordinal")).alias("service_year"),
        service_quarter(F.col("ordinal")).alias("service_quarter"),
        "afr",
        (F.col("afr") - F.lag("afr", 1, 0.0).over(history)).alias("afr_delta"),
        drives.alias("unique_drives_deployed"),
        (drives - F.lag(drives, 1, 0).over(history)).alias("drives_delta"),
        "qtr_new_drives",
        F.when(is_newest, F.col("qtr_failure_count")).otherwise(F.col("qtr_removed_drives")).alias("qtr_removed_drives"),
        F.col("qtr_failure_count").alias("failure_count"),
    )


def afr_wide(cumulative: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One row per quarter of service, seven columns per model; models out of service are null.

    Without ``models`` the names are looked up first, from a checkpoint of the (small) input so
    that the fleet is not summarized twice.
    """
    if models is None:
        cumulative = checkpointed(cumulative)
        names = cumulative.select("mfr", "model").distinct().orderBy("mfr", "model").collect()
        models = [f"{row.mfr} {row.model}" for row in names]
    cells = [F.first(column).alias(measure) for measure, column in WIDE_MEASURES.items()]
    return (
        cumulative.withColumn("model_name", F.concat_ws(" ", "mfr", "model"))
        .groupBy("service_year", "service_quarter")
        .pivot("model_name", list(models))
        .agg(*cells)
    )


def afr_layout_stats(cumulative: DataFrame) -> DataFrame:
    """Models and longest history per maker, and over all makers in the row without a maker."""
    per_model = cumulative.groupBy("mfr", "model").agg(F.count(F.lit(1)).alias("quarters"))
    return per_model.rollup("mfr").agg(
        F.count(F.lit(1)).alias("models"), F.max("quarters").alias("longest_history")
    )
