"""Named queries. Doubles are rounded and dates turned to text, so that engines can be compared."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindlewise.contract.parameters import DEPLOY_COUNT_MIN, MIN_DISTRIBUTION, MIN_DRIVES
from spindlewise.fleet import DriveFleet
from spindlewise.operators.shared import CHECKPOINT_SETTING, checkpointed, new_folder
from spindlewise.operators.summary import only_models
from spindlewise.plans import dimensions, snapshots
from spindlewise.sources import bridge
from spindlewise.sources.patterns import FLEET_MODELS
from spindlewise.sources.snapshots import NO_FILE_AGE
from spindlewise.streaming import snapshots as snapshot_stream

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6

#: Of a table that is handed to a stream: rows of a file, batches at least, and files of a batch at most.
PART_ROWS, LEAST_BATCHES, MOST_FILES = 1_000_000, 3, 16


def comparable(df: DataFrame, doubles: tuple[type, ...] = (T.DoubleType, T.DecimalType)) -> DataFrame:
    """The same rows in types that read alike from either engine; exact bytes become text."""

    def plain(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DateType):
            return f"date_format({name}, 'yyyy-MM-dd') AS {name}"
        if isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0:
            return f"CAST({name} AS STRING) AS {name}"
        if isinstance(field.dataType, doubles):
            return f"round(CAST({name} AS DOUBLE), {DIGITS}) AS {name}"
        return name

    return df.selectExpr(*[plain(field) for field in df.schema])


def _fleet(spark: SparkSession, folder: str) -> DriveFleet:
    return DriveFleet(bridge.drive_days(spark, folder))


def _with_folder(spark: SparkSession) -> SparkSession:
    """A session on one machine that names no shared folder, as in tests, gets a temporary one."""
    context = spark.sparkContext
    if context.master.startswith("local") and not (spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spindlewise-"))
    return spark


def stream_parts(table: DataFrame, path: str) -> int:
    """Write all of ``table`` to files for a stream; how many of them are a batch.

    Files and batches grow in number, not in rows, so no task gets more of a larger table.
    """
    files = max(1, -(-table.count() // (PART_ROWS * LEAST_BATCHES)))
    table.repartition(files * LEAST_BATCHES).write.parquet(path)
    return min(files, MOST_FILES)


def _report(method: str, **arguments) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return comparable(getattr(_fleet(spark, folder), method)(**arguments))

    return query


def scan_drive_days(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(bridge.drive_days(spark, folder))


def filter_models_regex(spark: SparkSession, folder: str) -> DataFrame:
    kept = only_models(bridge.drive_days(spark, folder), FLEET_MODELS)
    return comparable(kept.select("date", "model", "serial_number"))


def classify_mfr(spark: SparkSession, folder: str) -> DataFrame:
    return _fleet(spark, folder).brands().fillna("(none)", ["mfr"])


def classify_family(spark: SparkSession, folder: str) -> DataFrame:
    return _fleet(spark, folder).families().fillna("(none)", ["family"])


def afr_wide(spark: SparkSession, folder: str) -> DataFrame:
    # counts too: a model out of service leaves them null
    return comparable(_fleet(_with_folder(spark), folder).afr_wide(MIN_DRIVES), (T.DoubleType, T.LongType))


def afr_layout_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _fleet(spark, folder).afr_layout_stats(MIN_DRIVES).fillna("(all)", ["mfr"])


def deployments_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    return _fleet(spark, folder).deployments_with_subtotals(DEPLOY_COUNT_MIN).fillna("(all)", ["mfr", "model"])


def dim_constraint_checks(spark: SparkSession, folder: str) -> DataFrame:
    fleet = _fleet(_with_folder(spark), folder)
    return dimensions.constraint_checks(checkpointed(fleet.drive_models()), checkpointed(fleet.drives()))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/orders.parquet")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_log(bridge.snapshot_entries(_orders(spark, folder)))


def snapshot_log(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(_log(spark, folder))


def snapshot_latest(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(snapshots.latest_snapshot(_log(spark, folder)))


def snapshot_dates_qtr(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(snapshots.snapshot_calendar(_log(spark, folder)).orderBy(F.desc("year_quarter")))


def snapshot_dates_qtr_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of the first half of the versions, brought up to date with the rest."""
    log = _log(spark, folder)
    half = snapshots.latest_version(log) // 2
    earlier = snapshots.snapshot_calendar(log.filter(F.col("version") <= half))
    return comparable(snapshots.updated_calendar(earlier, log, half))


def snapshot_dates_qtr_stream(spark: SparkSession, folder: str) -> DataFrame:
    # state is one row per quarter: a few partitions are enough
    own = _with_folder(spark).newSession()
    own.conf.set("spark.sql.shuffle.partitions", "4")
    parts = new_folder(spark, "order-parts")
    written = _orders(spark, folder).select("o_orderkey", "o_orderdate")
    files = stream_parts(written, parts)
    orders = (
        own.readStream.schema(written.schema)
        .option("maxFilesPerTrigger", files)
        .option("maxFileAge", NO_FILE_AGE)
        .parquet(parts)
    )
    output = new_folder(spark, "snapshot-calendar")
    snapshot_stream.update_calendar(
        bridge.snapshot_entries(orders),
        output,
        new_folder(spark, "snapshot-calendar-state"),
    )
    return comparable(snapshot_stream.read_calendar(spark, output))


QUERIES: dict[str, Query] = {
    "scan_drive_days": scan_drive_days,
    "filter_models_regex": filter_models_regex,
    "candidate_models": _report("candidate_models"),
    "model_mapping": _report("model_mapping"),
    "classify_mfr": classify_mfr,
    "classify_family": classify_family,
    "afr_quarterly": _report("afr_quarterly"),
    "drive_lifetimes": _report("drive_lifetimes"),
    "drives_deployed_qtr": _report("drives_deployed"),
    "drives_removed_qtr": _report("drives_removed"),
    "afr_enriched": _report("afr_enriched"),
    "afr_cumulative": _report("afr_cumulative", min_drives=MIN_DRIVES),
    "afr_wide": afr_wide,
    "afr_layout_stats": afr_layout_stats,
    "model_date_ranges": _report("model_date_ranges"),
    "models_per_mfr": _report("models_per_maker"),
    "deployments_qtr": _report("deployments", deploy_count_min=DEPLOY_COUNT_MIN),
    "deployments_subtotals": deployments_subtotals,
    "distribution_qtr": _report("distribution", min_drives=MIN_DISTRIBUTION),
    "distribution_totals": _report("distribution_with_totals", min_drives=MIN_DISTRIBUTION),
    "capacity_fleet": _report("capacity"),
    "capacity_by_dc": _report("capacity_by_datacenter"),
    "capacity_dc_report": _report("capacity_datacenter_report"),
    "capacity_by_mfr": _report("capacity_by_maker"),
    "capacity_mfr_report": _report("capacity_maker_report"),
    "dim_drive_models": _report("drive_models"),
    "dim_drives": _report("drives"),
    "dim_constraint_checks": dim_constraint_checks,
    "snapshot_log": snapshot_log,
    "snapshot_latest": snapshot_latest,
    "snapshot_dates_qtr": snapshot_dates_qtr,
    "snapshot_dates_qtr_resumed": snapshot_dates_qtr_resumed,
    "snapshot_dates_qtr_stream": snapshot_dates_qtr_stream,
}
