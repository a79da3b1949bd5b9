"""More named queries: reports from stores that are filled bit by bit, and other ways to the same results.

Most have the SQL of the report they must equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.contract.oracles import _AFR, CALENDAR, DAYS, MAKER, ORACLES, SNAPSHOTS, WIDE_MEASURES, _with
from spindlewise.contract.parameters import MIN_DRIVES
from spindlewise.contract.queries import Query, _fleet, _orders, _with_folder, comparable, stream_parts
from spindlewise.fleet import DriveFleet
from spindlewise.functions.calendar import quarter_text
from spindlewise.functions.names import maker_label
from spindlewise.operators.pattern_index import first_labels
from spindlewise.operators.shared import new_folder
from spindlewise.operators.summary import drive_quarters
from spindlewise.plans.afr_map import wide_cells
from spindlewise.plans.drive_sets import DriveSets
from spindlewise.schema import as_drive_days
from spindlewise.sinks.snapshot_ledger import SnapshotLedger
from spindlewise.sinks.summary_store import SummaryStore
from spindlewise.sinks.tables import merge_dimensions, write_report
from spindlewise.sources import bridge
from spindlewise.sources.patterns import BRANDS, FAMILIES
from spindlewise.streaming.fleet_summary import update_summary

SPLIT_DAY = "1998-07-01"


def afr_wide_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The wide table as it reads back from where it was written."""
    path = new_folder(_with_folder(spark), "wide-report")
    write_report(_fleet(spark, folder).afr_wide(MIN_DRIVES), path)
    stored = spark.read.parquet(path)
    counts = [name for name, kind in stored.dtypes if kind == "bigint"]  # null where a model is out of service
    return comparable(stored.withColumns({name: F.col(f"`{name}`").cast("double") for name in counts}))


def afr_wide_map(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(wide_cells(_fleet(spark, folder).afr_wide_map(MIN_DRIVES)))


def afr_quarterly_narrowed(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(DriveFleet(bridge.drive_days(spark, folder), model_pass=True).afr_quarterly())


def afr_cumulative_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """From a store that got the early days, then all days (of which it has those), was merged, and got all days again."""
    store = SummaryStore(spark, new_folder(_with_folder(spark), "summary-store"))
    days = bridge.drive_days(spark, folder)
    store.add(days.filter(F.col("date") < SPLIT_DAY))
    store.add(days)
    store.compact()
    store.add(days)
    return comparable(DriveFleet(summary=store.summary()).afr_cumulative(MIN_DRIVES))


def capacity_by_dc_stream(spark: SparkSession, folder: str) -> DataFrame:
    """From a store that a stream of daily rows fills, a part of the table in each batch."""
    parts = new_folder(_with_folder(spark), "daily-parts")
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    files = stream_parts(lineitem, parts)
    stream = spark.readStream.schema(lineitem.schema).option("maxFilesPerTrigger", files).parquet(parts)
    store = SummaryStore(spark, new_folder(spark, "summary-store"))
    update_summary(as_drive_days(spark.sql(bridge.DRIVE_DAYS_SQL, lineitem=stream)), store, new_folder(spark, "summary-stream"))
    return comparable(DriveFleet(summary=store.summary()).capacity_by_datacenter())


def snapshot_dates_qtr_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """From a ledger that got the higher versions first, so that most files arrive late under lower numbers."""
    entries = bridge.snapshot_entries(_orders(spark, folder))
    ledger = SnapshotLedger(spark, new_folder(_with_folder(spark), "snapshot-ledger"))
    ledger.add(entries.filter(F.crc32(F.col("file_name").cast("binary")) % 3 == 0))
    ledger.add(entries)
    return comparable(ledger.calendar())


def capacity_by_dc_digits(spark: SparkSession, folder: str) -> DataFrame:
    return comparable(_fleet(_with_folder(spark), folder).capacity_by_datacenter(large_groups=True))


def _labels(spark: SparkSession, folder: str, labelled: list[tuple[str, str]], label: str) -> DataFrame:
    table = spark.createDataFrame([(k, *pair) for k, pair in enumerate(labelled)], "prio int, pattern string, label string")
    found = first_labels(bridge.drive_days(spark, folder), table)
    return found.withColumnRenamed("label", label).fillna("(none)", [label])


def classify_mfr_table(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder, BRANDS, "mfr")


def classify_family_table(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder, [(pattern, family) for family, patterns in FAMILIES.items() for pattern in patterns], "family")


def dim_drives_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The drive table after the early days and then all days were merged into it."""
    path = new_folder(_with_folder(spark), "dimensions")
    days = bridge.drive_days(spark, folder)
    for some in (days.filter(F.col("date") < SPLIT_DAY), days):
        fleet = DriveFleet(some)
        merge_dimensions(fleet.drive_models().select("drive_model_id", "drive_model_smart", F.lit(1).alias("capacity_tb")), fleet.drives(), path)
    return spark.read.parquet(f"{path}/drives")


def distinct_drives_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct drives by year, by maker and quarter, by datacenter, and of all, from sets built in two steps."""
    sets = DriveSets(spark, new_folder(_with_folder(spark), "drive-sets"))
    days = bridge.drive_days(spark, folder)
    for some in (days.filter(F.col("date") < SPLIT_DAY), days.filter(F.col("date") >= SPLIT_DAY)):
        sets.add(drive_quarters(some, ["datacenter"]))
    quarter = quarter_text(F.col("year"), F.col("quarter"))
    spans = {
        "year": F.col("year").cast("string"),
        "maker and quarter": F.concat_ws(" ", maker_label(F.col("model")), quarter),
        "datacenter": F.coalesce("datacenter", F.lit("(none)")),
        "all": F.lit("(all)"),
    }
    counts = [sets.count(name.alias("name")).select(F.lit(span).alias("span"), "name", "drives") for span, name in spans.items()]
    return reduce(DataFrame.unionByName, counts)


QUERIES: dict[str, Query] = {
    "afr_wide_stored": afr_wide_stored,
    "afr_wide_map": afr_wide_map,
    "afr_quarterly_narrowed": afr_quarterly_narrowed,
    "afr_cumulative_incremental": afr_cumulative_incremental,
    "capacity_by_dc_stream": capacity_by_dc_stream,
    "snapshot_dates_qtr_ledger": snapshot_dates_qtr_ledger,
    "capacity_by_dc_digits": capacity_by_dc_digits,
    "classify_mfr_table": classify_mfr_table,
    "classify_family_table": classify_family_table,
    "dim_drives_merged": dim_drives_merged,
    "distinct_drives_spans": distinct_drives_spans,
}

ORACLES: dict[str, str] = {
    "afr_wide_stored": ORACLES["afr_wide"],
    "afr_wide_map": _with(
        *_AFR,
        select=f"""SELECT service_year, service_quarter,
  row_number() OVER (PARTITION BY service_year, service_quarter ORDER BY mfr || ' ' || model) AS position,
  mfr || ' ' || model AS model_name, {", ".join(f"{column} AS {measure}" for measure, column in WIDE_MEASURES.items())} FROM cumulative""",
    ),
    "afr_quarterly_narrowed": ORACLES["afr_quarterly"],
    "afr_cumulative_incremental": ORACLES["afr_cumulative"],
    "capacity_by_dc_stream": ORACLES["capacity_by_dc"],
    "snapshot_dates_qtr_ledger": _with(SNAPSHOTS, select=CALENDAR),
    "capacity_by_dc_digits": ORACLES["capacity_by_dc"],
    "classify_mfr_table": ORACLES["classify_mfr"],
    "classify_family_table": ORACLES["classify_family"],
    "dim_drives_merged": ORACLES["dim_drives"],
    "distinct_drives_spans": _with(
        DAYS,
        select=" UNION ALL ".join(
            f"SELECT '{span}' AS span, {name} AS name, count(DISTINCT serial_number) AS drives FROM drive_days GROUP BY ALL"
            for span, name in {
                "year": "CAST(year(date) AS VARCHAR)",
                "maker and quarter": f"({MAKER}) || ' ' || year(date) || ' Q' || quarter(date)",
                "datacenter": "coalesce(datacenter, '(none)')",
                "all": "'(all)'",
            }.items()
        ),
    ),
}
