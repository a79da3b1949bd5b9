import pytest
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.operators.naming import with_model_name
from spindlewise.operators.shared import CHECKPOINT_SETTING, checkpoint_folder, new_folder
from spindlewise.operators.summary import only_models
from spindlewise.schema import MissingColumns, as_drive_days
from spindlewise.sinks.tables import write_drive_quarters, write_report
from spindlewise.sources import bridge
from spindlewise.sources.patterns import FLEET_MODELS, read_families, read_labels, read_patterns
from spindlewise.sources.tables import open_drive_days
from tests.compare import spark_rows
from tests.rows import drive_days

FOLDER = "/root/testdata/sf0.001"

REPORTS = {
    "candidate_models": {},
    "model_mapping": {},
    "brands": {},
    "families": {},
    "afr_quarterly": {},
    "drive_lifetimes": {},
    "drives_deployed": {},
    "drives_removed": {},
    "afr_enriched": {},
    "afr_cumulative": {"min_drives": 10},
    "model_date_ranges": {},
    "models_per_maker": {},
    "deployments_with_subtotals": {"deploy_count_min": 2},
    "distribution_with_totals": {"min_drives": 10},
    "capacity": {},
    "capacity_datacenter_report": {},
    "capacity_by_maker": {},
}


@pytest.fixture(scope="module")
def daily(spark):
    return DriveFleet(bridge.drive_days(spark, FOLDER))


@pytest.fixture(scope="module")
def stored(spark, daily, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("summary") / "drive_quarters")
    write_drive_quarters(daily.summary(), path)
    return DriveFleet(summary=spark.read.parquet(path))


@pytest.mark.parametrize("report", REPORTS)
def test_reports_agree_between_daily_rows_and_stored_summary(daily, stored, report):
    arguments = REPORTS[report]
    assert spark_rows(getattr(stored, report)(**arguments)) == spark_rows(getattr(daily, report)(**arguments))


def test_dimensions_need_the_daily_table(stored):
    with pytest.raises(ValueError):
        stored.drives()


def test_exactly_one_source(daily):
    with pytest.raises(ValueError):
        DriveFleet()
    with pytest.raises(ValueError):
        DriveFleet(daily.drive_days, summary=daily.drive_days)


def test_rewriting_a_quarter_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "drive_quarters")
    model = "ST12000NM0007"
    write_drive_quarters(
        DriveFleet(drive_days(spark, [("2024-01-01", model, "a"), ("2024-04-01", model, "a")])).summary(), path
    )
    refreshed = drive_days(spark, [("2024-04-01", model, "a"), ("2024-04-02", model, "b")])
    write_drive_quarters(DriveFleet(refreshed).summary(), path)
    got = DriveFleet(summary=spark.read.parquet(path)).afr_quarterly().collect()
    assert [(row.quarter, row.qtr_unique_drives_deployed) for row in got] == [(1, 1), (2, 2)]


def test_open_casts_and_prunes(spark, tmp_path):
    path = str(tmp_path / "days")
    spark.sql(
        "SELECT timestamp_ntz'2024-01-01 10:00:00' AS date, 'ST12000NM0007' AS model, 'a' AS serial_number,"
        " 1L AS failure, 5 AS capacity_bytes, 'AMS5' AS datacenter, 7 AS smart_1_raw"
    ).write.parquet(path)
    days = open_drive_days(spark, path)
    assert dict(days.dtypes) == {
        "date": "date",
        "model": "string",
        "serial_number": "string",
        "failure": "int",
        "capacity_bytes": "bigint",
        "datacenter": "string",
    }
    assert DriveFleet.open(spark, path).afr_quarterly().first().qtr_failure_count == 1
    with pytest.raises(ValueError):
        open_drive_days(spark, path, snapshot_id=1)


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumns, match="serial_number"):
        as_drive_days(spark.createDataFrame([("x",)], "model string"), ["model", "serial_number"])


def test_patterns_from_files(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n "\\\\bST1\\\\d$",\n "b"\n]')
    (tmp_path / "labels.json").write_text('{"x+": "one", "a+": "two"}')
    (tmp_path / "families.json").write_text('{"F": ["p", "q"]}')
    (tmp_path / "broken.json").write_text("[1")
    assert read_patterns(spark, str(tmp_path / "list.json")) == [r"\bST1\d$", "b"]
    assert read_labels(spark, str(tmp_path / "labels.json")) == [("x+", "one"), ("a+", "two")]
    assert read_families(spark, str(tmp_path / "families.json")) == {"F": ["p", "q"]}
    with pytest.raises(ValueError):
        read_patterns(spark, str(tmp_path / "broken.json"))
    with pytest.raises(ValueError, match="not a list"):
        read_patterns(spark, str(tmp_path / "labels.json"))


@pytest.mark.parametrize("format, options", [("parquet", {}), ("csv", {"header": "true"})])
def test_reports_are_written_and_replaced(spark, daily, tmp_path, format, options):
    path = str(tmp_path / "report")
    for _ in range(2):
        write_report(daily.afr_wide(10), path, format, **options)
    got = spark.read.format(format).options(**options).load(path)
    assert got.count() > 0 and "Seagate ST12000NM0007_afr" in got.columns


def test_checkpoints_go_to_the_session_folder(spark):
    folder = checkpoint_folder(spark)
    assert folder in spark.sparkContext.getCheckpointDir()
    assert folder == spark.conf.get(CHECKPOINT_SETTING, folder)
    assert new_folder(spark, "run") != new_folder(spark, "run")


def test_daily_rows_may_have_a_column_named_reports(spark):
    days = drive_days(spark, [("2024-01-01", "ST12000NM0007", s) for s in "abc"]).withColumn("reports", F.expr("CASE serial_number WHEN 'a' THEN 0 WHEN 'b' THEN 7 END"))
    assert only_models(days, FLEET_MODELS).count() == 3
    assert with_model_name(days, "drop").count() == 3
    assert DriveFleet(days).afr_quarterly().first().qtr_unique_drives_deployed == 3
