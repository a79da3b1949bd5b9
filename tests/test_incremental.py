"""Stores that are filled bit by bit equal what one pass over everything gives."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.operators.summary import OPTIONAL_KEYS, drive_quarters
from spindlewise.sinks.snapshot_ledger import SnapshotLedger
from spindlewise.sinks.summary_store import SummaryStore, merged
from spindlewise.sources import bridge
from spindlewise.sources.snapshots import broken_snapshot_files, read_snapshot_files
from spindlewise.streaming.fleet_summary import update_summary
from tests.compare import spark_rows
from tests.rows import drive_days
from tests.test_plans import settled_stages
from tests.test_snapshots import ALL, EARLIER, LATER, rows, write_files

FOLDER = "/root/testdata/sf0.001"
SEAGATE = "ST12000NM0007"


@pytest.fixture
def store(spark, tmp_path):
    return SummaryStore(spark, str(tmp_path / "store"))


def one_pass(days):
    return spark_rows(drive_quarters(days, OPTIONAL_KEYS))


def test_day_by_day_equals_one_pass(spark, store):
    days = drive_days(
        spark,
        [(f"2024-{month:02}-{day:02}", model, serial, day % 2, 12_000 + day, dc) for month in (1, 3, 4) for day in (1, 2, 3)
         for model, serial, dc in ((SEAGATE, "a", "AMS5"), (SEAGATE, "b", None), ("WUH721816ALE6L4", None, "phx1"))],
    )
    for month in (4, 1, 3):  # late days too
        assert store.add(days.filter(F.month("date") == month)) == 3
        assert store.add(days.filter(F.month("date") == month)) == 0
    columns = drive_quarters(days, OPTIONAL_KEYS).columns
    assert spark_rows(merged(store.summary()).select(columns)) == one_pass(days)
    assert store.loads() == [1, 2, 3]
    store.compact()
    assert store.loads() == [4] and store.add(days) == 0
    assert spark_rows(store.summary().select(columns)) == one_pass(days)


@pytest.mark.parametrize("report", ["afr_cumulative", "drives_removed", "distribution_with_totals", "capacity", "capacity_datacenter_report", "capacity_by_maker"])
def test_reports_from_loads_equal_reports_from_days(spark, store, report):
    arguments = {"afr_cumulative": {"min_drives": 5}}.get(report, {})
    days = bridge.drive_days(spark, FOLDER)
    store.add(days.filter(F.year("date") < 1997))
    store.add(days.filter(F.year("date") < 2000))
    store.add(days)
    got = getattr(DriveFleet(summary=store.summary()), report)(**arguments)
    assert spark_rows(got) == spark_rows(getattr(DriveFleet(days), report)(**arguments))


def test_only_new_days_are_read(spark, store, tmp_path):
    """The table is stored by day, as such tables are; the days in the store cost a look at the date column only."""
    path = str(tmp_path / "days")
    days = bridge.drive_days(spark, FOLDER).orderBy("date").coalesce(1)
    days.write.option("parquet.block.size", 32 * 1024).option("parquet.page.row.count.limit", 100).parquet(path)
    table = spark.read.parquet(path)
    newest = table.agg(F.max("date")).first()[0]
    store.add(table.filter(F.col("date") < newest))
    before = settled_stages(spark)
    assert store.add(table) == 1
    new = [n for stage, n in settled_stages(spark).items() if stage not in before]
    assert sorted(new)[-1] <= table.count() and sum(n > table.count() // 2 for n in new) <= 1  # the date column, once


def test_rows_without_a_date_are_one_day(spark, store):
    days = drive_days(spark, [(None, SEAGATE, "a"), ("2024-01-01", SEAGATE, "a")])
    assert store.add(days) == 2 and store.add(days) == 0
    assert sorted((r.year, r.reports) for r in store.summary().fillna(0, ["year"]).collect()) == [(0, 1), (2024, 1)]


def test_an_empty_store_and_an_empty_table(spark, store):
    assert store.summary().count() == 0 and store.loads() == []
    store.compact()
    assert store.add(drive_days(spark, [])) == 0
    assert DriveFleet(summary=store.summary()).afr_quarterly().count() == 0


def test_a_load_that_broke_off_is_written_again(spark, store, monkeypatch):
    days = drive_days(spark, [("2024-01-01", SEAGATE, "a")])
    make = spark.createDataFrame

    def fail(*_, **__):
        raise RuntimeError("lost before the ledger was written")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: fail() if data else make(data, *a, **k))
        with pytest.raises(RuntimeError):
            store.add(days)
    assert store.summary().count() == 0
    assert store.add(days) == 1
    assert [row.reports for row in store.summary().collect()] == [1]


def test_merging_again_removes_what_the_last_merge_replaced(spark, store, tmp_path):
    for day in (1, 2, 3):
        store.add(drive_days(spark, [(f"2024-01-0{day}", SEAGATE, "a")]))
        store.compact()
    assert [(row.reports, row.first_date.day, row.last_date.day) for row in store.summary().collect()] == [(3, 1, 3)]
    assert sorted(p.name for p in (tmp_path / "store" / "states").iterdir()) == ["load=4", "load=5", "load=6"]


def test_a_replayed_batch_counts_once(spark, store, tmp_path):
    parts = str(tmp_path / "parts")
    days = drive_days(spark, [("2024-01-01", SEAGATE, "a"), ("2024-01-01", SEAGATE, "a"), ("2024-01-02", SEAGATE, "b")])
    days.repartition(3).write.parquet(parts)
    for state in ("one", "one", "two"):  # the second run finds nothing new, the third has lost its checkpoint
        stream = spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(parts)
        update_summary(stream, store, str(tmp_path / state))
    assert spark_rows(merged(store.summary()).select(drive_quarters(days, OPTIONAL_KEYS).columns)) == one_pass(days)


# snapshot files


def test_late_and_unnumbered_files_arrive(spark, tmp_path):
    ledger = SnapshotLedger(spark, str(tmp_path / "ledger"))
    folder = tmp_path / "m"
    assert rows(ledger.calendar()) == []
    write_files(folder, LATER)
    assert ledger.add_folder(str(folder)) == 2
    write_files(folder, EARLIER)
    write_files(folder, {"latest.metadata.json": "2024-07-01T00:00:00"})
    assert ledger.add_folder(str(folder)) == 3 and ledger.add_folder(str(folder)) == 0
    assert rows(ledger.calendar()) == [*ALL, ("2024 Q3", "2024-07-01", "2024-07-01")]
    assert ledger.log().count() == 5


def test_a_file_in_the_record_is_not_opened(spark, tmp_path):
    ledger, folder = SnapshotLedger(spark, str(tmp_path / "ledger")), tmp_path / "m"
    write_files(folder, EARLIER)
    ledger.add_folder(str(folder))
    for name in EARLIER:  # were they opened, these would be other days
        (folder / name).write_text(json.dumps({"last-updated-ms": 0}))
    write_files(folder, LATER)
    ledger.add_folder(str(folder))
    assert rows(ledger.calendar()) == ALL


def test_broken_documents_are_reported_and_tried_again(spark, tmp_path):
    folder = tmp_path / "m"
    write_files(folder, EARLIER)
    broken = {"00004-x": '{"last-updated-ms": 17', "00005-x": "", "00006-x": '{"other": 1}', "00007-x": '{"last-updated-ms": "soon"}'}
    for name, text in broken.items():
        (folder / f"{name}.metadata.json").write_text(text)
    assert {row.file_name for row in read_snapshot_files(spark, str(folder)).collect()} == set(EARLIER)
    reported = {row.file_name[:7]: (row.reason, row.document) for row in broken_snapshot_files(spark, str(folder)).collect()}
    assert set(reported) == set(broken)
    assert reported["00004-x"] == ("cannot be parsed", broken["00004-x"]) and reported["00005-x"][0] == "cannot be parsed"
    assert reported["00006-x"][0] == "no last-updated-ms"

    ledger = SnapshotLedger(spark, str(tmp_path / "ledger"))
    assert ledger.add_folder(str(folder)) == 5 and ledger.log().count() == 2  # an empty file has nothing to open
    write_files(folder, {"00004-x.metadata.json": "2024-12-31T00:00:00"})
    ledger.add_folder(str(folder))
    assert ("2024 Q4", "2024-12-31", "2024-12-31") in rows(ledger.calendar())
    assert datetime.date(2024, 12, 31) in [row.snapshot_date for row in ledger.log().collect()]
