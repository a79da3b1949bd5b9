import datetime
import json

from spindlewise.plans.snapshots import latest_snapshot, latest_version, snapshot_calendar, snapshot_log, updated_calendar
from spindlewise.sources.snapshots import read_snapshot_files, stream_snapshot_files
from spindlewise.streaming.snapshots import read_calendar, update_calendar

EARLIER = {
    "00001-aa.metadata.json": "2024-01-10T00:00:00",
    "00002-bb.metadata.json": "2024-03-31T23:59:59.999",
}
LATER = {
    "00003-cc.metadata.json": "2024-02-01T12:00:00",
    "00010-dd.metadata.json": "2024-04-01T00:00:00",
}


def millis(text):
    moment = datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc)
    return round(moment.timestamp() * 1000)


def write_files(folder, files):
    folder.mkdir(exist_ok=True)
    for name, moment in files.items():
        document = {"format-version": 2, "last-updated-ms": millis(moment), "schemas": [{"id": 0}]}
        (folder / name).write_text(json.dumps(document, indent=2))


def rows(df):
    return sorted((row.year_quarter, row.date_min.isoformat(), row.date_max.isoformat()) for row in df.collect())


ALL = [("2024 Q1", "2024-01-10", "2024-03-31"), ("2024 Q2", "2024-04-01", "2024-04-01")]


def test_files_become_a_log(spark, tmp_path):
    folder = tmp_path / "metadata"
    write_files(folder, EARLIER | LATER)
    (folder / "snap-1.avro").write_text("not metadata")
    (folder / "v1.json").write_text("{}")
    log = snapshot_log(read_snapshot_files(spark, str(folder)))
    assert {row.file_name: row.version for row in log.collect()} == {name: int(name[:5]) for name in EARLIER | LATER}
    assert rows(snapshot_calendar(log)) == ALL
    latest = latest_snapshot(log).first()
    assert (latest.file_name, latest.snapshot_date.isoformat()) == ("00010-dd.metadata.json", "2024-04-01")
    assert latest_version(log) == 10


def test_paths_are_cut_to_names_and_other_files_dropped(spark):
    entries = spark.createDataFrame(
        [("bucket/table/metadata/00007-x.metadata.json", 0), ("bucket/00008-x.avro", 0)],
        "file_name string, last_updated_ms bigint",
    )
    (row,) = snapshot_log(entries).collect()
    assert (row.file_name, row.version, row.snapshot_date.isoformat()) == ("00007-x.metadata.json", 7, "1970-01-01")


def test_day_is_utc_in_any_session_zone(spark):
    entries = spark.createDataFrame([("1.metadata.json", millis("2024-03-31T23:59:59"))], "file_name string, last_updated_ms bigint")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    own_entries = own.createDataFrame(entries.collect(), entries.schema)
    assert snapshot_log(own_entries).first().snapshot_date.isoformat() == "2024-03-31"


def test_resumed_calendar_reads_new_versions_only(spark, tmp_path):
    write_files(tmp_path / "m", EARLIER)
    first = snapshot_log(read_snapshot_files(spark, str(tmp_path / "m")))
    calendar, mark = spark.createDataFrame(snapshot_calendar(first).collect()), latest_version(first)
    assert mark == 2
    write_files(tmp_path / "m", LATER)
    everything = snapshot_log(read_snapshot_files(spark, str(tmp_path / "m")))
    assert rows(updated_calendar(calendar, everything, mark)) == ALL
    assert rows(updated_calendar(calendar.limit(0), everything, 3)) == ALL[1:]
    assert rows(updated_calendar(calendar.limit(0), everything, None)) == ALL


def test_two_streamed_runs_equal_one_batch(spark, tmp_path):
    folder, output, state = tmp_path / "m", str(tmp_path / "calendar"), str(tmp_path / "state")
    write_files(folder, EARLIER)
    update_calendar(stream_snapshot_files(spark, str(folder)), output, state)
    assert rows(read_calendar(spark, output)) == [("2024 Q1", "2024-01-10", "2024-03-31")]
    write_files(folder, LATER)
    update_calendar(stream_snapshot_files(spark, str(folder)), output, state)
    assert rows(read_calendar(spark, output)) == ALL
    for day in (2, 3):  # the newest calendar and the one before it stay
        write_files(folder, {f"0001{day}-ee.metadata.json": f"2024-02-0{day}T00:00:00"})
        update_calendar(stream_snapshot_files(spark, str(folder)), output, state)
    assert len(list((tmp_path / "calendar").glob("batch=*"))) == 2
    # nothing new: the calendar stays
    update_calendar(stream_snapshot_files(spark, str(folder)), output, state)
    assert rows(read_calendar(spark, output)) == ALL


def test_versions_are_numbers(spark):
    day = 86_400_000
    names = ["99998-a", "99999-b", "100000-c"]
    entries = spark.createDataFrame(
        [(f"{name}.metadata.json", (19_800 + 100 * k) * day) for k, name in enumerate(names)], "file_name string, last_updated_ms long"
    )
    log = snapshot_log(entries)
    assert latest_snapshot(log).first().version == latest_version(log) == 100_000
    earlier = snapshot_calendar(log.filter("version < 100000"))
    assert rows(updated_calendar(earlier, log, 99_999)) == rows(snapshot_calendar(log))
