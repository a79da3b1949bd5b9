import pytest
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.sources import bridge
from tests.rows import day, dicts, drive_days

A, B = "ST12000NM0007", "HGST HUH721212ALE604"
FOLDER = "/root/testdata/sf0.01"


def fleet(spark, rows):
    return DriveFleet(drive_days(spark, rows))


def test_missing_failure_flags(spark):
    reports = fleet(spark, [("2024-01-01", A, "a", None), ("2024-01-02", A, "a", None)])
    row = reports.afr_quarterly().first()
    assert (row.qtr_failure_count, row.qtr_drive_days, row.qtr_unique_drives_deployed) == (0, 0, 1)
    assert reports.afr_cumulative(1).first().afr is None


def test_missing_serial_is_a_drive_in_rates_only(spark):
    reports = fleet(spark, [("2024-01-01", A, None), ("2024-01-02", A, None), ("2024-01-01", A, "a"), ("2024-05-01", A, "a")])
    assert [row.qtr_unique_drives_deployed for row in reports.afr_quarterly().collect()] == [2, 1]
    enriched = dicts(reports.afr_enriched())
    assert [row["qtr_unique_drives_deployed"] for row in enriched] == [2, 1]
    assert [row["qtr_new_drives"] for row in enriched] == [1, 0]
    assert [row["qtr_removed_drives"] for row in enriched] == [0, 0]
    assert [row.unique_serial_numbers for row in reports.distribution().collect()] == [1, 1]


def quarter_rows(start, model, days, failures, drives=1):
    """``days`` rows in the quarter, spread over ``drives`` serials."""
    return [(start, model, f"{model}-{i % drives}", 1 if i < failures else 0) for i in range(days)]


def test_dropped_quarters_still_count_toward_totals(spark):
    rows = (
        quarter_rows("2023-01-05", A, 100, 1, drives=2)
        + quarter_rows("2023-04-05", A, 10, 1, drives=1)
        + quarter_rows("2023-07-05", A, 100, 0, drives=2)
    )
    first, third = dicts(fleet(spark, rows).afr_cumulative(min_drives=2))
    assert first["afr"] == pytest.approx(1 / 100 * 365 * 100)
    assert third["afr"] == pytest.approx(2 / 210 * 365 * 100)
    assert first["afr_delta"] == first["afr"]
    assert third["afr_delta"] == pytest.approx(third["afr"] - first["afr"])
    assert (first["service_year"], first["service_quarter"]) == (1, 1)
    assert (third["service_year"], third["service_quarter"], third["year_quarter"]) == (1, 2, "2023 Q3")
    assert (first["drives_delta"], third["drives_delta"]) == (2, 0)


def test_gap_years_close_up_and_five_quarters_make_a_second_year(spark):
    rows = [(f"{year}-{month:02d}-01", A, "a") for year, month in [(2020, 1), (2021, 1), (2021, 5), (2021, 8), (2021, 11)]]
    got = dicts(fleet(spark, rows).afr_cumulative(1))
    assert [(row["service_year"], row["service_quarter"]) for row in got] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]


def test_newest_quarter_shows_failures_as_removed(spark):
    rows = [
        ("2024-01-01", A, "a", 1),
        ("2024-01-01", A, "b"),
        ("2024-04-01", A, "b", 1),
        ("2024-04-02", A, "c", 1),
        ("2024-06-01", B, "d"),
        ("2024-01-01", B, "e"),
    ]
    got = {(row["model"], row["year_quarter"]): row for row in dicts(fleet(spark, rows).afr_cumulative(1))}
    assert got[("ST12000NM0007", "2024 Q1")]["qtr_removed_drives"] == 1
    assert got[("ST12000NM0007", "2024 Q2")]["qtr_removed_drives"] == 2  # two failures
    assert got[("HUH721212ALE604", "2024 Q1")]["qtr_removed_drives"] == 1
    assert got[("HUH721212ALE604", "2024 Q2")]["qtr_removed_drives"] == 0
    enriched = {(row["model_name"], row["quarter"]): row["qtr_removed_drives"] for row in dicts(fleet(spark, rows).afr_enriched())}
    assert enriched == {
        ("Seagate ST12000NM0007", 1): 1,
        ("Seagate ST12000NM0007", 2): 2,
        ("WDC/HGST HUH721212ALE604", 1): 1,
        ("WDC/HGST HUH721212ALE604", 2): 0,  # seen on the newest day
    }


def test_newest_quarter_is_found_before_the_minimum(spark):
    # the newest quarter has too few drives to be shown; the row before it keeps its removals
    rows = [("2024-01-01", A, "a", 1), ("2024-01-01", A, "b"), ("2024-04-01", A, "b")]
    (row,) = dicts(fleet(spark, rows).afr_cumulative(2))
    assert row["qtr_removed_drives"] == 1


def test_drives_alive_on_the_last_day_are_not_removed(spark):
    rows = [("2024-01-01", A, "a"), ("2024-03-31", A, "b"), ("2024-02-01", B, "c")]
    got = {(row.model_name, row.remove_quarter): row.removed_drives for row in fleet(spark, rows).drives_removed().collect()}
    assert got == {("Seagate ST12000NM0007", 1): 1, ("WDC/HGST HUH721212ALE604", 1): 1}


def test_two_raw_names_of_one_drive(spark):
    rows = [("2024-01-01", "HGST HUH721212ALE604", "a"), ("2024-02-01", "WDC HUH721212ALE604", "a"), ("2024-03-01", A, "b")]
    reports = fleet(spark, rows)
    assert {row.model_name: row.qtr_unique_drives_deployed for row in reports.afr_quarterly().collect()} == {
        "WDC/HGST HUH721212ALE604": 1,
        "Seagate ST12000NM0007": 1,
    }
    enriched = {row["model_name"]: row for row in dicts(reports.afr_enriched())}["WDC/HGST HUH721212ALE604"]
    assert (enriched["qtr_unique_drives_deployed"], enriched["qtr_new_drives"], enriched["qtr_removed_drives"]) == (1, 1, 1)
    assert enriched["qtr_drive_days"] == 2
    (lifetime,) = reports.drive_lifetimes().filter(F.col("serial_number") == "a").collect()
    assert (lifetime.first_seen, lifetime.last_seen) == (day("2024-01-01"), day("2024-02-01"))
    assert {(row.model, row.drives_deployed_this_qtr) for row in reports.deployments(2).collect()} == {("HUH721212ALE604", 2)}


def test_rows_without_a_date_open_no_quarter(spark):
    rows = [(None, A, "a"), (None, "Seagate " + A, "a"), ("2024-01-01", A, "a"), ("2024-04-01", A, "b"), (None, A, "c")]
    got = {
        (r["year"], r["quarter"]): (r["qtr_unique_drives_deployed"], r["qtr_new_drives"], r["qtr_removed_drives"])
        for r in dicts(fleet(spark, rows).afr_enriched())
    }
    assert got == {(None, None): (2, 0, 0), (2024, 1): (1, 1, 1), (2024, 2): (1, 1, 0)}


def test_wide_finds_its_models(spark):
    rows = [("2024-01-01", A, "a"), ("2024-04-01", A, "a"), ("2024-04-01", B, "b")]
    wide = fleet(spark, rows).afr_wide(1)
    assert wide.columns[:2] == ["service_year", "service_quarter"]
    assert len(wide.columns) == 2 + 2 * 7
    first, second = dicts(wide)
    assert first["Seagate ST12000NM0007_count"] == 1 and first["WDC/HGST HUH721212ALE604_count"] == 1
    assert second["Seagate ST12000NM0007_afr"] == 0.0 and second["WDC/HGST HUH721212ALE604_afr"] is None


def test_layout_stats(spark):
    rows = [("2024-01-01", A, "a"), ("2024-04-01", A, "a"), ("2024-04-01", B, "b")]
    got = [tuple(row) for row in fleet(spark, rows).afr_layout_stats(1).collect()]
    assert got == [("Seagate", 1, 2), ("WDC/HGST", 1, 1), (None, 2, 2)]


def test_sums_agree_over_the_test_fleet(spark):
    days = bridge.drive_days(spark, FOLDER)
    reports = DriveFleet(days)
    lifetimes = reports.drive_lifetimes()
    enriched = reports.afr_enriched()
    new, removed, drive_days_total = enriched.agg(
        F.sum("qtr_new_drives"), F.sum("qtr_removed_drives"), F.sum("qtr_drive_days")
    ).first()
    assert new == lifetimes.count()
    newest = lifetimes.agg(F.max("last_seen")).first()[0]
    assert removed == lifetimes.filter(F.col("last_seen") < newest).count()
    mapping = reports.model_mapping()
    assert drive_days_total == days.join(mapping, days.model == mapping.drive_model_name_smart).count()
    shares = reports.capacity_by_maker().groupBy("year", "quarter").agg(F.sum("share_pct").alias("all"))
    assert shares.filter(F.abs(F.col("all") - 100) > 1e-9).count() == 0


@pytest.mark.parametrize("report", ["drives_deployed", "drives_removed"])
def test_enriched_equals_joined_parts(spark, report):
    reports = DriveFleet(bridge.drive_days(spark, FOLDER))
    part = {tuple(row)[:3]: tuple(row)[3] for row in getattr(reports, report)().collect()}
    column = {"drives_deployed": "qtr_new_drives", "drives_removed": "qtr_removed_drives"}[report]
    enriched = {(r["model_name"], r["year"], r["quarter"]): r[column] for r in dicts(reports.afr_enriched())}
    assert {key: count for key, count in enriched.items() if count} == {key: count for key, count in part.items() if count}
