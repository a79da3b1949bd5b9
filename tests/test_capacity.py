import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.functions.units import exact_terabytes
from spindlewise.operators.capacity import with_doubled_median, with_mode
from spindlewise.operators.summary import drive_quarters
from tests.rows import TB, dicts, drive_days

A, B = "ST12000NM0007", "HGST HUH721212ALE604"


def capacities(spark, values, drives=None):
    """One report per value; drive i reports value i unless ``drives`` says otherwise."""
    serials = drives or [f"s{i}" for i in range(len(values))]
    return drive_days(spark, [("2024-01-01", A, serial, 0, value) for serial, value in zip(serials, values)])


def mode_and_median(spark, days):
    keys = ["year", "quarter", "model"]
    quarters = drive_quarters(days, ["capacity_bytes"])
    mode = with_mode(quarters, keys).first()
    median = with_doubled_median(quarters, keys).first()
    assert mode.drives == median.drives
    return mode.model_capacity, median.doubled_capacity, mode.drives


@pytest.mark.parametrize(
    "values, mode, median",
    [
        ([3, 1, 3, 1], 1, 2.0),
        ([None, None, None, 3], 3, 3.0),
        ([1, 2, 4, 9], 1, 3.0),
        ([5], 5, 5.0),
        ([1, 2], 1, 1.5),
        ([-1, 7, 7], 7, 7.0),
        ([None], None, None),
        ([9223372036854775807, 9223372036854775807], 9223372036854775807, 9223372036854775807.0),
    ],
)
def test_mode_and_median(spark, values, mode, median):
    got_mode, doubled, drives = mode_and_median(spark, capacities(spark, values))
    assert got_mode == mode
    assert (None if doubled is None else float(doubled) / 2) == median
    assert drives == len(values)


def test_mode_and_median_of_random_values(spark):
    generator = random.Random(7)
    rows, expected = [], {}
    for number in range(40):
        model = f"ST12000NM{number:04d}"
        values = [generator.randint(1, 6) for _ in range(generator.randint(1, 30))]
        rows += [("2024-01-01", model, f"s{i}", 0, value) for i, value in enumerate(values)]
        expected[model] = (min(statistics.multimode(values)), statistics.median(values), len(values))
    keys = ["year", "quarter", "model"]
    quarters = drive_quarters(drive_days(spark, rows), ["capacity_bytes"])
    modes = {row.model: row for row in with_mode(quarters, keys).collect()}
    medians = {row.model: row for row in with_doubled_median(quarters, keys).collect()}
    got = {m: (modes[m].model_capacity, float(medians[m].doubled_capacity) / 2, modes[m].drives) for m in modes}
    assert got == expected


def test_a_drive_with_two_capacities_is_one_drive(spark):
    _, _, drives = mode_and_median(spark, capacities(spark, [1, 2, 2, 3], drives=["a", "a", "b", None]))
    assert drives == 2


def test_fleet_capacity_and_delta(spark):
    rows = [
        ("2024-01-01", A, "a", 0, 12 * TB),
        ("2024-01-02", A, "a", 0, 12 * TB),
        ("2024-01-02", A, "b", 0, -1),
        ("2024-01-02", "Other model", "z", 0, 1 * TB),
        ("2024-04-01", A, "a", 0, 12 * TB),
        ("2025-04-01", A, "a", 0, 10 * TB),
    ]
    got = dicts(DriveFleet(drive_days(spark, rows)).capacity())
    assert [(row["year"], row["quarter"]) for row in got] == [(2024, 1), (2024, 2), (2025, 2)]
    assert [row["raw_storage_eb"] for row in got] == pytest.approx([25e-6, 12e-6, 10e-6])
    assert got[0]["delta_eb"] is None
    assert [row["delta_eb"] for row in got[1:]] == pytest.approx([-13e-6, -2e-6])


def test_delta_is_absent_after_an_empty_quarter(spark):
    rows = [("2024-01-01", A, "a", 0, 0), ("2024-04-01", A, "a", 0, TB), ("2024-07-01", A, "a", 0, None)]
    got = dicts(DriveFleet(drive_days(spark, rows)).capacity())
    assert [row["raw_storage_eb"] for row in got] == [0.0, 1e-6, 0.0]
    assert [row["delta_eb"] for row in got] == [None, None, -1e-6]


def test_fleet_totals_beyond_bigint(spark):
    capacity = 9 * 10**18
    rows = [("2024-01-01", A, f"s{i}", 0, capacity) for i in range(4)]
    assert DriveFleet(drive_days(spark, rows)).capacity().first().raw_storage_eb == 36.0
    assert DriveFleet(drive_days(spark, rows)).capacity_by_datacenter().first().raw_storage_eb == 36.0


def test_datacenters(spark):
    rows = [
        ("2024-01-01", A, "a", 0, 10 * TB, "phx1"),
        ("2024-02-01", A, "a", 0, 10 * TB, "PHX1"),
        ("2024-02-02", A, "a", 0, 10 * TB, "sac0"),
        ("2024-02-02", A, "b", 0, 11 * TB, "sac0"),
        ("2024-02-02", A, "c", 0, 10 * TB, "ams"),
        ("2024-02-02", A, "d", 0, 10 * TB, None),
        ("2024-02-02", B, "e", 0, 20 * TB, "sac0"),
    ]
    reports = DriveFleet(drive_days(spark, rows))
    got = {row.datacenter: row.raw_storage_eb for row in reports.capacity_by_datacenter().collect()}
    # the moved drive counts in both; two drives of 10 and 11 TB count as 10.5 each
    assert got == {"PHX1": pytest.approx(10e-6), "SAC0": pytest.approx(41e-6)}


def test_datacenter_text(spark):
    rows = [("2024-01-01", A, f"s{i}", 0, 9 * 10**18, "sac0" if i % 3 else "phx1") for i in range(4)]
    (row,) = DriveFleet(drive_days(spark, rows)).capacity_datacenter_report().collect()
    assert row.total_eb == 36.0
    assert row.datacenters == "PHX1 = 18.00 EB, SAC0 = 18.00 EB"


def test_makers(spark):
    rows = [
        # all-time mode of the normalized model is 12 TB, whatever one quarter says
        ("2024-01-01", A, "a", 0, 12 * TB),
        ("2024-01-02", A, "a", 0, 12 * TB),
        ("2024-01-03", "Seagate " + A, "a", 0, 12 * TB),
        ("2024-04-01", A, "a", 0, 99 * TB),
        ("2024-04-01", A, "b", 0, 99 * TB),
        ("2024-04-01", B, "c", 0, 12 * TB),
        ("2024-04-01", "ST4000DM000", "x", 0, 4 * TB),
    ]
    got = dicts(DriveFleet(drive_days(spark, rows)).capacity_by_maker())
    assert [(row["quarter"], row["drive_mfr"]) for row in got] == [(1, "Seagate"), (2, "Seagate"), (2, "WDC/HGST")]
    assert [row["raw_capacity_pb"] for row in got] == pytest.approx([0.012, 0.024, 0.012])
    assert [row["total_pb"] for row in got] == pytest.approx([0.012, 0.036, 0.036])
    assert [row["share_pct"] for row in got] == pytest.approx([100.0, 200 / 3, 100 / 3])


def test_rows_without_a_date_are_a_quarter_of_their_own(spark):
    rows = [(None, A, "a", 0, TB), ("2024-01-01", A, "a", 0, TB), ("2024-01-01", A, "b", 0, 2 * TB)]
    got = dicts(DriveFleet(drive_days(spark, rows)).capacity_by_maker())
    assert [(row["year"], row["raw_capacity_pb"]) for row in got] == [(None, 0.001), (2024, 0.002)]


def test_maker_text(spark):
    rows = [("2024-01-01", A, f"s{i}", 0, 10**18) for i in range(3)] + [("2024-01-01", B, "t", 0, 10**18)]
    (row,) = DriveFleet(drive_days(spark, rows)).capacity_maker_report().collect()
    assert row.makers == "Seagate =  3,000.0 ( 75%)    WDC/HGST =  1,000.0 ( 25%)"


def test_terabytes_are_exact(spark):
    values = [0, 1, 12000138625024, 9223372036854775807, -1]
    frame = spark.createDataFrame([(value,) for value in values], "bytes bigint")
    got = [row[0] for row in frame.select(exact_terabytes(F.col("bytes"))).collect()]
    assert got == [Decimal(value) / 10**12 for value in values]
