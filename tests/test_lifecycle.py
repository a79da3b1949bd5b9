from spindlewise import DriveFleet
from tests.rows import day, dicts, drive_days

A, B = "ST12000NM0007", "HGST HUH721212ALE604"
LONG = "TOSHIBA MG08ACA16TEY"


def fleet(spark, rows):
    return DriveFleet(drive_days(spark, rows))


def test_date_ranges_merge_names_and_compare_by_day(spark):
    rows = [
        ("2020-01-01", A, "a"),
        ("2024-06-29", "Seagate " + A, "b"),
        ("2021-05-01", B, "c"),
        ("2024-06-30", B, "c"),
        ("2021-05-01", LONG, "d"),
        # a model outside the list does not move the newest day
        ("2025-01-01", "ST4000DM000", "e"),
    ]
    got = dicts(fleet(spark, rows).model_date_ranges())
    assert [row["drive_model"] for row in got] == [LONG, "WDC/HGST HUH721212ALE604", "Seagate ST12000NM0007"]
    assert [row["in_service"] for row in got] == [False, True, False]
    assert [row["status"] for row in got] == [
        "removed from use: 2021 Q2",
        "currently deployed",
        "removed from use: 2024 Q2",
    ]
    assert got[2]["first_seen"] == "2020 Q1" and got[2]["last_seen_date"] == day("2024-06-29")


def test_models_per_maker_compare_by_quarter(spark):
    rows = [
        ("2020-01-01", A, "a"),
        ("2024-06-29", A, "b"),
        ("2021-05-01", B, "c"),
        ("2024-06-30", B, "c"),
        ("2021-05-01", LONG, "d"),
        ("2021-05-01", "ST16000NM001G", "d"),
    ]
    got = dicts(fleet(spark, rows).models_per_maker())
    assert [(row["mfr"], row["model"], row["deployed_currently"]) for row in got] == [
        ("Seagate", "ST16000NM001G", False),
        ("Seagate", "ST12000NM0007", True),
        ("Toshiba", "MG08ACA16TEY", False),
        ("WDC/HGST", "HUH721212ALE604", True),
    ]
    assert got[0]["status"] == "last seen: 2021 Q2"


def test_deployments_minimum_and_subtotals(spark):
    rows = [("2024-01-01", A, f"a{i}") for i in range(3)]
    rows += [("2024-04-01", A, f"a{i}") for i in range(5)]  # two of them new
    rows += [("2024-01-15", B, f"b{i}") for i in range(2)] + [("2024-01-15", LONG, "c"), ("2024-01-15", B, None)]
    got = [tuple(row) for row in fleet(spark, rows).deployments(2).collect()]
    assert got == [
        ("2024 Q2", "Seagate", "ST12000NM0007", 2),
        ("2024 Q1", "Seagate", "ST12000NM0007", 3),
        ("2024 Q1", "WDC/HGST", "HUH721212ALE604", 2),
    ]
    subtotals = [tuple(row) for row in fleet(spark, rows).deployments_with_subtotals(2).collect()]
    assert [row for row in subtotals if row[-1]] == [
        ("2024 Q2", None, None, 2, True),
        ("2024 Q1", None, None, 5, True),
    ]
    assert [row[:4] for row in subtotals if not row[-1]] == got


def test_distribution_totals_cover_shown_models_only(spark):
    rows = [("2024-01-01", A, f"a{i}") for i in range(3)] + [("2024-01-02", A, "a0"), ("2024-01-02", A, None)]
    rows += [("2024-01-01", B, "b")]
    shown = dicts(fleet(spark, rows).distribution_with_totals(2))
    assert [(row["unique_serial_numbers"], row["total_drives"]) for row in shown] == [(3, 3)]
    everything = dicts(fleet(spark, rows).distribution_with_totals())
    assert [(row["unique_serial_numbers"], row["total_drives"]) for row in everything] == [(3, 4), (1, 4)]


def test_models_without_serials_stay_in_the_unfiltered_distribution(spark):
    got = dicts(fleet(spark, [("2024-01-01", A, None)]).distribution())
    assert [row["unique_serial_numbers"] for row in got] == [0]
