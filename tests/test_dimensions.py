from decimal import Decimal
from pathlib import Path

import pytest

from spindlewise import DriveFleet
from spindlewise.operators.shared import checkpoint_folder
from spindlewise.plans.dimensions import constraint_checks
from spindlewise.sinks.tables import ConstraintViolation, require_valid, write_dimensions
from tests.rows import TB, dicts, drive_days

A, B = "ST12000NM0007", "Other model"

DAYS = [
    ("2024-01-01", A, "a", 0, 12 * TB),
    ("2024-01-02", A, "a", 0, 12 * TB),
    ("2024-01-03", B, "a", 0, 4 * TB),
    ("2024-01-03", B, "b", 0, 4 * TB),
    ("2024-01-04", B, "b", 0, -1),
    ("2024-01-05", B, "b", 0, 4 * TB),
]


def test_drive_keeps_its_most_frequent_model(spark):
    fleet = DriveFleet(drive_days(spark, DAYS))
    models = {row.drive_model_smart: row for row in fleet.drive_models().collect()}
    assert {name: row.capacity_tb for name, row in models.items()} == {A: Decimal(12), B: Decimal(4)}
    drives = {row.serial_number: row for row in fleet.drives().collect()}
    assert drives["a"].drive_model_id == models[A].drive_model_id
    assert drives["b"].drive_model_id == models[B].drive_model_id
    assert len({row.drive_id for row in drives.values()}) == 2


def test_keys_agree_between_runs(spark):
    def keys():
        return sorted(row.drive_id for row in DriveFleet(drive_days(spark, DAYS)).drives().collect())

    assert keys() == keys()


def test_drives_of_unknown_models_drop_out(spark):
    fleet = DriveFleet(drive_days(spark, DAYS))
    known = fleet.drive_models().filter(f"drive_model_smart = '{A}'")
    assert [row.serial_number for row in fleet.drives(known).collect()] == ["a"]


def checks(models, drives):
    return {row["constraint"]: (row["violations"], row["rows_checked"]) for row in dicts(constraint_checks(models, drives))}


MODELS = "drive_model_id string, drive_model_smart string, capacity_tb double"
DRIVES = "drive_id string, drive_model_id string, serial_number string"


def test_each_violation_is_counted(spark):
    models = spark.createDataFrame(
        [("1", "m", 1.0), ("2", "m", 1.0), ("3", None, 1.0), ("4", None, 2.0), ("5", "n", None)], MODELS
    )
    drives = spark.createDataFrame(
        [("a", "1", "s"), ("b", "1", "s"), ("c", "1", "s"), ("d", "1", None), ("e", None, "s"), ("f", "9", "s"), ("g", "2", "s")],
        DRIVES,
    )
    assert checks(models, drives) == {
        "duplicate_model": (1, 5),
        "missing_model_name": (2, 5),
        "missing_model_size": (1, 5),
        "duplicate_drive": (2, 7),
        "missing_serial_number": (1, 7),
        "missing_drive_model": (1, 7),
        "orphan_drive": (1, 7),
        "duplicate_drive_model_id": (0, 5),
        "duplicate_drive_id": (0, 7),
    }
    with pytest.raises(ConstraintViolation, match="duplicate_model: 1"):
        require_valid(models, drives)


def test_repeated_ids_are_counted(spark):
    models = spark.createDataFrame([("1", "m", 1.0), ("1", "n", 1.0), (None, "o", 1.0)], MODELS)
    drives = spark.createDataFrame([("a", "1", "s"), ("a", "1", "t"), ("a", "1", "u")], DRIVES)
    got = checks(models, drives)
    assert got["duplicate_drive_model_id"] == (1, 3) and got["duplicate_drive_id"] == (2, 3)
    assert got["orphan_drive"] == (0, 3)


def test_empty_tables_break_nothing(spark):
    empty = checks(spark.createDataFrame([], MODELS), spark.createDataFrame([], DRIVES))
    assert set(empty.values()) == {(0, 0)}


def staged_folders(spark):
    return set(Path(checkpoint_folder(spark).removeprefix("file:")).glob("drive*"))


def test_dimensions_are_written_only_if_valid(spark, tmp_path):
    fleet, staged_before = DriveFleet(drive_days(spark, DAYS)), staged_folders(spark)
    write_dimensions(fleet.drive_models(), fleet.drives(), str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good" / "drives")).count() == 2
    assert spark.read.parquet(str(tmp_path / "good" / "drive_models")).count() == 2
    nameless = DriveFleet(drive_days(spark, [("2024-01-01", A, None)]))
    with pytest.raises(ConstraintViolation, match="missing_serial_number"):
        write_dimensions(nameless.drive_models(), nameless.drives(), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    assert staged_before == staged_folders(spark)
