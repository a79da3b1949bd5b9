"""The wide table for any number of models, and the pass that finds the models of interest first."""

import re

import pytest
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.operators import model_pass
from spindlewise.operators.model_pass import rows_of_models
from spindlewise.plans.afr import WIDE_MEASURES, afr_wide
from spindlewise.plans.afr_map import afr_wide_map, wide_cells
from spindlewise.sinks.tables import write_report, write_wide_lines
from spindlewise.sources import bridge
from spindlewise.sources.patterns import FLEET_MODELS
from tests.compare import spark_rows
from tests.rows import drive_days
from tests.test_plans import plan_of

FOLDER = "/root/testdata/sf0.001"


def cumulative(spark, models):
    """Rows as of ``afr_cumulative``: model k has been in service for k % 5 + 1 quarters."""
    number = spark.range(models).select(F.format_string("M%05d", "id").alias("model"), F.explode(F.sequence(F.lit(0), F.col("id") % 5)).alias("n"))
    values = {c: (F.col("n") * 3 + F.length("model")).cast("double" if c.startswith("afr") else "long").alias(c) for c in WIDE_MEASURES.values()}
    return number.select(
        F.lit("Maker").alias("mfr"), "model", (F.floor(F.col("n") / 4) + 1).cast("int").alias("service_year"), (F.col("n") % 4 + 1).cast("int").alias("service_quarter"), *values.values()
    )


def test_thousands_of_models(spark, tmp_path):
    wide = afr_wide_map(cumulative(spark, 5000))
    sizes = {(row.service_year, row.service_quarter): row.n for row in wide.select("service_year", "service_quarter", F.size("models").alias("n")).collect()}
    assert sizes == {(1, 1): 5000, (1, 2): 4000, (1, 3): 3000, (1, 4): 2000, (2, 1): 1000}
    write_wide_lines(wide, str(tmp_path / "wide"))
    lines = [row.value.split(",") for row in spark.read.text(str(tmp_path / "wide")).collect()]
    assert {len(line) for line in lines} == {2 + 7 * 5000}
    assert lines[0][:3] == ["service_year", "service_quarter", "Maker M00000_afr"] and lines[0][-1] == "Maker M04999_failed"
    assert [line[:2] for line in lines[1:]] == [["1", "1"], ["1", "2"], ["1", "3"], ["1", "4"], ["2", "1"]]
    assert lines[5][2:9] == [""] * 7 and lines[5][2 + 7 * 4] == "18.0"


def test_map_and_pivot_hold_the_same_cells(spark, tmp_path):
    rows = cumulative(spark, 13)
    pivot = afr_wide(rows)
    cells = wide_cells(afr_wide_map(rows))
    for row in cells.collect():
        of = pivot.filter((F.col("service_year") == row.service_year) & (F.col("service_quarter") == row.service_quarter)).first()
        assert [of[f"{row.model_name}_{m}"] for m in WIDE_MEASURES] == [row[m] for m in WIDE_MEASURES]
    write_report(pivot.orderBy("service_year", "service_quarter").coalesce(1), str(tmp_path / "pivot"), "csv", header="true")
    write_wide_lines(afr_wide_map(rows), str(tmp_path / "lines"))
    read = [spark.read.csv(str(tmp_path / name), header=True) for name in ("pivot", "lines")]
    assert spark_rows(read[0]) == spark_rows(read[1])


def test_names_with_commas_are_quoted(spark, tmp_path):
    odd = cumulative(spark, 1).withColumn("model", F.lit('X,"1"'))
    write_wide_lines(afr_wide_map(odd), str(tmp_path / "lines"))
    read = spark.read.csv(str(tmp_path / "lines"), header=True, escape='"')
    assert 'Maker X,"1"_afr' in read.columns


def test_the_map_is_built_in_one_pass_without_a_collect(spark):
    plan = plan_of(DriveFleet(bridge.drive_days(spark, FOLDER)).afr_wide_map(1))
    assert plan.split("Initial Plan")[0].count("FileScan") <= 2 and "Python" not in plan


@pytest.fixture(scope="module")
def stored_days(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("daily") / "days")
    days = bridge.drive_days(spark, FOLDER)
    other = days.withColumn("model", F.concat(F.lit("OTHER "), F.col("serial_number")))
    days.unionByName(other).write.parquet(path)
    return spark.read.parquet(path)


REPORTS = {"afr_enriched": {}, "drives_removed": {}, "model_date_ranges": {}, "deployments": {"deploy_count_min": 1}, "capacity": {}, "capacity_by_maker": {}}


@pytest.mark.parametrize("report", REPORTS)
def test_model_pass_changes_no_report(stored_days, report):
    with_pass, without = (getattr(DriveFleet(stored_days, model_pass=p), report)(**REPORTS[report]) for p in (True, False))
    assert spark_rows(with_pass) == spark_rows(without)


def test_models_of_interest_reach_the_scan(stored_days):
    plan = plan_of(DriveFleet(stored_days, model_pass=True).afr_quarterly())
    assert re.search(r"PushedFilters: \[[^\]]*In\(model, \[", plan)
    lines = DriveFleet(stored_days, model_pass=True).afr_quarterly()._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(lines) if "Relation [" in line)
    assert any("model" in line and "IN (" in line for line in lines[scan - 2 : scan])  # below the first aggregation


def test_many_models_are_joined_before_the_first_shuffle(spark, stored_days, monkeypatch):
    want = spark_rows(stored_days.filter(F.col("model").rlike("|".join(FLEET_MODELS))))
    for limit, strategy in ((100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(model_pass, "BROADCAST_MODELS", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            kept = rows_of_models(stored_days, FLEET_MODELS, listed=2)
            assert strategy in plan_of(kept) and "RLIKE" not in plan_of(kept)
            assert spark_rows(kept) == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_model_of_interest(spark):
    days = drive_days(spark, [("2024-01-01", "other", "a"), ("2024-01-01", None, "b")])
    assert DriveFleet(days, model_pass=True).afr_quarterly().count() == 0
    assert rows_of_models(days.limit(0), FLEET_MODELS).count() == 0
