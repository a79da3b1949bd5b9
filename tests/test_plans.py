"""What the plans look like: one scan of the source, only its columns, no nested loops, no Python."""

import re
import time

import pytest

from spindlewise import DriveFleet
from spindlewise.contract.queries import QUERIES
from spindlewise.sources import bridge

FOLDER = "/root/testdata/sf0.001"

FROM_DAILY_ROWS = [name for name in QUERIES if not name.startswith("snapshot")]
TWO_SCANS = {"dim_constraint_checks"}  # both dimensions


def completed_stages(spark):
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = store.stageList(None, False, False, quantiles, None)
    every = [stages.apply(i) for i in range(stages.size())]
    return {stage.stageId(): stage.inputRecords() for stage in every if stage.status().toString() == "COMPLETE"}


def settled_stages(spark):
    """Stage records arrive a moment after the job returns."""
    before, now = None, completed_stages(spark)
    while before != now:
        time.sleep(0.2)
        before, now = now, completed_stages(spark)
    return now


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    rows = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    before = settled_stages(spark)
    plan = plan_of(QUERIES[name](spark, FOLDER))

    if name in FROM_DAILY_ROWS:
        read = sum(records for stage, records in settled_stages(spark).items() if stage not in before)
        assert read == rows * (2 if name in TWO_SCANS else 1)

    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan

    # Printed as "Window [functions], [partition keys], [order]", empty lists left out: an order
    # as the second list means no keys. Only the change from quarter to quarter orders all rows,
    # which are calendar quarters by then, four a year.
    windows = re.findall(r"Window \[.*\]$", plan, re.MULTILINE)
    unpartitioned = [w for w in windows if w.count("], [") == 1 and re.search(r"(ASC|DESC) NULLS \w+\]$", w)]
    assert bool(unpartitioned) == (name == "capacity_fleet")


@pytest.fixture(scope="module")
def stored_days(spark, tmp_path_factory):
    """A daily table whose columns the optimizer cannot see through, as it can through the bridge."""
    path = str(tmp_path_factory.mktemp("daily") / "days")
    bridge.drive_days(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(
    "report, costly",
    [
        ("candidate_models", "RLIKE"),
        ("afr_cumulative", "RLIKE"),
        ("drives_removed", "RLIKE"),
        ("model_date_ranges", "RLIKE"),
        ("deployments", "RLIKE"),
        ("distribution", "split"),
        ("capacity_by_maker", "split"),
        ("capacity_by_datacenter", "upper"),
    ],
)
@pytest.mark.parametrize("on_unknown", ["error", "drop"])
def test_text_conditions_run_on_summaries(stored_days, report, costly, on_unknown):
    frame = getattr(DriveFleet(stored_days, on_unknown=on_unknown), report)()
    lines = frame._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any(costly in line for line in lines)
    scans = [i for i, line in enumerate(lines) if "Relation [" in line]
    for scan in scans:
        first_aggregate = max(i for i, line in enumerate(lines[:scan]) if "Aggregate [" in line)
        assert not any(costly in line for line in lines[first_aggregate + 1 : scan])


@pytest.mark.parametrize("report", ["capacity", "capacity_by_datacenter", "capacity_by_maker"])
def test_drives_are_counted_without_sorting_them(stored_days, report):
    plan = plan_of(getattr(DriveFleet(stored_days), report)())
    assert re.search(r"HashAggregate\(.*sum\(drive#", plan)
    assert not re.search(r"SortAggregate\(.*sum\(drive#", plan)


def test_missing_datacenters_are_left_to_the_scan(stored_days):
    plan = plan_of(DriveFleet(stored_days).capacity_by_datacenter())
    assert "PushedFilters: [IsNotNull(datacenter)]" in plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("candidate_models", {"l_partkey"}),
        ("distribution_qtr", {"l_partkey", "l_shipdate"}),
        ("dim_drive_models", {"l_partkey", "l_suppkey", "l_linenumber"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, FOLDER)))
    assert {field.split(":")[0] for schema in schemas for field in schema.split(",")} == columns
