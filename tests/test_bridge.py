"""The stand-in sources keep every row and cut no key."""

import pytest

from spindlewise.fleet import DriveFleet
from spindlewise.sources import bridge


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_lineitem_row_is_a_drive_day(spark, size):
    folder = f"/root/testdata/{size}"
    assert bridge.drive_days(spark, folder).count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()


def test_long_order_keys_keep_their_file_names(spark):
    orders = spark.sql("SELECT explode(array(149999L, 1499999L)) AS o_orderkey, timestamp'2024-01-01' AS o_orderdate")
    names = {r.file_name.lstrip("0") for r in bridge.snapshot_entries(orders).collect()}
    assert names == {"149999-x.metadata.json", "1499999-x.metadata.json"}


def test_timestamps_of_one_day_are_one_day(spark):
    days = spark.sql(
        "SELECT timestamp'2024-01-05 01:00:00' AS date, 'ST12000NM0007' AS model, 'a' AS serial_number, 0 AS failure, 1L AS capacity_bytes,"
        " 'phx1' AS datacenter UNION ALL SELECT timestamp'2024-01-05 02:00:00', 'ST24000NM002H', 'b', 0, 1L, 'phx1'"
    )
    assert DriveFleet(days).drives_removed().count() == 0
    assert DriveFleet(days).models_per_maker().select("status").distinct().count() == 1
