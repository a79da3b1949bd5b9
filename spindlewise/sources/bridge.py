"""Stand-in sources over the order-and-lineitem test tables, for tests, benchmarks and contract queries.

The drive-day text runs unchanged on Spark SQL and DuckDB, so a report and its check in SQL
start from the same rows. Capacities are a thousandfold, so that small tables reach exabytes, and differ
a little from day to day, so that their mode is not their median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.schema import as_drive_days

DRIVE_DAYS_SQL = """
SELECT CAST(l_shipdate AS DATE) AS date,
  CONCAT('SN', CAST(l_partkey AS STRING)) AS serial_number,
  CASE l_partkey % 10
    WHEN 0 THEN 'ST12000NM0007' WHEN 1 THEN 'Seagate ST16000NM001G' WHEN 2 THEN 'HGST HUH721212ALE604'
    WHEN 3 THEN 'WDC WUH721816ALE6L4' WHEN 4 THEN 'WUH721816ALE6L4' WHEN 5 THEN 'TOSHIBA MG07ACA14TA'
    WHEN 6 THEN 'TOSHIBA  MG08ACA16TEY' WHEN 7 THEN 'ST24000NM002H' WHEN 8 THEN 'ST4000DM000'
    ELSE 'HGST HMS5C4040BLE640' END AS model,
  CASE WHEN l_linenumber = 7 AND l_suppkey % 10 = 0 THEN CAST(-1 AS BIGINT) ELSE
    1000 * CASE l_partkey % 10
      WHEN 0 THEN 12000138625024 WHEN 1 THEN 16000900661248 WHEN 2 THEN 12000138625024
      WHEN 3 THEN 16000900661248 WHEN 4 THEN 16000900661248 WHEN 5 THEN 14000519643136
      WHEN 6 THEN 16000900661248 WHEN 7 THEN 24000277250048 ELSE 4000787030016 END
    + 512 * l_linenumber END AS capacity_bytes,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND l_suppkey % 20 = 0 THEN 1 ELSE 0 END AS failure,
  CASE l_suppkey % 6
    WHEN 0 THEN 'phx1' WHEN 1 THEN 'sac0' WHEN 2 THEN 'AMS5' WHEN 3 THEN 'iad1' WHEN 4 THEN 'x'
    ELSE NULL END AS datacenter
FROM {lineitem}
"""

#: Digits of the largest bigint, so that no key is cut.
SNAPSHOT_FILE_WIDTH = 19


def drive_days(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{folder}/lineitem.parquet")
    return as_drive_days(spark.sql(DRIVE_DAYS_SQL, lineitem=lineitem))


def snapshot_entries(orders: DataFrame) -> DataFrame:
    """Orders, batch or stream, as if each were a metadata file."""
    return orders.select(
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), SNAPSHOT_FILE_WIDTH, "0"), F.lit("-x.metadata.json")).alias(
            "file_name"
        ),
        F.unix_millis(F.to_timestamp(F.col("o_orderdate"))).alias("last_updated_ms"),
    )
