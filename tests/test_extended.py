"""The further queries against their SQL, and every SQL text as a view."""

from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as contract
from spindlewise.contract import extended, queries
from spindlewise.contract.extended import ORACLES, QUERIES
from tests.compare import duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"


def test_every_further_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_further_query_equals_sql(spark, name):
    result = QUERIES[name](spark, FOLDER)
    assert spark_rows(result) == duckdb_rows(ORACLES[name], FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "InPandas", "InArrow"):
        assert operator not in plan


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_sql_can_be_kept_in_a_view(name):
    connection = duckdb.connect()
    for table in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    connection.execute(f"CREATE VIEW kept AS {contract.oracle_sql()[name]}")
    assert connection.execute("DESCRIBE kept").fetchall()


def test_what_a_stream_takes_in_grows_in_number_not_in_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "PART_ROWS", 100)
    key = F.col("id")
    lineitem = spark.range(2_000).select(
        (key % 40).alias("l_partkey"), (key % 12).alias("l_suppkey"), (key % 7 + 1).cast("int").alias("l_linenumber"), F.lit("R").alias("l_returnflag"),
        F.timestamp_add("DAY", (key % 900).cast("int"), F.lit("1998-10-01").cast("timestamp_ntz")).alias("l_shipdate"),
    )
    lineitem.write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    assert queries.stream_parts(spark.range(200), str(tmp_path / "few")) == 1
    assert queries.stream_parts(lineitem, str(tmp_path / "parts")) == 7  # of 21 files
    written = spark.read.parquet(str(tmp_path / "parts")).groupBy(F.input_file_name()).count().collect()
    assert sum(row["count"] for row in written) == 2_000 and max(row["count"] for row in written) <= 100

    made = []
    monkeypatch.setattr(extended, "new_folder", lambda _, purpose: made.append(str(tmp_path / purpose)) or made[-1])
    result = spark_rows(QUERIES["capacity_by_dc_stream"](spark, str(tmp_path / "sf")))
    assert len(list((tmp_path / "daily-parts").glob("*.parquet"))) == 21
    assert result == spark_rows(contract.queries()["capacity_by_dc"](spark, str(tmp_path / "sf"))) and result
