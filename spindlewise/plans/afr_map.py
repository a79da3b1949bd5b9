"""The wide failure-rate table for any number of models.

A pivot needs the names of its columns while the query is put together, and some thousands of models make more columns than
an engine takes. Here a row holds its models in a map, and only the text form has a column for each: its lines are put
together on the executors, so that no name passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.plans.afr import WIDE_MEASURES

QUARTER = ["service_year", "service_quarter"]


def _cell() -> Column:
    return F.struct(*[F.col(column).alias(measure) for measure, column in WIDE_MEASURES.items()])


def afr_wide_map(cumulative: DataFrame) -> DataFrame:
    """One row per quarter of service: ``models``, from each model then in service to its seven measures, by name."""
    entry = F.struct(F.concat_ws(" ", "mfr", "model").alias("model"), _cell().alias("cell"))
    entries = F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0))
    return cumulative.groupBy(*QUARTER).agg(F.map_from_entries(entries).alias("models"))


def wide_cells(wide: DataFrame) -> DataFrame:
    """The map as rows: quarter of service, ``position`` in the row, ``model_name`` and the measures."""
    return wide.select(*QUARTER, F.posexplode("models").alias("place", "model_name", "cell")).select(
        *QUARTER, (F.col("place") + 1).cast("long").alias("position"), "model_name", "cell.*"
    )


def wide_lines(wide: DataFrame) -> DataFrame:
    """(place, value): the map as lines of comma-separated text, the header at place 0.

    Every line has the same columns, those of a pivot: the quarter of service, then seven for each model of the table, by
    name. A line is one row, as long as the table has models. Pass a stored map; it is read three times.
    """
    names = wide.select(F.explode(F.map_keys("models")).alias("model_name")).distinct()
    headers = F.transform(F.array(*map(F.lit, WIDE_MEASURES)), lambda m: F.to_csv(F.struct(F.concat("model_name", F.lit("_"), m)), {"escape": '"'}))
    header = names.select(F.lit(0).alias("place"), F.lit(",".join(QUARTER)).alias("quarter"), "model_name", F.array_join(headers, ",").alias("text"))

    quarters = wide.select(*QUARTER).distinct()
    every = names.agg(F.collect_set("model_name").alias("every")).scalar()
    grid = quarters.withColumn("model_name", F.explode(every))
    text = F.array_join(F.array(*[F.col(m).cast("string") for m in WIDE_MEASURES]), ",", "")
    filled = grid.join(wide_cells(wide), [*QUARTER, "model_name"], "left").select(
        (F.col("service_year") * 10 + F.col("service_quarter")).alias("place"),
        F.concat_ws(",", *QUARTER).alias("quarter"),
        "model_name",
        text.alias("text"),
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("model_name", "text"))), lambda cell: cell["text"])
    return header.unionByName(filled).groupBy("place", "quarter").agg(texts.alias("texts")).select(
        "place", F.concat_ws(",", "quarter", F.array_join("texts", ",")).alias("value")
    )
