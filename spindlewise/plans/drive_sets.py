"""Which drives were there, as stored bit maps that merge over any span.

Distinct drives do not add up: those of a year are not the sum of its quarters'. Here each drive has a number, and a set of
drives is a bit for each, in maps of 32,768 bits. Sets are built once for each quarter, model and datacenter; those of longer
spans are their unions, and counting them moves bit maps only, never serial numbers. Numbers follow the drives' models, so
that a model's drives lie in few maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.operators.shared import path_exists

SET_KEYS = ["year", "quarter", "model", "datacenter"]
MAP_BITS = 1 << 15


class DriveSets:
    """The numbers of drives and their sets, stored in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def codes(self) -> DataFrame:
        """(serial_number, code) of every drive numbered so far."""
        path = f"{self.folder}/codes"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], "serial_number string, code long")
        return self.spark.read.parquet(path)

    def sets(self) -> DataFrame:
        """(year, quarter, model, datacenter, part, bits): the drives seen there, a row for each map that has any."""
        path = f"{self.folder}/sets"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], "year int, quarter int, model string, datacenter string, part long, bits binary")
        return self.spark.read.parquet(path)

    def add(self, quarters: DataFrame) -> None:
        """Number the drives of a summary that have no number, and add its sets. Taking rows in again changes nothing.

        The summary (``operators.summary``, with the datacenter) is read twice; pass a stored one. Missing serial numbers are
        no drives. New numbers start on a map of their own, behind all given.
        """
        drives = quarters.filter(F.col("serial_number").isNotNull())
        by_model = drives.groupBy("serial_number").agg(F.min(F.xxhash64("model")).alias("of_model"))
        fresh = by_model.join(self.codes().select("serial_number"), "serial_number", "left_anti")
        last = self.codes().agg(F.max("code")).first()[0]
        start = 0 if last is None else (last // MAP_BITS + 1) * MAP_BITS
        numbered = (
            fresh.repartitionByRange(F.col("of_model"), F.col("serial_number"))
            .sortWithinPartitions("of_model", "serial_number")
            .select("serial_number", (F.lit(start) + F.monotonically_increasing_id()).alias("code"))
        )
        numbered.write.mode("append").parquet(f"{self.folder}/codes")  # numbers of a task follow one another

        code = F.col("code")
        bits = F.bitmap_construct_agg(F.bitmap_bit_position(code)).alias("bits")
        coded = drives.select("serial_number", *SET_KEYS).join(self.codes(), "serial_number")
        sets = coded.groupBy(*SET_KEYS, F.bitmap_bucket_number(code).alias("part")).agg(bits)
        sets.write.mode("append").parquet(f"{self.folder}/sets")

    def count(self, *span: Column | str) -> DataFrame:
        """Distinct drives per ``span`` (columns or expressions over the sets' keys; none for all): ``drives``."""
        return counted(self.sets(), *span)


def united(sets: DataFrame, *span: Column | str) -> DataFrame:
    """The sets of longer spans."""
    return sets.groupBy(*span, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, *span: Column | str) -> DataFrame:
    union = united(sets, *span)
    names: Sequence[str] = [name for name in union.columns if name not in ("part", "bits")]
    return union.groupBy(*[F.col(f"`{name}`") for name in names]).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("drives"))
