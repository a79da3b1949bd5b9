"""Metadata files of table snapshots: one JSON document per file."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_SUFFIX = ".metadata.json"

#: The file source ignores files older than this, seen from the newest; metadata files may be copied in at any time.
NO_FILE_AGE = "36500d"

BROKEN = "_broken"

METADATA_DOCUMENT = T.StructType([T.StructField("last-updated-ms", T.LongType()), T.StructField(BROKEN, T.StringType())])


def read_snapshot_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, last_updated_ms) of every metadata file in a folder or list of paths, read in parallel.

    Files that are no JSON document with a time are left out: ``broken_snapshot_files`` lists those.
    """
    return _entries(_json_options(spark.read, METADATA_DOCUMENT).json(paths))


def stream_snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: each run sees the files added since the last one."""
    reader = _json_options(spark.readStream, METADATA_DOCUMENT).option("maxFileAge", NO_FILE_AGE)
    return _entries(reader.json(folder))


def broken_snapshot_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, reason, document) of metadata files that cannot be used, the document as it stands.

    The reason is "cannot be parsed" (cut short, empty, or a time that is no number) or "no last-updated-ms".
    """
    read = _json_options(spark.read, METADATA_DOCUMENT).json(paths)
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{METADATA_SUFFIX}").text(paths)
    texts = whole.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("document"))
    usable = _entries(read).select("file_name").distinct()
    time = F.col("last-updated-ms")  # a document cut short may still give it; the reader asks for a column beside the broken one
    torn = read.filter(F.col(BROKEN).isNotNull() & (time.isNull() | (time >= F.lit(-(2**63)))))
    torn = torn.select(F.col("_metadata.file_name").alias("file_name"), F.lit(True).alias("torn")).distinct()
    # an empty file is no row of any reader, but Spark lists it
    names = [(unquote(path).rsplit("/", 1)[-1],) for path in whole.inputFiles()]
    listed = spark.createDataFrame(names, "file_name string")
    document = F.coalesce("document", F.lit(""))
    reason = F.when(F.coalesce("torn", F.trim(document) == ""), F.lit("cannot be parsed")).otherwise(F.lit("no last-updated-ms"))
    return (
        listed.join(usable, "file_name", "left_anti")
        .join(texts, "file_name", "left")
        .join(torn, "file_name", "left")
        .select("file_name", reason.alias("reason"), document.alias("document"))
    )


def list_snapshot_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, path) of every metadata file in a folder or list of paths; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{METADATA_SUFFIX}").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path")


def _json_options(reader, schema):
    return (
        reader.schema(schema)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("pathGlobFilter", f"*{METADATA_SUFFIX}")
    )


def _entries(documents: DataFrame) -> DataFrame:
    usable = documents.filter(F.col(BROKEN).isNull() & F.col("last-updated-ms").isNotNull())
    return usable.select(
        F.col("_metadata.file_name").alias("file_name"), F.col("last-updated-ms").alias("last_updated_ms")
    )
