"""What the operators share: tables stored between jobs, Arrow batches of bounded size, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space. The class reads the same in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"

_setting = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that the session names for tables kept between jobs.

    A session on one machine that names none gets a temporary folder, set here; on a cluster the setting is required.
    """
    folder = spark.conf.get(_setting, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_setting} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spindlewise-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs neither repeat it nor depend on executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else: other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: CRC-32 of its id as text. A missing id has no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sliced(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most_bytes``; a longer text gets a batch of its own."""
    for batch in batches:
        start = held = 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for row, size in enumerate(sizes):
            if row > start and held + size > most_bytes:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str, text: int) -> DataFrame:
    """``df`` through ``mapInArrow``. ``make`` runs once in each task and returns the function from a batch to columns."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        step = make()
        for batch in sliced(batches, text):
            columns = step(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """Rows of ``df`` with all columns whose text passes. ``make`` returns the function from texts (UTF-8, null is empty)
    to what passes; it runs once in each task."""
    at = df.columns.index(text)

    def run(batches):
        keep = make()
        for batch in sliced(batches, at):
            texts = pc.fill_null(batch.column(at).cast(pa.binary()), b"").to_pylist()
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: Rows, and bytes in them, that may be broadcast. Larger tables are joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 48 << 20


def _bytes_in(column: Column, kind: T.DataType) -> Column:
    """About what a value takes: texts by their length, lists by what is in them, others eight bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        of = lambda x: _bytes_in(x, kind.elementType)
        size = F.aggregate(column, F.lit(0).cast("long"), lambda total, x: total + of(x).cast("long"))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes_in(column.getField(f.name), f.dataType) for f in kind), F.lit(0))
    else:
        size = F.lit(0)
    return F.coalesce(size.cast("long"), F.lit(0).cast("long")) + 8


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint where its rows have been counted, and the bytes in them, and both are few."""
    if table.count() > BROADCAST_ROWS:
        return table
    held = table.agg(F.sum(sum((_bytes_in(F.col(f"`{f.name}`"), f.dataType) for f in table.schema), F.lit(0)))).first()[0]
    return F.broadcast(table) if (held or 0) <= BROADCAST_BYTES else table


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
