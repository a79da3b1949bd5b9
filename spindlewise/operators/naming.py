"""Normalized model names as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.functions.names import name_tokens, normalized_model
from spindlewise.operators.summary import kept_on_summary


def with_model_name(
    df: DataFrame, on_unknown: str = "error", raw: str = "model", name: str = "model_name", summary: bool = False
) -> DataFrame:
    """Add the normalized name of the raw one.

    ``on_unknown="error"`` fails the job on a name no rule covers, ``"null"`` leaves it null and
    ``"drop"`` drops its rows. ``summary`` says that ``df`` is a summary, not daily rows.
    """
    if on_unknown not in ("error", "null", "drop"):
        raise ValueError(f"on_unknown is 'error', 'null' or 'drop', not {on_unknown!r}")
    unknown = F.lit(None).cast("string")
    if on_unknown == "error":
        unknown = F.raise_error(F.concat(F.lit("no maker known for drive model '"), raw, F.lit("'"))).cast("string")
    # the tokens are a column of their own so that they are split once per row
    named = (
        df.withColumn("name_tokens", name_tokens(F.col(raw)))
        .withColumn(name, normalized_model(F.col("name_tokens"), unknown))
        .drop("name_tokens")
    )
    if on_unknown != "drop":
        return named
    known = F.col(name).isNotNull()
    return kept_on_summary(named, known) if summary else named.filter(known)
