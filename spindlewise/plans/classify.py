"""Brand and product family of raw model names, by ordered patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.functions.names import any_pattern, first_label
from spindlewise.operators.summary import model_counts
from spindlewise.sources.patterns import BRANDS, FAMILIES


def classify_brand(df: DataFrame, brands: Sequence[tuple[str, str]] = BRANDS) -> DataFrame:
    """Brand of each distinct model, null where no pattern is found.

    The patterns are a short list known up front: as one conditional expression per distinct
    model they stay in generated code, where joining them would compare every model with every
    pattern in a nested loop.
    """
    return model_counts(df).select("model").withColumn("mfr", first_label(F.col("model"), brands))


def classify_family(df: DataFrame, families: Mapping[str, Sequence[str]] = FAMILIES) -> DataFrame:
    """Product family of each distinct model, null where no pattern is found."""
    labelled = [(any_pattern(patterns), family) for family, patterns in families.items()]
    return model_counts(df).select("model").withColumn("family", first_label(F.col("model"), labelled))
