"""Which models are in the table, and what they are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.operators.naming import with_model_name
from spindlewise.operators.summary import model_counts, only_models


def candidate_models(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Distinct raw model names of interest."""
    return only_models(model_counts(df), patterns, summary=True).select(F.col("model").alias("drive_model_name_smart"))


def model_mapping(df: DataFrame, patterns: list[str], on_unknown: str = "error") -> DataFrame:
    """Raw model name -> normalized name, for every candidate model."""
    return with_model_name(
        candidate_models(df, patterns), on_unknown, "drive_model_name_smart", "drive_model_name_normalized"
    )


def unknown_models(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Candidate models that no name rule covers; the rest of the library would reject them."""
    mapping = model_mapping(df, patterns, on_unknown="null")
    return mapping.filter(F.col("drive_model_name_normalized").isNull()).select("drive_model_name_smart")
