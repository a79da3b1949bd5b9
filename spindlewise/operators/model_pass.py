"""A pass over the model column alone, so that rows of other models never leave the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.operators.shared import checkpointed
from spindlewise.operators.summary import model_counts, only_models

#: So many names become a list in the query, which file readers use to skip row groups; more are joined.
LISTED_MODELS = 1000

#: Names (short texts) that may be broadcast.
BROADCAST_MODELS = 100_000


def rows_of_models(drive_days: DataFrame, patterns: Sequence[str], listed: int = LISTED_MODELS) -> DataFrame:
    """Daily rows whose raw model matches one of the patterns, found without searching each row.

    The distinct models are looked up first, which reads one column, and the patterns are searched in those. The names
    are then compared, not searched: as a list that is pushed down to the files, or, where there are more than ``listed``,
    through a semi-join with the stored names, broadcast if they are few. Either comes before the first shuffle.
    """
    names = only_models(model_counts(drive_days.select("model")), patterns, summary=True).select("model")
    found = [row.model for row in names.limit(listed + 1).collect()]
    if len(found) <= listed:
        return drive_days.filter(F.col("model").isin(found))
    known = checkpointed(names)
    few = known.count() <= BROADCAST_MODELS
    return drive_days.join(F.broadcast(known) if few else known, "model", "left_semi")
