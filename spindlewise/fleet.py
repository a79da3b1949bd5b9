"""One object per fleet: every report as a method, in report order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewise.schema import DRIVE_DAYS, as_drive_days
from spindlewise.operators.model_pass import rows_of_models
from spindlewise.operators.summary import (
    OPTIONAL_KEYS,
    drive_quarters,
    drive_spans,
    model_spans,
    only_models,
    per_drive_quarter,
)
from spindlewise.plans import afr, afr_map, capacity, classify, dimensions, distribution, lifecycle, models
from spindlewise.sources.patterns import BRANDS, FAMILIES, FLEET_MODELS
from spindlewise.sources.tables import open_drive_days


class DriveFleet:
    """Reports over a daily drive table.

    A report on its own scans the table once and reads only its columns. To run several, store
    ``summary()`` once (``sinks.tables.write_drive_quarters``) and hand the stored frame to
    ``DriveFleet(summary=...)``: every report except the dimensions then starts from one row per
    drive and quarter.

    With ``model_pass``, the models of interest are looked up in a pass over that column when the first report that needs
    them is put together, and rows of others do not leave the scan: worth it where most rows are of other models.
    """

    def __init__(
        self,
        drive_days: DataFrame | None = None,
        *,
        summary: DataFrame | None = None,
        patterns: Sequence[str] = tuple(FLEET_MODELS),
        on_unknown: str = "error",
        model_pass: bool = False,
    ):
        if (drive_days is None) == (summary is None):
            raise ValueError("give either the daily table or a stored summary")
        if drive_days is not None:  # a timestamp where a day is meant would tell two sightings of a day apart
            drive_days = as_drive_days(drive_days, [name for name in DRIVE_DAYS.fieldNames() if name in drive_days.columns])
        self.drive_days = drive_days
        self.stored = summary
        self.patterns = list(patterns)
        self.on_unknown = on_unknown
        self.model_pass = model_pass
        self._of_models: DataFrame | None = None

    @classmethod
    def open(
        cls,
        spark: SparkSession,
        location: str,
        format: str = "parquet",
        snapshot_id: int | None = None,
        options: Mapping[str, str] | None = None,
        **settings,
    ) -> DriveFleet:
        """A fleet over a stored table; ``settings`` as for the class itself."""
        return cls(open_drive_days(spark, location, format, snapshot_id, **(options or {})), **settings)

    # what the reports start from

    def summary(self) -> DataFrame:
        """The full drive-quarter summary, of all models: enough for every report but the dimensions."""
        return drive_quarters(self._daily(), OPTIONAL_KEYS)

    def _daily(self) -> DataFrame:
        if self.drive_days is None:
            raise ValueError("this needs the daily table; the fleet was opened from a summary")
        return self.drive_days

    @property
    def _source(self) -> DataFrame:
        return self.stored if self.drive_days is None else self.drive_days

    def _narrowed(self) -> DataFrame:
        if self._of_models is None:
            self._of_models = rows_of_models(self.drive_days, self.patterns)
        return self._of_models

    def _summarized(self, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A reduction of the daily rows, of models of interest."""
        if self.drive_days is None:
            return only_models(self.stored, self.patterns, summary=True)
        return reduce(self._narrowed()) if self.model_pass else only_models(reduce(self.drive_days), self.patterns, summary=True)

    def _quarters(self, *extra_keys: str, all_models: bool = False) -> DataFrame:
        if all_models:
            return self.stored if self.drive_days is None else drive_quarters(self.drive_days, extra_keys)
        return self._summarized(lambda days: drive_quarters(days, extra_keys))

    def _histories(self) -> DataFrame:
        """Quarters for reports that order each drive's rows: few rows per drive, missing serials too."""
        quarters = self._quarters()
        return per_drive_quarter(quarters) if self.drive_days is None else quarters

    def _drive_spans(self) -> DataFrame:
        return self._summarized(drive_spans)

    def _model_spans(self) -> DataFrame:
        return self._summarized(model_spans)

    # models

    def candidate_models(self) -> DataFrame:
        return models.candidate_models(self._source, self.patterns).orderBy("drive_model_name_smart")

    def model_mapping(self) -> DataFrame:
        return models.model_mapping(self._source, self.patterns, self.on_unknown).orderBy("drive_model_name_smart")

    def unknown_models(self) -> DataFrame:
        return models.unknown_models(self._source, self.patterns).orderBy("drive_model_name_smart")

    def brands(self, brands: Sequence[tuple[str, str]] = BRANDS) -> DataFrame:
        return classify.classify_brand(self._source, brands).orderBy("model")

    def families(self, families: Mapping[str, Sequence[str]] = FAMILIES) -> DataFrame:
        return classify.classify_family(self._source, families).orderBy("model")

    # failure rates

    def afr_quarterly(self) -> DataFrame:
        return afr.afr_quarterly(self._quarters(), self.on_unknown).orderBy("model_name", "year", "quarter")

    def drive_lifetimes(self) -> DataFrame:
        """Unsorted: one row per drive."""
        return afr.drive_lifetimes(self._drive_spans(), self.on_unknown)

    def drives_deployed(self) -> DataFrame:
        deployed = afr.drives_deployed(self.drive_lifetimes())
        return deployed.orderBy("model_name", "deploy_year", "deploy_quarter")

    def drives_removed(self) -> DataFrame:
        removed = afr.drives_removed(self.drive_lifetimes())
        return removed.orderBy("model_name", "remove_year", "remove_quarter")

    def afr_enriched(self) -> DataFrame:
        return afr.afr_enriched(self._histories(), self.on_unknown).orderBy("model_name", "year", "quarter")

    def _afr_cumulative(self, min_drives: int) -> DataFrame:
        return afr.afr_cumulative(self._histories(), min_drives, self.on_unknown)

    def afr_cumulative(self, min_drives: int = 2000) -> DataFrame:
        return self._afr_cumulative(min_drives).orderBy("mfr", "model", "year_quarter")

    def afr_wide(self, min_drives: int = 2000, models: Sequence[str] | None = None) -> DataFrame:
        wide = afr.afr_wide(self._afr_cumulative(min_drives), models)
        return wide.orderBy("service_year", "service_quarter")

    def afr_wide_map(self, min_drives: int = 2000) -> DataFrame:
        """As ``afr_wide``, in one pass and for any number of models: a map in each row instead of columns."""
        return afr_map.afr_wide_map(self._afr_cumulative(min_drives)).orderBy("service_year", "service_quarter")

    def afr_layout_stats(self, min_drives: int = 2000) -> DataFrame:
        return afr.afr_layout_stats(self._afr_cumulative(min_drives)).orderBy(F.asc_nulls_last("mfr"))

    # models in service

    def model_date_ranges(self) -> DataFrame:
        ranges = lifecycle.model_date_ranges(self._model_spans())
        return ranges.orderBy(F.desc("first_seen"), F.asc("drive_model"))

    def models_per_maker(self) -> DataFrame:
        per_maker = lifecycle.models_per_maker(self._model_spans())
        return per_maker.orderBy(F.asc("mfr"), F.desc("first_seen"), F.desc("last_seen"), F.asc("model"))

    def deployments(self, deploy_count_min: int = 500) -> DataFrame:
        deployed = lifecycle.deployments(self._drive_spans(), deploy_count_min)
        return deployed.orderBy(
            F.desc("deployed_year_quarter"), F.desc("drives_deployed_this_qtr"), F.asc("mfr"), F.asc("model")
        )

    def deployments_with_subtotals(self, deploy_count_min: int = 500) -> DataFrame:
        deployed = lifecycle.deployments_with_subtotals(self._drive_spans(), deploy_count_min)
        return deployed.orderBy(
            F.desc("deployed_year_quarter"),
            F.asc("is_subtotal"),
            F.desc("drives_deployed_this_qtr"),
            F.asc("mfr"),
            F.asc("model"),
        )

    def distribution(self, min_drives: int = 0) -> DataFrame:
        shares = distribution.distribution(self._quarters(), min_drives, self.on_unknown)
        return self._largest_first(shares)

    def distribution_with_totals(self, min_drives: int = 0) -> DataFrame:
        shares = distribution.distribution_with_totals(self._quarters(), min_drives, self.on_unknown)
        return self._largest_first(shares)

    @staticmethod
    def _largest_first(shares: DataFrame) -> DataFrame:
        return shares.orderBy(F.desc("year"), F.desc("quarter"), F.desc("unique_serial_numbers"), F.asc("model_name"))

    # capacity

    def capacity(self) -> DataFrame:
        return capacity.capacity_fleet(self._quarters("capacity_bytes", all_models=True)).orderBy("year", "quarter")

    def _located_quarters(self) -> DataFrame:
        return self._quarters("datacenter", "capacity_bytes", all_models=True)

    def capacity_by_datacenter(self, large_groups: bool = False) -> DataFrame:
        by_datacenter = capacity.capacity_by_datacenter(self._located_quarters(), large_groups)
        return by_datacenter.orderBy("year", "quarter", "datacenter")

    def capacity_datacenter_report(self) -> DataFrame:
        report = capacity.capacity_datacenter_report(self._located_quarters())
        return report.orderBy(F.desc("year"), F.desc("quarter"))

    def capacity_by_maker(self) -> DataFrame:
        by_maker = capacity.capacity_by_maker(self._quarters("capacity_bytes"), self.on_unknown)
        return by_maker.orderBy("year", "quarter", "drive_mfr")

    def capacity_maker_report(self) -> DataFrame:
        report = capacity.capacity_maker_report(self._quarters("capacity_bytes"), self.on_unknown)
        return report.orderBy(F.desc("year"), F.desc("quarter"))

    # dimensions: unsorted, one row per model or drive

    def drive_models(self) -> DataFrame:
        return dimensions.drive_models(self._daily())

    def drives(self, models: DataFrame | None = None) -> DataFrame:
        return dimensions.drives(self._daily(), models)
