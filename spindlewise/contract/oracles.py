"""The named queries in SQL for an independent engine (DuckDB dialect).

Written the direct way, from the daily rows each time, with joins where the Spark reports use
windows or summaries.
"""

from __future__ import annotations

from spindlewise.contract.parameters import DEPLOY_COUNT_MIN, MIN_DISTRIBUTION, MIN_DRIVES
from spindlewise.plans.afr import WIDE_MEASURES
from spindlewise.sources.bridge import DRIVE_DAYS_SQL
from spindlewise.sources.patterns import BRANDS, FAMILIES, FLEET_MODELS

INTERESTING = "regexp_matches(model, '" + "|".join(FLEET_MODELS) + "')"

DAYS = "drive_days AS (" + DRIVE_DAYS_SQL.replace("{lineitem}", "lineitem") + ")"

MAPPING = (
    r"""
tokens AS (
  SELECT model, string_split(trim(regexp_replace(model, '\s+', ' ', 'g')), ' ') AS t
  FROM (SELECT DISTINCT model FROM drive_days WHERE """
    + INTERESTING
    + r""")
),
mapping AS (
  SELECT model AS smart,
    CASE WHEN len(t) = 1 AND regexp_matches(t[1], '^ST\d+') THEN 'Seagate ' || t[1]
         WHEN len(t) = 1 AND regexp_matches(t[1], '^WU[HS]72') THEN 'WDC/HGST ' || t[1]
         WHEN len(t) = 2 AND t[1] IN ('HGST', 'WDC', 'WDC/HGST') THEN 'WDC/HGST ' || t[2]
         WHEN len(t) = 2 AND t[1] IN ('TOSHIBA', 'Toshiba') THEN 'Toshiba ' || t[2]
         WHEN len(t) = 2 AND t[1] = 'Seagate' THEN 'Seagate ' || t[2]
         ELSE error('unknown model ' || model) END AS normalized
  FROM tokens
),
fleet AS (
  SELECT m.normalized AS model_name, d.*,
    CAST(year(d.date) AS INTEGER) AS year, CAST(quarter(d.date) AS INTEGER) AS quarter
  FROM drive_days d JOIN mapping m ON d.model = m.smart
)"""
)

AFR_QUARTERLY = """
afr_quarterly AS (
  SELECT model_name, year, quarter, count(DISTINCT serial_number) AS qtr_unique_drives_deployed,
    count(failure) AS qtr_drive_days, CAST(sum(failure) AS BIGINT) AS qtr_failure_count
  FROM fleet GROUP BY model_name, year, quarter
)"""

LIFETIMES = """
lifetimes AS (
  SELECT model_name, serial_number, min(date) AS first_seen, max(date) AS last_seen
  FROM fleet GROUP BY model_name, serial_number
),
deployed AS (
  SELECT model_name, CAST(year(first_seen) AS INTEGER) AS deploy_year,
    CAST(quarter(first_seen) AS INTEGER) AS deploy_quarter, count(serial_number) AS new_drives
  FROM lifetimes GROUP BY ALL
),
removed AS (
  SELECT model_name, CAST(year(last_seen) AS INTEGER) AS remove_year,
    CAST(quarter(last_seen) AS INTEGER) AS remove_quarter, count(serial_number) AS removed_drives
  FROM lifetimes WHERE last_seen < (SELECT max(last_seen) FROM lifetimes) GROUP BY ALL
)"""

ENRICHED = """
enriched AS (
  SELECT a.model_name, a.year, a.quarter, coalesce(d.new_drives, 0) AS qtr_new_drives,
    a.qtr_unique_drives_deployed, coalesce(r.removed_drives, 0) AS qtr_removed_drives,
    a.qtr_failure_count, a.qtr_drive_days
  FROM afr_quarterly a
  LEFT JOIN deployed d ON d.model_name = a.model_name AND d.deploy_year = a.year AND d.deploy_quarter = a.quarter
  LEFT JOIN removed r ON r.model_name = a.model_name AND r.remove_year = a.year AND r.remove_quarter = a.quarter
)"""

CUMULATIVE = f"""
running AS (
  SELECT *, sum(qtr_drive_days) OVER w AS days, sum(qtr_failure_count) OVER w AS failures,
    max(year * 10 + quarter) OVER () AS newest
  FROM enriched WINDOW w AS (PARTITION BY model_name ORDER BY year, quarter ROWS UNBOUNDED PRECEDING)
),
kept AS (
  SELECT *, CAST(failures AS DOUBLE) / days * 365.0 * 100.0 AS rate,
    row_number() OVER (PARTITION BY model_name ORDER BY year, quarter) AS n
  FROM running WHERE qtr_unique_drives_deployed >= {MIN_DRIVES}
),
cumulative AS (
  SELECT split_part(model_name, ' ', 1) AS mfr, split_part(model_name, ' ', 2) AS model,
    year || ' Q' || quarter AS year_quarter,
    CAST((n - 1) // 4 + 1 AS INTEGER) AS service_year, CAST((n - 1) % 4 + 1 AS INTEGER) AS service_quarter,
    round(rate, 6) AS afr,
    round(rate - coalesce(lag(rate) OVER w, 0), 6) AS afr_delta,
    qtr_unique_drives_deployed AS unique_drives_deployed,
    qtr_unique_drives_deployed - coalesce(lag(qtr_unique_drives_deployed) OVER w, 0) AS drives_delta,
    qtr_new_drives,
    CASE WHEN year * 10 + quarter = newest THEN qtr_failure_count ELSE qtr_removed_drives END AS qtr_removed_drives,
    qtr_failure_count AS failure_count
  FROM kept WINDOW w AS (PARTITION BY model_name ORDER BY year, quarter)
)"""

MAKER = r"""
    CASE WHEN regexp_matches(model, '^.*\s*ST\d{2}000NM[0-9A-Z]{4}$') THEN 'Seagate'
         WHEN regexp_matches(model, '^.*\s*[HW]U[HS]72\d{4}[A-Z0-9]{6}$') THEN 'WDC/HGST'
         WHEN regexp_matches(model, '^.*\s*MG\d{2}[A-Z0-9]{7,}$') THEN 'Toshiba'
         ELSE model END"""

DEPLOYMENTS = f"""
starts AS (
  SELECT model, serial_number, min(date) AS first_seen FROM drive_days
  WHERE {INTERESTING} GROUP BY model, serial_number
),
deployments AS (
  SELECT year(first_seen) || ' Q' || quarter(first_seen) AS deployed_year_quarter,
    {MAKER} AS mfr, string_split(model, ' ')[-1] AS model,
    count(serial_number) AS drives_deployed_this_qtr
  FROM starts GROUP BY ALL HAVING count(serial_number) >= {DEPLOY_COUNT_MIN}
)"""

DISTRIBUTION = f"""
distribution AS (
  SELECT year, quarter, model_name, count(DISTINCT serial_number) AS unique_serial_numbers
  FROM fleet GROUP BY ALL HAVING count(DISTINCT serial_number) >= {MIN_DISTRIBUTION}
)"""

DATACENTERS = """
located AS (
  SELECT year(date) AS year, quarter(date) AS quarter, upper(datacenter) AS datacenter, model,
    count(DISTINCT serial_number) AS drives, median(capacity_bytes) AS capacity
  FROM drive_days WHERE datacenter IS NOT NULL AND length(upper(datacenter)) >= 4 GROUP BY ALL
),
by_datacenter AS (
  SELECT CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, datacenter,
    sum(drives * capacity) / 1e18 AS eb, sum(drives * CAST(2 * capacity AS HUGEINT)) AS doubled
  FROM located GROUP BY ALL
)"""

MAKERS = """
capacities AS (
  SELECT model_name, capacity_bytes, row_number() OVER (
    PARTITION BY model_name ORDER BY count(*) DESC, capacity_bytes) AS place
  FROM fleet WHERE capacity_bytes IS NOT NULL GROUP BY model_name, capacity_bytes
),
per_model AS (
  SELECT f.year, f.quarter, f.model_name, c.capacity_bytes, count(DISTINCT f.serial_number) AS drives
  FROM fleet f JOIN capacities c ON c.model_name = f.model_name AND c.place = 1 GROUP BY ALL
),
by_maker AS (
  SELECT year, quarter, split_part(model_name, ' ', 1) AS drive_mfr,
    sum(CAST(capacity_bytes AS HUGEINT) * drives) AS bytes, CAST(bytes AS DOUBLE) / 1e15 AS pb
  FROM per_model GROUP BY ALL
),
with_total AS (SELECT *, sum(pb) OVER (PARTITION BY year, quarter) AS total FROM by_maker)"""

MODELS = """
model_capacities AS (
  SELECT model, capacity_bytes, row_number() OVER (
    PARTITION BY model ORDER BY capacity_bytes IS NULL, count(*) DESC, capacity_bytes) AS place
  FROM drive_days GROUP BY model, capacity_bytes
),
dim_models AS (
  SELECT sha256(length(model) || ':' || model) AS drive_model_id, model AS drive_model_smart,
    round(capacity_bytes / 1e12, 6) AS capacity_tb
  FROM model_capacities WHERE place = 1
)"""

DRIVES = """
drive_names AS (
  SELECT serial_number, model, row_number() OVER (
    PARTITION BY serial_number ORDER BY count(*) DESC, model) AS place
  FROM drive_days GROUP BY serial_number, model
),
dim_drives AS (
  SELECT sha256(concat_ws(':', length(m.drive_model_id), m.drive_model_id, length(d.serial_number), d.serial_number))
      AS drive_id,
    m.drive_model_id, d.serial_number
  FROM drive_names d JOIN dim_models m ON m.drive_model_smart = d.model WHERE d.place = 1
)"""

SNAPSHOTS = """
log AS (
  SELECT printf('%019d-x.metadata.json', o_orderkey) AS file_name,
    o_orderkey AS version, epoch_ms(o_orderdate) AS last_updated_ms,
    strftime(o_orderdate, '%Y-%m-%d') AS snapshot_date,
    year(o_orderdate) || ' Q' || quarter(o_orderdate) AS year_quarter
  FROM orders
)"""

CALENDAR = """
SELECT year_quarter, min(snapshot_date) AS date_min, max(snapshot_date) AS date_max FROM log GROUP BY year_quarter"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _first_label(labelled: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN regexp_matches(model, '{pattern}') THEN '{label}'" for pattern, label in labelled)
    return f"CASE {cases} ELSE '(none)' END"


# The models of the stand-in table, by name; a pivot that finds its own cannot be a view.
WIDE_MODELS = [
    "Seagate ST12000NM0007",
    "Seagate ST16000NM001G",
    "Seagate ST24000NM002H",
    "Toshiba MG07ACA14TA",
    "Toshiba MG08ACA16TEY",
    "WDC/HGST HUH721212ALE604",
    "WDC/HGST WUH721816ALE6L4",
]


def _wide() -> str:
    cells = [
        f"""max(CASE WHEN mfr || ' ' || model = '{name}' THEN round(CAST({column} AS DOUBLE), 6) END) AS "{name}_{measure}\""""
        for name in WIDE_MODELS
        for measure, column in WIDE_MEASURES.items()
    ]
    return f"SELECT service_year, service_quarter, {', '.join(cells)} FROM cumulative GROUP BY service_year, service_quarter"


_AFR = (DAYS, MAPPING, AFR_QUARTERLY, LIFETIMES, ENRICHED, CUMULATIVE)

ORACLES: dict[str, str] = {
    "scan_drive_days": _with(
        DAYS,
        select="""SELECT strftime(date, '%Y-%m-%d') AS date, model, serial_number, failure, capacity_bytes, datacenter
FROM drive_days""",
    ),
    "filter_models_regex": _with(
        DAYS,
        select=f"SELECT strftime(date, '%Y-%m-%d') AS date, model, serial_number FROM drive_days WHERE {INTERESTING}",
    ),
    "candidate_models": _with(
        DAYS, select=f"SELECT DISTINCT model AS drive_model_name_smart FROM drive_days WHERE {INTERESTING}"
    ),
    "model_mapping": _with(
        DAYS,
        MAPPING,
        select="SELECT smart AS drive_model_name_smart, normalized AS drive_model_name_normalized FROM mapping",
    ),
    "classify_mfr": _with(
        DAYS, select=f"SELECT model, {_first_label(BRANDS)} AS mfr FROM (SELECT DISTINCT model FROM drive_days)"
    ),
    "classify_family": _with(
        DAYS,
        select="SELECT model, "
        + _first_label([(pattern, family) for family, patterns in FAMILIES.items() for pattern in patterns])
        + " AS family FROM (SELECT DISTINCT model FROM drive_days)",
    ),
    "afr_quarterly": _with(DAYS, MAPPING, AFR_QUARTERLY, select="SELECT * FROM afr_quarterly"),
    "drive_lifetimes": _with(
        DAYS,
        MAPPING,
        LIFETIMES,
        select="""SELECT model_name, serial_number, strftime(first_seen, '%Y-%m-%d') AS first_seen,
  strftime(last_seen, '%Y-%m-%d') AS last_seen FROM lifetimes""",
    ),
    "drives_deployed_qtr": _with(DAYS, MAPPING, LIFETIMES, select="SELECT * FROM deployed"),
    "drives_removed_qtr": _with(DAYS, MAPPING, LIFETIMES, select="SELECT * FROM removed"),
    "afr_enriched": _with(*_AFR[:5], select="SELECT * FROM enriched"),
    "afr_cumulative": _with(*_AFR, select="SELECT * FROM cumulative"),
    "afr_wide": _with(*_AFR, select=_wide()),
    "afr_layout_stats": _with(
        *_AFR,
        select="""SELECT coalesce(mfr, '(all)') AS mfr, count(*) AS models, max(quarters) AS longest_history
FROM (SELECT mfr, model, count(*) AS quarters FROM cumulative GROUP BY mfr, model) GROUP BY ROLLUP (mfr) HAVING count(*) > 0""",
    ),
    "model_date_ranges": _with(
        DAYS,
        r"""
spans AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(model,
      '^.*(ST\d{2}000NM[0-9A-Z]{4})$', 'Seagate \1'),
      '^.*([HW]U[HS]72\d{4}[A-Z0-9]{6})$', 'WDC/HGST \1'),
      '^\s*(?:Toshiba|TOSHIBA)\s+(MG\d{2}[A-Z0-9]{7})$', 'Toshiba \1') AS drive_model,
    min(date) AS first_date, max(date) AS last_date
  FROM drive_days WHERE """
        + INTERESTING
        + """ GROUP BY ALL
),
marked AS (SELECT *, last_date = (SELECT max(last_date) FROM spans) AS in_service,
  year(last_date) || ' Q' || quarter(last_date) AS last_seen FROM spans)""",
        select="""SELECT drive_model, year(first_date) || ' Q' || quarter(first_date) AS first_seen, last_seen,
  strftime(last_date, '%Y-%m-%d') AS last_seen_date, in_service,
  CASE WHEN in_service THEN 'currently deployed' ELSE 'removed from use: ' || last_seen END AS status FROM marked""",
    ),
    "models_per_mfr": _with(
        DAYS,
        f"""
spans AS (
  SELECT {MAKER} AS mfr, string_split(model, ' ')[-1] AS model,
    min(year(date) || ' Q' || quarter(date)) AS first_seen, max(year(date) || ' Q' || quarter(date)) AS last_seen
  FROM drive_days WHERE {INTERESTING} GROUP BY ALL
)""",
        select="""SELECT mfr, first_seen, last_seen, model, last_seen = (SELECT max(last_seen) FROM spans)
    AS deployed_currently,
  CASE WHEN last_seen = (SELECT max(last_seen) FROM spans) THEN 'currently deployed'
       ELSE 'last seen: ' || last_seen END AS status FROM spans""",
    ),
    "deployments_qtr": _with(DAYS, DEPLOYMENTS, select="SELECT * FROM deployments"),
    "deployments_subtotals": _with(
        DAYS,
        DEPLOYMENTS,
        select="""SELECT deployed_year_quarter, mfr, model, drives_deployed_this_qtr, false AS is_subtotal FROM deployments
UNION ALL
SELECT deployed_year_quarter, '(all)', '(all)', CAST(sum(drives_deployed_this_qtr) AS BIGINT), true
FROM deployments GROUP BY deployed_year_quarter""",
    ),
    "distribution_qtr": _with(DAYS, MAPPING, DISTRIBUTION, select="SELECT * FROM distribution"),
    "distribution_totals": _with(
        DAYS,
        MAPPING,
        DISTRIBUTION,
        select="""SELECT d.*, t.total_drives FROM distribution d JOIN (
  SELECT year, quarter, CAST(sum(unique_serial_numbers) AS BIGINT) AS total_drives
  FROM distribution GROUP BY year, quarter) t ON t.year = d.year AND t.quarter = d.quarter""",
    ),
    "capacity_fleet": _with(
        DAYS,
        """
counted AS (
  SELECT year(date) AS year, quarter(date) AS quarter, model, capacity_bytes, count(*) AS n
  FROM drive_days GROUP BY ALL
),
modes AS (
  SELECT *, row_number() OVER (PARTITION BY year, quarter, model ORDER BY n DESC, capacity_bytes) AS place
  FROM counted WHERE capacity_bytes IS NOT NULL
),
drives AS (
  SELECT year(date) AS year, quarter(date) AS quarter, model, count(DISTINCT serial_number) AS drives
  FROM drive_days GROUP BY ALL
),
totals AS (
  SELECT CAST(d.year AS INTEGER) AS year, CAST(d.quarter AS INTEGER) AS quarter,
    sum(CAST(m.capacity_bytes AS HUGEINT) * d.drives) AS bytes, CAST(bytes AS DOUBLE) / 1e18 AS eb
  FROM drives d JOIN modes m ON m.year = d.year AND m.quarter = d.quarter AND m.model = d.model AND m.place = 1
  GROUP BY ALL
)""",
        select="""SELECT year, quarter, CAST(bytes AS VARCHAR) AS raw_storage_bytes, round(eb, 6) AS raw_storage_eb,
  round(eb - lag(eb) OVER (ORDER BY year, quarter), 6) AS delta_eb FROM totals""",
    ),
    "capacity_by_dc": _with(
        DAYS,
        DATACENTERS,
        select="""SELECT year, quarter, datacenter, CAST(doubled AS VARCHAR) AS doubled_bytes,
  round(eb, 6) AS raw_storage_eb FROM by_datacenter""",
    ),
    "capacity_dc_report": _with(
        DAYS,
        DATACENTERS,
        select="""SELECT year, quarter, round(sum(eb), 6) AS total_eb,
  string_agg(printf('%s = %4.2f EB', datacenter, round(eb, 2)), ', ' ORDER BY datacenter) AS datacenters
FROM by_datacenter GROUP BY year, quarter""",
    ),
    "capacity_by_mfr": _with(
        DAYS,
        MAPPING,
        MAKERS,
        select="""SELECT year, quarter, drive_mfr, CAST(bytes AS VARCHAR) AS raw_capacity_bytes, round(pb, 6) AS raw_capacity_pb, round(total, 6) AS total_pb,
  round(pb / total * 100, 6) AS share_pct FROM with_total""",
    ),
    "capacity_mfr_report": _with(
        DAYS,
        MAPPING,
        MAKERS,
        select="""SELECT year, quarter, round(max(total), 6) AS total_pb,
  string_agg(drive_mfr || ' = ' || format('{:>8}', format('{:,.1f}', round(pb, 1)))
    || ' (' || lpad(CAST(CAST(round(pb / total * 100, 0) AS INTEGER) AS VARCHAR), 3, ' ') || '%)',
    '    ' ORDER BY drive_mfr) AS makers
FROM with_total GROUP BY year, quarter""",
    ),
    "dim_drive_models": _with(DAYS, MODELS, select="SELECT * FROM dim_models"),
    "dim_drives": _with(DAYS, MODELS, DRIVES, select="SELECT * FROM dim_drives"),
    "dim_constraint_checks": _with(
        DAYS,
        MODELS,
        DRIVES,
        """
model_counts AS (
  SELECT count(*) AS n, count(drive_model_smart) - count(DISTINCT drive_model_smart) AS duplicates,
    count(drive_model_id) - count(DISTINCT drive_model_id) AS repeated,
    count(*) - count(drive_model_smart) AS nameless, count(*) - count(capacity_tb) AS sizeless FROM dim_models
),
drive_counts AS (
  SELECT count(*) AS n, count(serial_number) - count(DISTINCT drive_model_id || serial_number) AS duplicates,
    count(drive_id) - count(DISTINCT drive_id) AS repeated,
    count(*) - count(serial_number) AS serialless, count(*) - count(drive_model_id) AS modelless,
    count(*) FILTER (WHERE drive_model_id NOT IN (SELECT drive_model_id FROM dim_models)) AS orphans FROM dim_drives
)""",
        select="""SELECT 'duplicate_model' AS "constraint", duplicates AS violations, n AS rows_checked FROM model_counts
UNION ALL SELECT 'missing_model_name', nameless, n FROM model_counts
UNION ALL SELECT 'missing_model_size', sizeless, n FROM model_counts
UNION ALL SELECT 'duplicate_drive', duplicates, n FROM drive_counts
UNION ALL SELECT 'missing_serial_number', serialless, n FROM drive_counts
UNION ALL SELECT 'missing_drive_model', modelless, n FROM drive_counts
UNION ALL SELECT 'orphan_drive', orphans, n FROM drive_counts
UNION ALL SELECT 'duplicate_drive_model_id', repeated, n FROM model_counts
UNION ALL SELECT 'duplicate_drive_id', repeated, n FROM drive_counts""",
    ),
    "snapshot_log": _with(SNAPSHOTS, select="SELECT * FROM log"),
    "snapshot_latest": _with(SNAPSHOTS, select="SELECT * FROM log WHERE file_name = (SELECT max(file_name) FROM log)"),
    "snapshot_dates_qtr": _with(SNAPSHOTS, select=CALENDAR),
    "snapshot_dates_qtr_resumed": _with(SNAPSHOTS, select=CALENDAR),
    "snapshot_dates_qtr_stream": _with(SNAPSHOTS, select=CALENDAR),
}
