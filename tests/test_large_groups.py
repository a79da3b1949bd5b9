"""Medians by digits, pattern tables, dimension merges and drive sets: small cases, and the sizes they are made for."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spindlewise.operators.capacity import with_doubled_median, with_doubled_median_by_digits
from spindlewise.operators.pattern_index import first_labels, required_text
from spindlewise.operators.selection import selected
from spindlewise.operators.shared import checkpointed
from spindlewise.operators.summary import drive_quarters
from spindlewise.plans.dimensions import drive_models, drives
from spindlewise.plans.drive_sets import DriveSets, united
from spindlewise.sinks.tables import ConstraintViolation, merge_dimensions
from spindlewise.sources import bridge
from spindlewise.sources.patterns import BRANDS
from tests.compare import spark_rows
from tests.rows import drive_days
from tests.test_plans import plan_of

FOLDER = "/root/testdata/sf0.001"

# medians


def test_places_of_signed_numbers(spark):
    random.seed(4)
    limit = 2**63 - 1
    groups = {
        "a": [(-limit - 1, 1), (limit, 2), (0, 1), (-1, 3)],
        None: [(random.randint(-(2**40), 2**40), random.randint(1, 4)) for _ in range(200)],
        "one": [(7, 1)],
    }
    counted = spark.createDataFrame([(k, v, n) for k, rows in groups.items() for v, n in rows], "g string, v long, n long")
    want, places = {}, []
    for k, rows in groups.items():
        every = sorted(v for v, n in rows for _ in range(n))
        for place in {1, 2, len(every) // 2, len(every), len(every) + 1}:
            if place >= 1:
                places.append((k, f"{place}", place))
                if place <= len(every):
                    want[k, f"{place}"] = every[place - 1]
    got = selected(counted, ["g"], "v", "n", spark.createDataFrame(places, "g string, name string, place long"))
    assert {(row.g, row.name): row.selected for row in got.collect()} == want


def test_medians_by_digits_equal_medians_by_order(spark):
    days = [(f"2024-0{m}-01", "ST12000NM0007", f"s{k}", 0, c, "AMS5") for m in (1, 2) for k, c in enumerate([5, None, -1, 9, 9, 10**15, 4])]
    days += [("2024-05-01", "ST12000NM0007", "a", 0, None, "AMS5"), ("2024-08-01", None, "a", 0, 3, None)]
    quarters = drive_quarters(drive_days(spark, days), ["datacenter", "capacity_bytes"])
    keys = ["year", "quarter", "datacenter", "model"]
    assert spark_rows(with_doubled_median_by_digits(quarters, keys)) == spark_rows(with_doubled_median(quarters, keys))
    assert with_doubled_median_by_digits(quarters.limit(0), keys).count() == 0


def test_median_of_millions_of_values_under_one_key(spark):
    n = 2_000_000
    value = (F.col("id") * 7_919_317 % n - 1_000_000) * 3_000_017
    counted = checkpointed(spark.range(n).select(F.lit(1).alias("g"), value.alias("v"), F.lit(1).cast("long").alias("n")))
    places = spark.createDataFrame([(1, "lower", n // 2), (1, "upper", n // 2 + 1)], "g int, name string, place long")
    found = selected(counted, ["g"], "v", "n", places)
    ordered = [(k - 1_000_000) * 3_000_017 for k in (n // 2 - 1, n // 2)]
    assert sorted(row.selected for row in found.collect()) == ordered
    # no plan of a round orders the values: windows see counts of leading digits
    assert "Sort" not in plan_of(counted.groupBy("g", F.shiftright("v", 48)).agg(F.sum("n")))


# pattern tables


@pytest.mark.parametrize(
    "pattern, text",
    [
        (r"\bST12000NM0007$", "ST12000NM0007"),
        (r"\bWU[HS]72", "WU"),
        (r"^a?bc+d", "bc"),
        (r"x(abc)+yz", "abcyz"),
        (r"(?:foo|bar)", ""),
        (r"(?i)abc", ""),
        (r"ab(?i:cd)ef", "ab"),
        (r"\d+", ""),
        (r"a\.b", "a.b"),
        (r"(", ""),
        (r"\p{L}abc", ""),
        (r"a{2}bc", "abc"),
        (r"(?=abc)x", "x"),
        (r"", ""),
    ],
)
def test_required_text(pattern, text):
    assert required_text(pattern) == text


def test_required_text_is_in_every_match():
    random.seed(2)
    parts = ["a", "b", "ab?", "(ab)+", "[ab]", "(a|ba)", "(ab){0,2}", r"\b", "b*", "(?:ba)", ".", "(a(b)?)+"]
    for _ in range(3000):
        pattern = "".join(random.choices(parts, k=random.randint(1, 5)))
        for text in ("".join(random.choices("ab ", k=random.randint(0, 9))) for _ in range(5)):
            for match in re.finditer(pattern, text):
                assert required_text(pattern) in match.group(), (pattern, text)


def test_first_pattern_counts(spark):
    names = spark.createDataFrame([("ST1",), ("ST1",), ("xST",), ("",), (None,), ("none",)], "model string")
    table = [(2, "ST", "later"), (1, "^ST", "first"), (3, "", "any"), (3, "", "also any"), (0, None, "never"), (0, "(?i)NONE", "case")]
    patterns = spark.createDataFrame(table, "prio int, pattern string, label string")
    got = {row.model: row.label for row in first_labels(names, patterns).collect()}
    assert got == {"ST1": "first", "xST": "later", "": "also any", "none": "case", None: None}
    assert {row.label for row in first_labels(names, patterns.limit(0)).collect()} == {None}
    assert first_labels(names.limit(0), patterns).count() == 0


def test_ten_thousand_patterns(spark):
    names = spark.range(100_000).select(F.format_string("MK%06d-X%d", F.col("id"), F.col("id") % 7).alias("model"))
    patterns = spark.range(10_000).select(
        F.col("id").cast("int").alias("prio"), F.format_string(r"\bMK%06d-X[0-6]$", F.col("id") * 11).alias("pattern"), F.format_string("L%d", "id").alias("label")
    )
    started = time.perf_counter()
    labelled = first_labels(names, patterns)
    plan = plan_of(labelled.filter("label IS NOT NULL"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = labelled.filter("label IS NOT NULL").agg(F.count("*").alias("n"), F.count_if(F.expr("int(substr(model, 3, 6)) = 11 * int(substr(label, 2))")).alias("right")).first()
    assert found.n == found.right == 100_000 // 11 + 1
    assert time.perf_counter() - started < 120


def test_brands_from_a_table_equal_brands_from_the_list(spark):
    from spindlewise.plans.classify import classify_brand

    days = bridge.drive_days(spark, FOLDER)
    table = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(BRANDS)], "prio int, pattern string, mfr string").withColumnRenamed("mfr", "label")
    assert spark_rows(first_labels(days, table).withColumnRenamed("label", "mfr")) == spark_rows(classify_brand(days))


# dimensions


def dimension_rows(spark, rows):
    days = drive_days(spark, rows)
    return drive_models(days), drives(days)


def test_only_new_rows_are_added(spark, tmp_path):
    first = [("2024-01-01", "ST12000NM0007", "a"), ("2024-01-01", "ST12000NM0007", "b")]
    assert merge_dimensions(*dimension_rows(spark, first), str(tmp_path)) == (1, 2)
    assert merge_dimensions(*dimension_rows(spark, first), str(tmp_path)) == (0, 0)
    more = [*first, ("2024-01-02", "WUH721816ALE6L4", "c"), ("2024-01-02", "ST12000NM0007", "d")]
    assert merge_dimensions(*dimension_rows(spark, more), str(tmp_path)) == (1, 2)
    assert spark_rows(spark.read.parquet(str(tmp_path / "drives"))) == spark_rows(dimension_rows(spark, more)[1])
    models, rows = dimension_rows(spark, more[:3])
    assert merge_dimensions(models.unionByName(models), rows.unionByName(rows), str(tmp_path)) == (0, 0)  # repeated rows


def test_a_merge_that_breaks_a_constraint_changes_nothing(spark, tmp_path):
    models, rows = dimension_rows(spark, [("2024-01-01", "ST12000NM0007", "a")])
    merge_dimensions(models, rows, str(tmp_path))
    before = [spark_rows(spark.read.parquet(str(tmp_path / name))) for name in ("drive_models", "drives")]
    other, other_rows = dimension_rows(spark, [("2024-01-01", "WUH721816ALE6L4", "z")])
    broken = [
        (models.withColumn("drive_model_id", F.lit("second id")), rows.limit(0)),  # the name is stored under another id
        (other.limit(0), other_rows),  # a drive of a model that nobody has
        (other.withColumn("capacity_tb", F.lit(None).cast("decimal(19,12)")), other_rows),
    ]
    for pair in broken:
        with pytest.raises(ConstraintViolation):
            merge_dimensions(*pair, str(tmp_path))
    assert [spark_rows(spark.read.parquet(str(tmp_path / name))) for name in ("drive_models", "drives")] == before


# drive sets


def test_sets_count_distinct_drives_over_any_span(spark, tmp_path):
    days = bridge.drive_days(spark, FOLDER)
    sets = DriveSets(spark, str(tmp_path / "sets"))
    for year in (1999, 1996, 1997):
        sets.add(drive_quarters(days.filter(F.year("date") == year), ["datacenter"]))
    sets.add(drive_quarters(days.filter(F.year("date") == 1997), ["datacenter"]))  # again
    kept = days.filter(F.year("date").isin(1996, 1997, 1999)).withColumn("year", F.year("date"))
    for span in (["year"], ["model"], ["datacenter"], ["model", "year"], []):
        want = kept.groupBy(*span).agg(F.countDistinct("serial_number").alias("drives"))
        assert spark_rows(sets.count(*span)) == spark_rows(want)
    codes = sets.codes()
    assert codes.count() == codes.select("serial_number").distinct().count() == codes.select("code").distinct().count()


def test_counting_moves_bit_maps_only(spark, tmp_path):
    sets = DriveSets(spark, str(tmp_path / "sets"))
    assert sets.count("year").count() == 0
    sets.add(drive_quarters(drive_days(spark, [("2024-01-01", "m", None), ("2024-01-01", "m", "a"), ("2024-04-01", "n", "a")]), ["datacenter"]))
    plan = plan_of(sets.count("year"))
    assert "serial_number" not in plan and sets.count("year").first().drives == 1
    assert united(sets.sets(), "year").count() == 1
