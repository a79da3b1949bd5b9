import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindlewise import DriveFleet
from spindlewise.functions import names
from spindlewise.operators.naming import with_model_name
from spindlewise.plans.classify import classify_brand, classify_family
from spindlewise.plans.models import unknown_models
from spindlewise.sources.patterns import FLEET_MODELS
from tests.rows import drive_days

STRICT = {
    "ST12000NM0007": "Seagate ST12000NM0007",
    "Seagate ST16000NM001G": "Seagate ST16000NM001G",
    "  HGST   HUH721212ALE604 ": "WDC/HGST HUH721212ALE604",
    "WDC\tWUH721816ALE6L4": "WDC/HGST WUH721816ALE6L4",
    "WDC/HGST X1": "WDC/HGST X1",
    "WUH721816ALE6L4": "WDC/HGST WUH721816ALE6L4",
    "WUS721010ALE6L4": "WDC/HGST WUS721010ALE6L4",
    "TOSHIBA  MG08ACA16TEY": "Toshiba MG08ACA16TEY",
    "Toshiba MG07ACA14TA": "Toshiba MG07ACA14TA",
    # no rule
    "MG07ACA14TA": None,
    "HUH721212ALE604": None,
    "WDC X Y": None,
    "Samsung SSD": None,
    "": None,
    # the start must match, not just some part
    "XST12000": None,
}


def one_column(spark, values, name="model"):
    return spark.createDataFrame([(value,) for value in values], f"{name} string")


def test_strict_names(spark):
    named = with_model_name(one_column(spark, STRICT), "null")
    assert {row.model: row.model_name for row in named.collect()} == STRICT


def test_unknown_names_can_be_dropped(spark):
    kept = with_model_name(one_column(spark, STRICT), "drop")
    assert {row.model for row in kept.collect()} == {raw for raw, name in STRICT.items() if name}


@pytest.mark.parametrize("raw", ["MG07ACA14TA", "WDC X Y", "Samsung SSD"])
def test_unknown_names_fail_the_job(spark, raw):
    with pytest.raises(PySparkException, match="no maker known for drive model"):
        with_model_name(one_column(spark, [raw])).collect()


def test_on_unknown_is_checked(spark):
    with pytest.raises(ValueError):
        with_model_name(one_column(spark, ["x"]), "ignore")


def test_dated_names_let_long_toshiba_models_pass(spark):
    got = one_column(spark, ["TOSHIBA MG07ACA14TA", "TOSHIBA MG08ACA16TEY", "ST4000DM000", "x ST16000NM001G"]).select(
        names.dated_model(F.col("model"))
    )
    # the model number has to end exactly seven characters after the series digits
    assert [row[0] for row in got.collect()] == [
        "Toshiba MG07ACA14TA",
        "TOSHIBA MG08ACA16TEY",
        "ST4000DM000",
        "Seagate ST16000NM001G",
    ]


def test_maker_labels_accept_long_toshiba_models(spark):
    got = one_column(
        spark, ["TOSHIBA MG08ACA16TEY", "MG07ACA14TA", "HGST HUH721212ALE604", "ST16000NM001G", "ST4000DM000"]
    ).select(names.maker_label(F.col("model")), names.model_token(F.col("model")))
    assert [tuple(row) for row in got.collect()] == [
        ("Toshiba", "MG08ACA16TEY"),
        ("Toshiba", "MG07ACA14TA"),
        ("WDC/HGST", "HUH721212ALE604"),
        ("Seagate", "ST16000NM001G"),
        ("ST4000DM000", "ST4000DM000"),
    ]


def test_model_filter_searches(spark):
    got = one_column(
        spark,
        [
            "HGST HUH721212ALE604",
            "ST12000NM0007",
            "ST10000NM0086",
            "ST8000NM0055",
            "TOSHIBA MG07ACA14TA",
            "ST12000NM0007 ",
            "XST12000NM0007",
            None,
        ],
    ).filter(names.matches_any(F.col("model"), FLEET_MODELS))
    assert [row.model for row in got.collect()] == ["HGST HUH721212ALE604", "ST12000NM0007", "TOSHIBA MG07ACA14TA"]


def test_empty_pattern_list_is_refused():
    with pytest.raises(ValueError):
        names.any_pattern([])


def test_alternatives_stay_within_their_pattern(spark):
    got = one_column(spark, ["ab", "b", "c"]).filter(names.matches_any(F.col("model"), ["^a|x$", "c"]))
    assert [row.model for row in got.collect()] == ["ab", "c"]


def test_brand_takes_the_first_pattern(spark):
    models = ["HGST HUH721212ALE604", "WDC WUH721816ALE6L4", "Hitachi HDS722020ALA330", "WDC WD30EFRX", "Samsung SSD"]
    got = {row.model: row.mfr for row in classify_brand(one_column(spark, models * 2)).collect()}
    assert got == dict(zip(models, ["HGST", "Western Digital", "HGST", "Western Digital", None]))
    ordered = classify_brand(one_column(spark, ["both"]), [("bo", "first"), ("th", "second")])
    assert ordered.first().mfr == "first"


def test_family(spark):
    models = ["ST8000NM0055", "ST24000NM002H", "HGST HUH728080ALE604", "TOSHIBA MG07ACA14TA"]
    got = {row.model: row.family for row in classify_family(one_column(spark, models)).collect()}
    assert got == dict(zip(models, ["Seagate Exos 7E8", "Seagate Exos X24", "WD Ultrastar He8", None]))


def test_unknown_models_are_listed(spark):
    days = drive_days(
        spark,
        [("2024-01-01", "MG07ACA14TA", "a"), ("2024-01-01", "ST12000NM0007", "b"), ("2024-01-02", "MG07ACA14TA", "a")],
    )
    assert [row[0] for row in unknown_models(days, FLEET_MODELS).collect()] == ["MG07ACA14TA"]
    fleet = DriveFleet(days, on_unknown="drop")
    assert [row.model_name for row in fleet.afr_quarterly().collect()] == ["Seagate ST12000NM0007"]
    with pytest.raises(PySparkException):
        DriveFleet(days).afr_quarterly().collect()
