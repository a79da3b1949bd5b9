"""Model patterns: the fixed lists and JSON files with others."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

# Which models the reports cover.
FLEET_MODELS = [
    r"\b[HW]UH72[123]\d{3}AL[A-Z0-9]{4}$",
    r"\bST(?:1[2-9]|[2-4]\d)\d{3}NM[A-Z0-9]{4}$",
    r"\bMG[01]\dACA[123]\dT\w+$",
]

# Brand by pattern, first match wins.
BRANDS = [
    (r"\bHU[HS]72", "HGST"),
    (r"\bHGST\s+(HMS|HDS)", "HGST"),
    (r"\bHitachi\s+(HDS|HDT)", "HGST"),
    (r"\bST\d+(LM|NM|DM|DX)\d+", "Seagate"),
    (r"\bST\w+$", "Seagate"),
    (r"\bHDW[EF]\d+", "Toshiba"),
    (r"\bMG(0[789]|1[01])", "Toshiba"),
    (r"\bMQ01ABF", "Toshiba"),
    (r"\bMD04", "Toshiba"),
    (r"\bTOSHIBA\s+DT01", "Toshiba"),
    (r"\bWD\d+LP[CV]X", "Western Digital"),
    (r"\bWD\d+BPKT", "Western Digital"),
    (r"\bWD\d+EFRX", "Western Digital"),
    (r"\bWU[HS]72", "Western Digital"),
    (r"\bWD\d+\w+$", "Western Digital"),
]

# Product family by model number.
FAMILIES = {
    "Seagate Exos 7E8": [r"\bST8000NM000A$", r"\bST8000NM0055$"],
    "Seagate Exos X10": [r"\bST10000NM0086$"],
    "Seagate Exos X12": [r"\bST12000NM0007$", r"\bST12000NM0117$"],
    "Seagate Exos X14": [r"\bST12000NM0008$", r"\bST14000NM0018$", r"\bST14000NM0138$"],
    "Seagate Exos X16": [
        r"\bST10000NM001G$",
        r"\bST12000NM001G$",
        r"\bST12000NM003G$",
        r"\bST14000NM001G$",
        r"\bST16000NM001G$",
        r"\bST16000NM005G$",
    ],
    "Seagate Exos X18": [
        r"\bST12000NM000J$",
        r"\bST14000NM000J$",
        r"\bST14000NM002J$",
        r"\bST16000NM000J$",
        r"\bST16000NM002J$",
        r"\bST18000NM000J$",
    ],
    "Seagate Exos X24": [r"\bST24000NM002H$"],
    "WD Ultrastar 7K6000": [r"\bHUS726040ALE610$", r"\bHUS726040ALN610$"],
    "WD Ultrastar He8": [r"\bHUH728080ALE600$", r"\bHUH728080ALE604$"],
    "WD Ultrastar DC HC300": [r"\bHUS728T8TALE6L4$"],
    "WD Ultrastar DC HC500": [
        r"\bHUH721010ALE600$",
        r"\bHUH721212ALE600$",
        r"\bHUH721212ALE604$",
        r"\bHUH721212ALN604$",
        r"\bWUH721414ALE6L4$",
        r"\bWUH721816ALE6L0$",
        r"\bWUH721816ALE6L4$",
        r"\bWUH722222ALE6L4$",
    ],
}


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns from a JSON file that holds one list of strings, on any file system Spark reads.

    The list becomes part of the query text, so it is read while the query is put together.
    """
    return _document(spark, path, list)


def read_labels(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(pattern, label) pairs, in file order, from a JSON object ``{pattern: label}``."""
    return list(_document(spark, path, dict).items())


def read_families(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Family -> patterns from a JSON object of lists."""
    return _document(spark, path, dict)


def _document(spark: SparkSession, path: str, kind: type):
    document = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(document, kind):
        raise ValueError(f"{path} holds a JSON {type(document).__name__}, not a {kind.__name__}")
    return document
