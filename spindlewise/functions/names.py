"""Model-name expressions.

Three spellings of "normalized" are in use and differ on purpose:

* ``normalized_model`` - strict; maker and model, anything else is unknown;
* ``dated_model`` - lenient; known families get a maker prefix, other text passes through;
* ``maker_label`` / ``model_token`` - maker and model as two separate columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, labels and names that results depend on.
SEAGATE, WDC_HGST, TOSHIBA = "Seagate", "WDC/HGST", "Toshiba"

PREFIXLESS_MODELS = [
    (r"^ST\d+", SEAGATE),
    (r"^WU[HS]72", WDC_HGST),
]

MAKER_SPELLINGS = {
    "TOSHIBA": TOSHIBA,
    "HGST": WDC_HGST,
    "WDC": WDC_HGST,
}

KNOWN_MAKERS = [WDC_HGST, SEAGATE, TOSHIBA]

DATED_MODELS = [
    (r"^.*(ST\d{2}000NM[0-9A-Z]{4})$", "Seagate $1"),
    (r"^.*([HW]U[HS]72\d{4}[A-Z0-9]{6})$", "WDC/HGST $1"),
    (r"^\s*(?:Toshiba|TOSHIBA)\s+(MG\d{2}[A-Z0-9]{7})$", "Toshiba $1"),
]

MAKER_MODELS = [
    (r"^.*\s*ST\d{2}000NM[0-9A-Z]{4}$", SEAGATE),
    (r"^.*\s*[HW]U[HS]72\d{4}[A-Z0-9]{6}$", WDC_HGST),
    (r"^.*\s*MG\d{2}[A-Z0-9]{7,}$", TOSHIBA),
]


def any_pattern(patterns: Sequence[str]) -> str:
    """One regular expression that matches where any of ``patterns`` does."""
    if not patterns:
        raise ValueError("at least one model pattern is needed")
    return "|".join(f"(?:{pattern})" for pattern in patterns)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Search (not full match) for any of the patterns."""
    return text.rlike(any_pattern(patterns))


def first_label(text: Column, labelled: Sequence[tuple[str, str]]) -> Column:
    """Label of the first pattern found in ``text``; null when none is."""
    label = F
    for pattern, name in labelled:
        label = label.when(text.rlike(pattern), F.lit(name))
    return label


WHITESPACE = " \t\n\r\f\v"


def name_tokens(raw: Column) -> Column:
    return F.split(F.trim(raw, F.lit(WHITESPACE)), r"\s+")


def normalized_model(tokens: Column, unknown: Column) -> Column:
    """``<maker> <model>`` from the tokens of a raw name; ``unknown`` where no rule covers them."""
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    bare_maker = first_label(first, PREFIXLESS_MODELS)
    maker = first
    for spelling, name in MAKER_SPELLINGS.items():
        maker = F.when(first == spelling, F.lit(name)).otherwise(maker)
    return (
        F.when((F.size(tokens) == 1) & bare_maker.isNotNull(), F.concat_ws(" ", bare_maker, first))
        .when((F.size(tokens) == 2) & maker.isin(KNOWN_MAKERS), F.concat_ws(" ", maker, second))
        .otherwise(unknown)
    )


def dated_model(raw: Column) -> Column:
    """Known families as ``<maker> <model>``; text no pattern covers stays as it is."""
    for pattern, replacement in DATED_MODELS:
        raw = F.regexp_replace(raw, pattern, replacement)
    return raw


def maker_label(raw: Column) -> Column:
    """Maker by family pattern; text no pattern covers stays as it is."""
    return F.coalesce(first_label(raw, MAKER_MODELS), raw)


def model_token(raw: Column) -> Column:
    """What follows the last space."""
    return F.element_at(F.split(raw, " "), -1)


def maker_of(normalized: Column) -> Column:
    return F.split(normalized, " ").getItem(0)


def model_of(normalized: Column) -> Column:
    return F.split(normalized, " ").getItem(1)
