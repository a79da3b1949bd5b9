"""Labels from a table of patterns, without comparing every name with every pattern.

Most patterns hold a text that any match must contain. A piece of it of up to four characters is the pattern's key, the one
that fewest names have; names are joined by their own pieces, so that a pattern only meets names that hold its key. What is
met is verified: first the whole required text, then the pattern. A pattern that requires nothing meets every name, which is
what it asks for; such patterns are dealt out by name.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST_PIECE = 4


def required_text(pattern: str) -> str:
    """The longest run of characters that every match of the pattern contains, "" if there is none to be told.

    Read from the parsed pattern: literals that stand one after the other, those of groups and of anything repeated at
    least once included; alternatives, options and character classes end a run. A pattern that cannot be parsed here
    requires nothing, so that it is left to the verification.
    """
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if parsed.state.flags & re.IGNORECASE:
        return ""
    runs = [""]

    def walk(items) -> None:
        for kind, value in items:
            if kind is op.LITERAL:
                runs[-1] += chr(value)
            elif kind is op.SUBPATTERN:
                _, added, removed, inner = value
                if added or removed:
                    runs.append("")
                else:
                    walk(inner)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, inner = value
                if least >= 1:
                    walk(inner)
                if (least, most) != (1, 1):
                    runs.append("")
                    if least >= 1:  # the last repetition stands right before what follows
                        walk(inner)
            elif kind is not op.AT:  # a place between characters ends no run
                runs.append("")

    walk(parsed)
    return max(runs, key=len)


def with_required_text(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """``patterns`` with ``required``."""

    @F.arrow_udf("string")
    def required(texts: pa.Array) -> pa.Array:
        return pa.array([required_text(text) for text in texts.to_pylist()], pa.string())

    return patterns.withColumn("required", required(column))


def _pieces(text: str, lengths: F.Column) -> F.Column:
    """Every piece of the text of the given lengths, each once."""
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(text)), of_length)))


def first_labels(names: DataFrame, patterns: DataFrame, name: str = "model") -> DataFrame:
    """(name, label) of every distinct name, the label of the first pattern found in it, null where none is.

    ``patterns`` has (prio, pattern, label); the lowest prio counts, the smaller label where two share it. Patterns are
    searched, not matched whole. Null names, and null patterns, which nothing matches, are kept out of the join.
    """
    distinct = names.select(F.col(name).alias("name")).distinct()
    known = distinct.filter(F.col("name").isNotNull())
    lengths = F.sequence(F.lit(1), F.lit(LONGEST_PIECE))
    offered = known.select("name", F.explode(F.concat(F.array(F.lit("")), _pieces("name", lengths))).alias("piece"))

    indexed = with_required_text(patterns.filter(F.col("pattern").isNotNull()).select("prio", "pattern", "label"))
    longest = F.array(F.least(F.length("required"), F.lit(LONGEST_PIECE)))
    pieces = F.when(F.col("required") == "", F.array(F.lit(""))).otherwise(_pieces("required", longest))
    candidates = indexed.select("prio", "pattern", "label", "required", F.explode(pieces).alias("piece"))
    frequency = offered.filter(F.col("piece") != "").groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    rarest = F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "piece")).alias("rarest")
    keyed = (
        candidates.join(frequency, "piece", "left")
        .groupBy("prio", "pattern", "label", "required")
        .agg(rarest)
        .select("prio", "pattern", "label", "required", F.col("rarest.piece").alias("piece"))
    )
    found = (
        offered.join(keyed, "piece")
        .filter(F.col("name").contains(F.col("required")))
        .filter(F.regexp_like("name", F.col("pattern")))
        .groupBy("name")
        .agg(F.min(F.struct("prio", "label")).alias("first"))
        .select("name", F.col("first.label").alias("label"))
    )
    return distinct.join(found, "name", "left").select(F.col("name").alias(name), "label")
