"""Quality rules as a ledger: every rule is evaluated once, policies and ablations only read its bits.

``measured`` reads each text once and stores measurements; ``ledger`` turns them into one integer with a bit for each
rule that a document fails. A policy is a named, versioned set of rules, so a verdict is one bitwise AND, and what a rule
costs (``ablation``) is an aggregation over the distinct bit patterns, never over texts again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import arrow_rows

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements, integers only) is true."""

    name: str
    bit: int
    fails: str


#: Bits are permanent: a changed threshold is a new rule with a new bit, so that stored ledgers keep their meaning.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "100 * n_symbols > 10 * word_chars"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("long_words", 4, "word_chars > 40 * n_words"),
    Rule("short_words", 5, "2 * word_chars < 3 * n_words"),
)
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "strict-1": ("few_words", "repeated_words", "many_symbols", "duplicate_lines", "long_words", "short_words"),
}


def policy_mask(policy: str) -> int:
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text. Null and text without a word measure as zeros, but for symbols, which are words too."""
    text = text or ""
    words = text.encode().split()  # at ASCII white space only, as common.WORD does
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        covered = bytearray(len(words))
        for start, window in enumerate(windows):
            if counts[window] > 1:
                covered[start : start + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\v\f\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
    )


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements of every whole text, one row per row of ``docs``: the id and MEASURES, all long.

    Other columns are not read, whatever their names. Repeated rows are measured each; an empty table gives none.
    """

    def step():
        def batch(rows):
            found = [measure(text) for text in rows.column(1).to_pylist()]
            return [rows.column(0), *(list(x) for x in zip(*found))] if found else [rows.column(0), *([] for _ in MEASURES)]

        return batch

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return arrow_rows(source, step, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES), text=1)


def ledger(measurements: DataFrame) -> DataFrame:
    """``measurements`` and ``failed_bits``: bit b is set when the rule of bit b fails."""
    bits: Column = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return measurements.withColumn("failed_bits", bits)


def fails(policy: str, failed_bits: str = "failed_bits") -> Column:
    """Whether a document fails any rule of the policy."""
    return F.col(failed_bits).bitwiseAND(F.lit(policy_mask(policy))) != 0


def ablation(bits: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy costs: one row per rule.

    ``failing`` documents fail the rule, ``only_this`` fail no other rule of the policy and so would come back without
    it; ``bits_or`` and ``bits_and`` hold the rules that fail together with it in some and in all of those documents.
    Counts are taken once per distinct bit pattern (at most two to the number of rules).
    """
    mask = policy_mask(policy)
    patterns = bits.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count("*").alias("docs"))
    rules = F.array(
        *(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy])
    )
    each = patterns.select("pattern", "docs", F.explode(rules).alias("r")).select("pattern", "docs", "r.rule", "r.bit")
    hit = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.coalesce(F.sum(F.when(hit, F.col("docs"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("pattern") == F.col("bit"), F.col("docs"))), F.lit(0)).alias("only_this"),
        F.expr("coalesce(bit_or(pattern) FILTER (WHERE pattern & bit != 0), 0L)").alias("bits_or"),
        F.expr("coalesce(bit_and(pattern) FILTER (WHERE pattern & bit != 0), 0L)").alias("bits_and"),
    )
