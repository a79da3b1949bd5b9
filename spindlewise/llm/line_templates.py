"""Lines that recur across documents, found by a log-template tree with Spark expressions only.

The tree has a fixed depth: lines fall to a leaf by their number of words and their leading words. Words with digits are
variable from the start. In a leaf, words are counted at their places, in different texts. A line is tried with as many
masks as its words have counts: words below the count are variable (``<*>``), the others constant. However often the
values of a field come back, the constants of its template come more often, and one of the masks is that of the template.
A mask that stands in enough different texts is a template, and its lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.llm.common import broadcast_if_small, stored

VARIABLE, LEADING, MIN_WORDS, MIN_TEXTS = "<*>", 2, 1, 5


def words_of(line: Column) -> Column:
    """Words of a line, those with an ASCII digit masked. Lines that hold only words and spaces are split as they are."""
    plain = F.regexp_replace(F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", VARIABLE), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(F.when(line.rlike(r"[0-9\x09-\x0D]"), plain).otherwise(line), " "), "")


def recurring(docs: DataFrame, min_texts: int = MIN_TEXTS, min_words: int = MIN_WORDS) -> DataFrame:
    """Stored (text_key, pos, leaf, level) of every line that recurs; ``text_key`` is the MD5 of the whole text.

    A line recurs when one of its masks has constants at half of its places at least and stands in ``min_texts``
    different texts; ``level`` is the lowest count of a constant in the mask with most constants of these. A mask that
    makes a word variable needs a constant after the leading words, which are the same in all of the leaf. Exact copies
    of a document are one text. Lines of fewer than ``min_words`` words are never looked at.
    """
    return _recurring(docs, min_texts, min_words)[0]


def templates(docs: DataFrame, min_texts: int = MIN_TEXTS, min_words: int = MIN_WORDS) -> DataFrame:
    """(text_key, pos, leaf, template) of every line that recurs, masked as in ``recurring``."""
    found, near, common = _recurring(docs, min_texts, min_words)
    line = ["text_key", "pos", "leaf"]
    words = near.dropDuplicates(["text_key", "pos"]).join(found, line).select(*line, "level", F.posexplode("words").alias("place", "word"))
    shown = F.when((F.col("place") < LEADING) | (F.col("texts") >= F.col("level")), F.col("word")).otherwise(VARIABLE)
    placed = words.withColumn("at", _at()).join(common, "at", "left").groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("word")))).alias("w"))
    return placed.select(*line, F.array_join(F.col("w.word"), " ").alias("template"))


def _at() -> Column:
    return F.xxhash64("leaf", "place", "word")


def _recurring(docs: DataFrame, min_texts: int, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``recurring`` gives, the lines of its leaves, and counts of the words after the leading ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = (
        docs.select(text.alias("text"))
        .select(F.unhex(F.md5("text")).alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("words", words_of(F.col("line")))
        .where(F.size("words") >= min_words)
        .select("text_key", "pos", F.xxhash64(F.size("words"), F.slice("words", 1, LEADING)).alias("leaf"), "words")
    )
    leaves = stored(
        lines.select("leaf", "text_key").distinct().groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts).select("leaf"),
        "template-leaves",
    )
    near = stored(lines.join(broadcast_if_small(leaves), "leaf", "left_semi"), "template-lines")
    # copies of a text are counted once
    one = near.dropDuplicates(["text_key", "pos"]).select(
        "text_key",
        "pos",
        "leaf",
        F.size("words").alias("n"),
        F.size(F.array_remove(F.slice("words", 1, LEADING), VARIABLE)).alias("led"),
        F.size(F.array_remove("words", VARIABLE)).alias("own"),
        "words",
    )
    one = stored(one, "template-distinct")
    line = ["text_key", "pos", "leaf"]
    words = (
        one.where("own > led")
        .select(*line, "n", "led", F.posexplode("words").alias("place", "word"))
        .where((F.col("place") >= LEADING) & (F.col("word") != VARIABLE))
        .select(*line, "n", "led", _at().alias("at"))
    )
    common = words.select("at", "text_key").distinct().groupBy("at").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    common = stored(common, "template-words")
    # a mask is named by two sums (exclusive or) over the hashes of its constants, running down from the highest count
    down = Window.partitionBy("text_key", "pos").orderBy(F.desc("texts"))
    masks = (
        words.join(broadcast_if_small(common), "at")
        .select(
            *line,
            "n",
            F.col("texts").alias("level"),
            (F.col("led") + F.count("*").over(down)).alias("constants"),
            F.bit_xor("at").over(down).alias("mask"),
            F.bit_xor(F.xxhash64(F.lit(1), "at")).over(down).alias("mask_2"),
            F.lead("texts").over(down).alias("next"),
        )
        .where("2 * constants >= n and (next is null or next < level)")
    )
    # nothing after the leading words but variables from the start
    bare = one.where("own = led and 2 * led >= n").select(*line, F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("mask_2"))
    names = [*line, "level", "mask", "mask_2"]
    masks = stored(masks.select(*names).unionAll(bare.select(*names)), "template-masks")
    name = ["leaf", "mask", "mask_2"]
    often = masks.select(*name, "text_key").distinct().groupBy(*name).agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    often = broadcast_if_small(stored(often.select(*name), "template-texts"))
    found = masks.join(often, name).groupBy(*line).agg(F.min("level").alias("level"))
    return stored(found, "template-recurring"), near, common


def without_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) without recurring lines, and n_lines and n_dropped; one row per row of ``docs``.

    All other lines stay, in order and unchanged. Null text has no lines and stays null; empty text is one empty line.
    Repeated rows lose the same lines; rows without an id are documents too. Other columns are not read.
    """
    found = recurring(docs, min_texts, min_words)
    drop = stored(found.groupBy(F.col("text_key").alias("_key")).agg(F.collect_set("pos").alias("_drop")), "template-drops")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    joined = source.join(broadcast_if_small(drop), F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col("_key"), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda line, k: ~F.array_contains(F.col("_drop"), k)), "\n")
    )
    return joined.select(
        "doc_id",
        kept.alias("text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.coalesce("_drop", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_dropped"),
    )
