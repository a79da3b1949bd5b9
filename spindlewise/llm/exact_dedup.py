"""Exact duplicates by content-defined chunk recipes, with Spark expressions only.

A text is cut where its content says so, chunks get verified identifiers, and texts are equal when their ordered lists
of identifiers are. Texts are read once and never move: what is shuffled is digests of chunks and lists of identifiers,
a few percent of the text.

An identifier is the 64-bit hash of a chunk, verified: where one hash stands for chunks with different SHA-256 digests
(or lengths), documents that hold such a chunk are compared by the digests instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import broadcast_if_small, lower_ascii, stored

#: A chunk ends after the first boundary that follows its first 512 bytes, or after 4096. Boundaries are some pairs of Latin
#: letters and of digits, line ends, and in any other script the characters whose last byte in UTF-8 is one of these four, a
#: sixteenth of all. The pattern reads bytes, a character for each.
CHUNK = r"(?s).{512,4094}?(?:an|en|es|le|he|\n|[iou][nt]|[0-9][05a-f]|[\x80-\xbf\xc2-\xdf][\x84\x94\xa4\xb4](?![\x80-\xbf]))|.{1,4096}"


def recipe(text: Column) -> Column:
    """Array of (hash, digest, length) of the content-defined chunks of a text; empty for an empty one."""
    as_bytes = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.transform(
        F.regexp_extract_all(as_bytes, F.lit(CHUNK), F.lit(0)),
        lambda c: F.struct(F.xxhash64(c).alias("hash"), F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("chars")),
    )


def described(docs: DataFrame) -> DataFrame:
    """Stored (row, doc_id, text_sha256, recipe) of every row; null text counts as empty. ``row`` tells repeated rows apart."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return stored(
        docs.select("doc_id", text.alias("t")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("t", 256).alias("text_sha256"), recipe(F.col("t")).alias("recipe")
        ),
        "chunk-recipes",
    )


def unverified_hashes(rows: DataFrame) -> DataFrame:
    """Hashes that stand for more than one chunk content. Normally none."""
    quarter = lambda k: F.conv(F.hex(F.substring("c.digest", 1 + 8 * k, 7)), 16, 10).cast("long")
    chunks = rows.select(F.explode("recipe").alias("c")).select(
        F.col("c.hash").alias("hash"), F.col("c.chars").alias("chars"), *(quarter(k).alias(f"q{k}") for k in range(4))
    )
    names = ["chars", "q0", "q1", "q2", "q3"]
    ranges = chunks.groupBy("hash").agg(*(f(n).alias(f"{k}_{n}") for n in names for k, f in (("low", F.min), ("high", F.max))))
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(f"low_{n}") != F.col(f"high_{n}"))
    return ranges.where(differs).select("hash")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, dropped ones too: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are put in lower case; null counts as empty. Of a group the row with the
    largest doc_id stays; of rows that share that id, one. A missing id is smaller than any other, and where no row of a
    group has one, one row stays and ``keep_id`` is null. Other columns are not read. An empty table gives no rows.
    """
    rows = described(docs)
    listed = rows.select("row", "doc_id", "text_sha256", F.col("recipe.hash").alias("ids"), F.lit(None).cast("array<binary>").alias("digests"))
    doubtful = stored(unverified_hashes(rows), "unverified-hashes")
    if not doubtful.isEmpty():
        flagged = rows.select("row", F.explode("recipe.hash").alias("hash")).join(doubtful, "hash", "left_semi").select("row").distinct()
        digests = rows.join(flagged, "row").select("row", F.col("recipe.digest").alias("digests"))
        listed = listed.drop("digests").join(digests, "row", "left")
    keyed = listed.withColumn("digests", F.coalesce("digests", F.array().cast("array<binary>")))
    groups = keyed.groupBy("ids", "digests").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays"))
    return keyed.join(groups, ["ids", "digests"]).select(
        "row", "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns. Of rows with one id and equal texts one stays."""
    decided = deduplicated(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    decided = stored(decided.where("rows > 1 or not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "dropped-ids")
    digest = F.sha2(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_sha"))
    once = docs.join(broadcast_if_small(decided), same, "left_anti")
    repeated = decided.where("kept")
    if repeated.isEmpty():
        return once
    again = docs.join(broadcast_if_small(repeated), same, "left_semi").withColumn("_sha", digest)
    return once.unionAll(again.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
