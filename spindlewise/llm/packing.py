"""Packing into batches of like length: optimal length buckets, then batches under a token budget inside each bucket.

1. Lengths of all documents are counted. A corpus of T tokens has at most sqrt(2 T) different lengths, so the histogram
   fits on the driver where the documents do not.
2. Dynamic programming over the whole histogram finds the bucket boundaries with the least padding, exactly.
3. A batch of a bucket with boundary b takes ``budget // b`` documents. Documents are numbered inside shards of a bucket,
   and the shards' counts give each its first number, so that a bucket with most of the rows is never ordered in one task.
"""

from __future__ import annotations

import math
from itertools import chain as joined

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindlewise.llm.common import WORD, stored

BUCKETS, TOKEN_BUDGET, SHARD_ROWS = 16, 65_536, 20_000


def word_count(text: Column) -> Column:
    """Words of a whole text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least padding.

    ``histogram`` holds (length, documents). With prefix sums N of documents and T of tokens, a bucket over lengths
    i+1..j pads to len[j] * (N[j] - N[i]) - (T[j] - T[i]): for fixed i a line in len[j] with slope -N[i]. Slopes fall and
    queries rise, so each layer is one walk along a lower hull: time in proportion to buckets times lengths.
    """
    table = sorted((length, count) for length, count in histogram if count > 0)
    size = len(table)
    if size <= buckets:
        return [length for length, _ in table]
    lengths = [0] + [length for length, _ in table]
    n, t = [0], [0]
    for length, count in table:
        n.append(n[-1] + count)
        t.append(t[-1] + length * count)
    best = [0] + [lengths[j] * n[j] - t[j] for j in range(1, size + 1)]
    choices: list[list[int]] = []
    for layer in range(2, buckets + 1):
        hull: list[int] = []
        first, now, choice = 0, best[:], [0] * (size + 1)
        line = lambda i: (-n[i], best[i] + t[i])
        for j in range(layer, size + 1):
            i = j - 1  # the line that becomes available
            slope, height = line(i)
            while len(hull) - first >= 2:
                (s1, h1), (s2, h2) = line(hull[-2]), line(hull[-1])
                if (h2 - h1) * (s1 - slope) < (height - h1) * (s1 - s2):
                    break
                hull.pop()
            hull.append(i)
            x = lengths[j]
            value = lambda k, x=x: line(k)[0] * x + line(k)[1]
            while len(hull) - first >= 2 and value(hull[first + 1]) <= value(hull[first]):
                first += 1
            choice[j] = hull[first]
            now[j] = x * n[j] - t[j] + value(hull[first])
        best = now
        choices.append(choice)
    ends, j = [], size
    for choice in reversed(choices):
        ends.append(lengths[j])
        j = choice[j]
    ends.append(lengths[j])
    return ends[::-1]


def padding(histogram: list[tuple[int, int]], ends: list[int]) -> int:
    """Padding tokens when every document is filled up to the end of its bucket."""
    return sum(count * (min(e for e in ends if e >= length) - length) for length, count in histogram)


def packed(
    docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket (from 0), bucket_tokens (its boundary), batch and slot.

    ``length`` is a column of token counts, by default the words of ``text``; null and negative lengths count as 0. A
    batch is named by bucket and batch. It holds ``max(1, budget // bucket_tokens)`` documents, so only one that is
    longer than the budget by itself exceeds it; documents without tokens fill batches of ``budget``. Ties, repeated
    rows and missing ids are packed like others, each once. Other columns are not read. An empty table gives no rows.
    """
    counted = stored(
        docs.select("doc_id", F.greatest(F.coalesce((word_count(F.col("text")) if length is None else length).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
        .withColumn("row", F.monotonically_increasing_id()),  # stored, so it stays what it is
        "packing-lengths",
    )
    histogram = [(r["n_tokens"], r["count"]) for r in counted.groupBy("n_tokens").count().collect()]
    ends = boundaries(histogram, buckets) or [0]
    rows_of = [0] * len(ends)
    for tokens, count in histogram:
        rows_of[next(k for k, e in enumerate(ends) if e >= tokens)] += count
    bucket = F.coalesce(*(F.when(F.col("n_tokens") <= end, k) for k, end in enumerate(ends)))
    per_bucket = lambda values: F.element_at(F.create_map(*joined.from_iterable((F.lit(k), F.lit(v)) for k, v in enumerate(values))), F.col("bucket"))
    shards = [math.ceil(max(count, 1) / shard_rows) for count in rows_of]
    dealt = (
        counted.withColumn("bucket", bucket)
        .withColumn("bucket_tokens", per_bucket([int(e) for e in ends]).cast("long"))
        .withColumn("shard", F.pmod(F.xxhash64("row"), per_bucket(shards).cast("long")))
    )
    sizes = dealt.groupBy("bucket", "shard").count()
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket", "shard").orderBy("row")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return (
        dealt.withColumn("number", F.row_number().over(inside))
        .join(offsets, ["bucket", "shard"])
        .withColumn("place", F.col("offset") + F.col("number") - 1)
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_tokens",
            F.floor(F.col("place") / capacity).cast("long").alias("batch"), (F.col("place") % capacity).cast("long").alias("slot"),
        )
    )
