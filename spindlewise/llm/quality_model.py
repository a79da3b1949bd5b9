"""Quality scores: random Fourier features of document statistics, ridge from summed normal equations, isotonic calibration.

1. ``statistics`` reads every whole text once and keeps a dozen numbers; they are stored and everything else reads those.
2. Each partition of labelled rows adds up its share of the normal equations; Spark sums them row by row of the matrix.
   What reaches the driver is one matrix of a fixed size, whatever the number of rows.
3. Raw scores of the labelled rows are counted in a fixed number of bins; pooling adjacent violators over those bins
   gives the monotone map from raw score to probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import arrow_filter, arrow_rows, crc_fold, stored

FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.7
STATISTICS = (
    "log_words", "log_chars", "letters_per_word", "symbols", "marks", "capitals", "digits", "distinct_words",
    "commonest_word", "doubled_words", "repeated_windows", "duplicate_lines", "log_line_words",
)
FEATURES, WIDTH, RIDGE, BINS, SEED = 160, 3.0, 1.0, 2000, 20240601

_kinds = np.zeros(256, dtype=np.int64)
_kinds[list(b"#*$%&|<>")] = 1
_kinds[list(b"!?.,;:-_'\"()[]{}/\\=+@^`~")] = 2
_kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
_kinds[list(b"0123456789")] = 4
_kinds[list(b" \t\n\v\f\r")] = 5
_kinds[0x80:0xC0] = 6  # later bytes of a character


def statistics_of(text: bytes) -> tuple[float, ...]:
    """STATISTICS of one text in UTF-8. Empty text and text without words have zeros where nothing can be counted."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(_kinds[data], minlength=7)
    wide_capitals = int(((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)).sum())
    chars = len(text) - kinds[6]
    letters = max(chars - kinds[5], 1)
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=n)  # only compared with each other, in this text
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    windows = np.sort(codes[:-2] * 1_000_003 * 1_000_003 + codes[1:-1] * 1_000_003 + codes[2:]) if n > 2 else codes[:0]
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        np.log1p(n),
        np.log1p(chars),
        letters / n,
        kinds[1] / letters,
        kinds[2] / letters,
        (kinds[3] + wide_capitals) / letters,
        kinds[4] / letters,
        len(starts) / n,
        np.diff(np.append(starts, n)).max() / n,
        (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0,
        (windows[1:] == windows[:-1]).mean() if n > 3 else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats`` (array of STATISTICS), one row per row of ``docs``; null text is empty text."""

    def step():
        def batch(rows):
            with np.errstate(over="ignore"):
                values = [v for t in rows.column(1).to_pylist() for v in statistics_of(t)]
            offsets = np.arange(rows.num_rows + 1, dtype=np.int32) * len(STATISTICS)
            return [rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))]

        return batch

    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return arrow_rows(source, step, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, stats array<double>", text=1)


@dataclass(frozen=True)
class Model:
    """``knots`` map raw scores to probabilities. Without knots there is no model and every score is ``prior``."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose inner products approximate a Gaussian kernel of the scaled statistics; a constant comes first."""
        random = np.random.default_rng(SEED)
        directions = random.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES))
        phases = random.uniform(0, 2 * np.pi, FEATURES)
        scaled = np.clip((stats - self.centre) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(scaled @ directions + phases)
        return np.hstack([np.ones((len(stats), 1)), waves])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(stats), self.prior)
        return np.interp(self.features(stats) @ self.weights, *self.knots)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def isotonic(values: np.ndarray, positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing shares closest to ``positive / count`` (weighted squares), for ascending ``values``."""
    blocks: list[list[float]] = []
    for p, c in zip(positive, count):
        blocks.append([float(p), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), p / c) for p, c, n in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """Fit on rows (stats, label), label 0 or 1. With one kind of label, or none, every score is their share."""
    moments = [f(F.col("stats")[k]).alias(f"{n}{k}") for k in range(len(STATISTICS)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    first = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("p"), *moments).first()
    prior = float(first["p"]) if first["n"] else 0.0
    size = len(STATISTICS)
    centre = np.array([first[f"m{k}"] or 0.0 for k in range(size)])
    scale = np.maximum([first[f"s{k}"] or 0.0 for k in range(size)], 1e-6)
    start = Model(centre, scale, np.zeros(FEATURES + 1), None, prior)
    if not 0 < prior < 1:
        return start
    shape = FEATURES + 2

    def share(batches):
        total = np.zeros((shape, shape))
        for rows in batches:
            if rows.num_rows:
                z = np.hstack([start.features(_matrix(rows.column(0))), rows.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape)), pa.array(list(total))], names=["i", "part"])

    shares = labelled.select("stats", F.col("label").cast("double")).mapInArrow(share, "i long, part array<double>")

    def add(part: pa.Table) -> pa.Table:
        total = part.column("part").combine_chunks().flatten().to_numpy().reshape(-1, shape).sum(axis=0)
        return pa.table({"i": part.column("i")[:1], "total": [total]})

    sums = shares.groupBy("i").applyInArrow(add, "i long, total array<double>")
    gram = np.array([r["total"] for r in sorted(sums.collect())])
    penalty = RIDGE * np.eye(shape - 1)
    penalty[0, 0] = 1e-9
    weights = np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])
    raw = Model(centre, scale, weights, None, prior)

    def binned(batches):
        for rows in batches:
            value = raw.features(_matrix(rows.column(0))) @ weights
            bins = np.floor(np.clip(value, -1, 2) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), rows.column(1)], names=["bin", "label"])

    counts = (
        labelled.select("stats", F.col("label").cast("long")).mapInArrow(binned, "bin long, label long")
        .groupBy("bin").agg(F.sum("label").alias("positive"), F.count("*").alias("n"))
    )
    table = np.array(sorted(tuple(r) for r in counts.collect()), dtype=float)
    at = (table[:, 0] + 0.5) / BINS
    return Model(centre, scale, weights, (at, isotonic(at, table[:, 1], table[:, 2])), prior)


def labelled_rows(stats: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Statistics of labelled documents outside the held-out fold. Null labels and ids teach nothing; of several labels
    of a document the largest counts. The join moves statistics only, never texts."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg((F.max("label") > 0).cast("int").alias("label"))
    )
    return stats.join(known, "doc_id").select("stats", "label")


def fitted(stats: DataFrame, labels: DataFrame, label: str) -> Model:
    return fit(stored(labelled_rows(stats, labels, label), "quality-training"))


def of_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all columns. Nothing is joined or shuffled for it."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(stored(statistics(docs), "quality-statistics"), labels, label))

    def keep(texts: list[bytes]) -> np.ndarray:
        with np.errstate(over="ignore"):
            stats = np.array([statistics_of(text) for text in texts]).reshape(-1, len(STATISTICS))
        return shared.value.scores(stats) >= threshold

    return arrow_filter(docs, "text", lambda: keep)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted.

    Null and empty texts get the score of zero statistics. Repeated rows score alike; a null id is not held out. Other
    columns of ``docs`` are not read. An empty table gives no rows.
    """
    stats = stored(statistics(docs), "quality-statistics")
    model = docs.sparkSession.sparkContext.broadcast(fitted(stats, labels, label))

    source = stats.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "stats")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rows in batches:
            scores = model.value.scores(_matrix(rows.column(2)))
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(scores), pa.array(predicted)],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
