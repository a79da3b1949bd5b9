"""Hard negatives: for every anchor and positive, the best differently labelled rows within a window of scores.

Candidates are stored as Parquet blocks along a Hilbert curve, so that a block holds vectors that lie close together, each
with a zone map: the least and the greatest value in every dimension. From a zone map follows, by interval arithmetic, between
which two scores all rows of a block lie for an anchor. A block is read for a pack of anchors only where that interval meets a
window some anchor of the pack still has open. Blocks that promise most are read first; what they give raises the lower ends
of the windows, and the zone maps are asked again. The bounds are exact, so that no block that could matter is left out; how
many are left out depends on how the vectors lie.

Components are whole numbers, floor(256 x), and scores are exact inner products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.llm.common import _arrow_schema, broadcast_if_small, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Percent of the positive's score between which a negative's lies.
WINDOW = (50, 95)

BLOCK_ROWS = 512
PACK_ROWS = 256
#: Zone maps that are asked at once.
CHUNK_BLOCKS = 256
#: Blocks that each pack reads before the others are chosen.
FIRST_BLOCKS = 4
#: The curve runs through the dimensions that vary most, with this many bits in each.
CURVE_DIMENSIONS = 12
CURVE_BITS = 4
#: So few blocks are named to the scan, which then skips row groups.
NAMED_BLOCKS = 1000

_OPEN = 1 << 62

BLOCK_SCHEMA = "block long, ids binary, labels binary, vectors binary, low binary, high binary"
PACK_SCHEMA = "pack long, ids binary, labels binary, vectors binary"


def taking_part(embeddings: DataFrame, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, label, vector): rows with an id, a label and a vector of finite components.

    Of rows with the same id one counts, that with the smallest label, then the smallest vector.
    """
    x = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), x.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))  # NaN is the largest double
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("vec_id", "row.label", "row.vector")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of whole numbers below 2^bits) along a Hilbert curve; neighbours on the curve share a side."""
    axes = [column.astype(np.int64) for column in cells.T]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k, axis in enumerate(axes):
            flip = (axis & q) != 0
            swap = np.where(flip, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(flip, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
        q >>= 1
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros_like(axes[0])
    q = top
    while q > 1:
        turn ^= np.where((axes[-1] & q) != 0, q - 1, 0)
        q >>= 1
    keys = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ turn) >> bit) & 1)
    return keys


def _matrix(vectors: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as rows of whole numbers; a vector that ends early goes on with zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    rows = np.zeros((len(lengths), dimensions))
    rows[np.arange(dimensions) < lengths[:, None]] = values
    return rows


def _axes(rows: DataFrame) -> tuple[int, int, list[tuple[int, float, float]]]:
    """Count of rows, dimensions (one at least), and for the curve's dimensions their number, mean and deviation."""
    shape = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("d")).first()
    moments = (
        rows.select(F.posexplode("vector").alias("axis", "x"))
        .groupBy("axis")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
        .orderBy(F.desc("deviation"), "axis")
        .limit(CURVE_DIMENSIONS)
        .collect()
    )
    return shape.n, max(1, shape.d), [(m.axis, m.mean * SCALE, (m.deviation or 0.0) * SCALE) for m in moments]


def _with_key(rows: DataFrame, dimensions: int, axes: list[tuple[int, float, float]]) -> DataFrame:
    schema = "vec_id long, label long, vector array<double>, key long"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def run(batches):
        for batch in batches:
            values = _matrix(batch.column(2), dimensions)
            cells = np.zeros((batch.num_rows, max(1, len(axes))), np.int64)
            for k, (axis, mean, deviation) in enumerate(axes):
                scaled = (values[:, axis] - mean) / (deviation or 1.0)  # two deviations to each side, cut beyond
                cells[:, k] = np.clip((scaled + 2) / 4, 0, 1 - 1e-9) * (1 << CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, CURVE_BITS))], schema=arrow)

    return rows.mapInArrow(run, schema)


def _packed(rows: DataFrame, dimensions: int, count: int, size: int, schema: str, zoned: bool, purpose: str) -> DataFrame:
    """Rows in the order of the curve, ``size`` to a packed row, which is numbered by the range it comes from.

    A range of the curve is cut further by id, so that any number of equal vectors are dealt to many tasks.
    """
    arrow = _arrow_schema(rows.sparkSession, schema)
    parts = max(1, min(-(-count // (16 * size)), 20_000))

    def packed(number: int, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")  # ties in score go to the smaller id
        ids, labels, values = ids[order], labels[order], values[order]
        columns = [ids.tobytes(), labels.tobytes(), values.tobytes()]
        if zoned:
            columns += [values.min(axis=0).tobytes(), values.max(axis=0).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], schema=arrow)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        count = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dimensions)))
            count += batch.num_rows
            if count >= size:
                ids, labels, values = (np.concatenate(x) for x in zip(*held))
                whole = count - count % size
                for at in range(0, whole, size):
                    yield packed(number, ids[at : at + size], labels[at : at + size], values[at : at + size])
                    number += 1
                held, count = [(ids[whole:], labels[whole:], values[whole:])], count - whole
        if count:
            yield packed(number, *(np.concatenate(x) for x in zip(*held)))

    ranged = rows.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    return stored(ranged.select("vec_id", "label", "vector").mapInArrow(run, schema), purpose)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles while no sum can pass 2^53, else as Python's own."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return exact.astype(np.int64)  # a score that 64 bits do not hold is an error


def _numbers(packed: bytes, kind: type, dimensions: int | None = None) -> np.ndarray:
    values = np.frombuffer(packed, kind)
    return values if dimensions is None else values.reshape(-1, dimensions)


class _Search:
    """One search: the packs of anchors, the blocks, their zone maps in chunks."""

    def __init__(self, packs: DataFrame, blocks: DataFrame, dimensions: int, count: int):
        self.packs, self.blocks, self.dimensions = packs, blocks, dimensions
        self.chunks = max(1, -(-count // (BLOCK_ROWS * CHUNK_BLOCKS)))
        chunk = F.pmod(F.xxhash64("block"), F.lit(self.chunks)).alias("chunk")
        self.zones = blocks.select(chunk, "block", "low", "high")

    def _asked(self, wants: DataFrame) -> DataFrame:
        """Each pack once for every chunk of zone maps: a stated set of queries against all rows, in blocks."""
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.chunks - 1).cast("long")))
        return self.packs.select("pack", "vectors").join(wants, "pack").withColumn("chunk", every)

    def bounded(self, wants: DataFrame) -> DataFrame:
        """(pack, block, most): blocks whose interval of scores meets an open window of the pack.

        ``wants`` has, for each pack, arrays of the anchor's place in the pack and of both ends of its window; ``most`` is
        the greatest score that the block may hold for any of them.
        """
        dimensions = self.dimensions
        schema = "pack long, block long, most double"
        arrow = _arrow_schema(wants.sparkSession, schema)

        def run(batches):
            for batch in batches:
                names = batch.schema.names
                for row in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                    have = dict(zip(names, row))
                    anchors = _numbers(have["vectors"], np.float64, dimensions)
                    zones = have["zones"]
                    low = _numbers(b"".join(z["low"] for z in zones), np.float64, dimensions)
                    high = _numbers(b"".join(z["high"] for z in zones), np.float64, dimensions)
                    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
                    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
                    # sums of doubles: what rounding may take is given back
                    slack = 1e-9 * (np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T)
                    place = np.array([w["place"] for w in have["wants"]], np.int64)
                    lowest = np.array([w["low"] for w in have["wants"]], np.float64)[:, None]
                    highest = np.array([w["high"] for w in have["wants"]], np.float64)[:, None]
                    meets = ((most + slack)[place] >= lowest) & ((least - slack)[place] <= highest)
                    chosen = np.flatnonzero(meets.any(axis=0))
                    best = np.where(meets, most[place], -np.inf).max(axis=0)[chosen]
                    columns = [np.full(len(chosen), have["pack"]), np.array([zones[k]["block"] for k in chosen], np.int64), best]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        # a chunk has about CHUNK_BLOCKS zone maps, whatever the number of blocks
        chunks = self.zones.groupBy("chunk").agg(F.collect_list(F.struct("block", "low", "high")).alias("zones"))
        return self._asked(wants).join(chunks, "chunk").mapInArrow(run, schema)

    def best(self, pairs: DataFrame, wants: DataFrame, same_label: bool, most: int) -> DataFrame:
        """(pack, place, slot, found, score, rank): the ``most`` best rows of each window in the chosen blocks."""
        dimensions = self.dimensions
        schema = "pack long, place int, slot int, found long, score long"
        arrow = _arrow_schema(wants.sparkSession, schema)

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield kernel(row)

        def kernel(row: dict) -> pa.RecordBatch:
            own, ids = _numbers(row["ids"], np.int64), _numbers(row["block_ids"], np.int64)
            own_label, label = _numbers(row["labels"], np.int64), _numbers(row["block_labels"], np.int64)
            scores = _inner(_numbers(row["vectors"], np.float64, dimensions), _numbers(row["block_vectors"], np.float64, dimensions))
            fits = (own_label[:, None] == label[None]) == same_label
            fits &= own[:, None] != ids[None]
            place = np.array([w["place"] for w in row["wants"]], np.int64)
            slot = np.array([w["slot"] for w in row["wants"]], np.int64)
            lowest = np.array([w["low"] for w in row["wants"]], np.int64)[:, None]
            highest = np.array([w["high"] for w in row["wants"]], np.int64)[:, None]
            inside = fits[place] & (scores[place] >= lowest) & (scores[place] <= highest)
            some = np.flatnonzero(inside.any(axis=1))
            ranked = np.where(inside[some], -scores[place[some]], _OPEN)
            order = np.argsort(ranked, axis=1, kind="stable")[:, :most]
            taken = np.take_along_axis(inside[some], order, axis=1)
            want, column = np.nonzero(taken)
            at = order[want, column]
            columns = [
                np.full(len(at), row["pack"]), place[some][want], slot[some][want], ids[at], scores[place[some][want], at],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        blocks = self.blocks.select("block", *(F.col(c).alias(f"block_{c}") for c in ("ids", "labels", "vectors")))
        named = [row.block for row in pairs.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        if len(named) <= NAMED_BLOCKS:
            blocks = blocks.filter(F.col("block").isin(named))
        packs = self.packs.join(wants, "pack")
        read = pairs.select("pack", "block").join(packs, "pack").join(blocks, "block")
        order = Window.partitionBy("pack", "place", "slot").orderBy(F.desc("score"), F.asc("found"))
        return read.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    def first_blocks(self, pairs: DataFrame) -> DataFrame:
        order = Window.partitionBy("pack").orderBy(F.desc("most"), F.asc("block"))
        return pairs.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= FIRST_BLOCKS).drop("at")

    def found(self, wants: DataFrame, same_label: bool, most: int, purpose: str) -> DataFrame:
        """The best ``most`` rows of every window over all blocks: first a few blocks, then those that may still matter."""
        few = stored(self.first_blocks(self.bounded(_by_pack(wants))), f"{purpose}-first-blocks")
        early = self.best(few, _by_pack(wants), same_label, most)
        raised = early.filter(F.col("rank") == most).select("pack", "place", "slot", F.col("score").alias("reached"))
        keys = ["pack", "place", "slot"]
        narrowed = stored(
            wants.join(raised, keys, "left").select(*keys, F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high"),
            f"{purpose}-windows",
        )
        pairs = stored(self.bounded(_by_pack(narrowed)), f"{purpose}-blocks")
        return stored(self.best(pairs, _by_pack(narrowed), same_label, most), purpose)


def _by_pack(wants: DataFrame) -> DataFrame:
    """Windows in one row for each pack: at most PACK_ROWS times POSITIVES of them."""
    return wants.groupBy("pack").agg(F.collect_list(F.struct("place", "slot", "low", "high")).alias("wants"))


def _anchors(packs: DataFrame, dimensions: int) -> DataFrame:
    """(pack, place, anchor_id) of every anchor."""
    schema = "pack long, place int, anchor_id long"
    arrow = _arrow_schema(packs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for pack, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _numbers(ids, np.int64)
                columns = [np.full(len(own), pack), np.arange(len(own), dtype=np.int32), own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return packs.select("pack", "ids").mapInArrow(run, schema)


def window_ends(score: Column) -> tuple[Column, Column]:
    """The least and the greatest whole score with WINDOW[0] * positive <= 100 * negative <= WINDOW[1] * positive."""
    wide = score.cast("decimal(20,0)")
    return (F.ceil(wide * WINDOW[0] / 100).cast("long"), F.floor(wide * WINDOW[1] / 100).cast("long"))


def mined(embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the module says.

    ``is_anchor`` is a condition on ``vec_id``. An anchor's positives are its best ``positives`` other rows of the same
    label, ties to the smaller id; for each, the best ``negatives`` rows of other labels within the window come, numbered
    from 1. ``taking_part`` says which rows count, and which of repeated ones. Vectors of different length are compared as
    if the shorter went on with zeros. A window without a row gives none, nor does an empty table or one without anchors.
    """
    rows = stored(taking_part(embeddings, id_column, label_column, vector_column), "vectors")
    count, dimensions, axes = _axes(rows)
    keyed = _with_key(rows, dimensions, axes)
    blocks = _packed(keyed, dimensions, count, BLOCK_ROWS, BLOCK_SCHEMA, True, "blocks")
    packs = _packed(keyed.filter(is_anchor), dimensions, max(1, count // 50), PACK_ROWS, PACK_SCHEMA, False, "packs")
    search = _Search(packs, blocks, dimensions, count)
    anchors = stored(_anchors(packs, dimensions), "anchors")
    all_scores = anchors.select("pack", "place", F.lit(0).alias("slot"), F.lit(-_OPEN).alias("low"), F.lit(_OPEN).alias("high"))
    near = search.found(all_scores, True, positives, "positives").select(
        "pack", "place", F.col("rank").alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")
    )
    low, high = window_ends(F.col("positive_score"))
    windows = near.select("pack", "place", "slot", low.alias("low"), high.alias("high")).filter(F.col("low") <= F.col("high"))
    far = search.found(windows, False, negatives, "negatives")
    keys = ["pack", "place"]
    return (
        far.join(near, [*keys, "slot"])
        .join(broadcast_if_small(anchors), keys)
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("found").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
