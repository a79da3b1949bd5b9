"""Phrase collocations: frequent contiguous phrases by Rabin-Karp fingerprints, scored by their weakest cut.

A task turns its texts into numbers of words, hashes each word once, and gets the fingerprint of every n-gram from prefix
polynomials over those hashes, in numpy. What is shuffled is a fingerprint, its count and a pointer to the first row that
has it; texts stay where they are. A fingerprint can only count too many occurrences (texts that collide add up), so that no frequent phrase is
lost. Longer n-grams are looked at only where both their shorter halves may be frequent; that is asked of a bit map of fixed
size, whose false answers cost work but change nothing. A last pass reads the phrases of frequent fingerprints from the
texts and counts them word by word: collisions separate there, and only frequent phrases ever become text.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindlewise.llm.common import _arrow_schema, broadcast_if_small, sliced, stored

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes when a longer one that holds its words has this percent of its occurrences.
SHADOW = 80
NO_LANGUAGE = "und"

#: Bytes that end a piece; blank and tab only part words.
_BREAKS = b".,;:!?\n\v\f\r"
_FOLDED = bytes.maketrans(_BREAKS + b"\t" + bytes(range(65, 91)), b"\n" * len(_BREAKS) + b" " + bytes(range(97, 123)))

#: Bits of the map of fingerprints that may be frequent, as a power of two: 8 MB, whatever the size of the corpus.
MAP_BITS = 26

#: Texts are kept in lots of about this many bytes; a longer text is a lot of its own, read in sections of that size.
LOT_BYTES = 1 << 20

#: Bits of a fingerprint. Few enough to be cheap to shuffle: what collides is told apart by its words.
PRINT_BITS = 48

#: Odd, so that it has an inverse modulo 2^64; the same in all tasks.
_BASE = random.Random(13).getrandbits(64) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_GAP, _BREAK = -1, -2


def _powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo 2^64."""
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them: polynomials modulo a power of two are weak in their low bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _prints(sums: np.ndarray, seeds: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    return _mixed(sums + seeds + np.asarray(lengths, np.uint64)) >> np.uint64(64 - PRINT_BITS)


class _Numbers(dict):
    """Words of a lot, numbered in the order they are met; the parts between words have numbers of their own."""

    def __init__(self):
        super().__init__({b"": _GAP, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) - 2
        return number

    def read(self, text: bytes) -> np.ndarray:
        """The text as numbers of words, with a break after each piece and at the end."""
        found = []
        start = 0
        while start < len(text):
            end = text.find(b" ", start + LOT_BYTES) if len(text) - start > LOT_BYTES else -1
            section = text[start:] if end < 0 else text[start:end]
            start = len(text) if end < 0 else end
            words = section.translate(_FOLDED).replace(b"\n", b" \n ").split(b" ")
            found.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        found.append(np.array([_BREAK], np.int32))
        numbers = np.concatenate(found)
        return numbers[numbers != _GAP]


LOT_SCHEMA = "languages array<string>, language binary, lengths binary, numbers binary, words binary, rows array<long>"


def _lots(texts: DataFrame) -> DataFrame:
    """(row, lang, text, id) as lots of LOT_SCHEMA and ``ids``: texts cut into words once, each word of a lot stored once.

    Numbers and words are compressed, so that what passes through Spark's own buffers stays small.
    """
    schema = f"{LOT_SCHEMA}, ids array<{texts.schema['id'].dataType.simpleString()}>"
    arrow = _arrow_schema(texts.sparkSession, schema)

    def lot(texts: list[tuple]) -> pa.RecordBatch:
        numbers = _Numbers()
        rows, own, found, ids = zip(*texts)
        read = [numbers.read(text) for text in found]
        names = sorted(set(own))
        at = {name: k for k, name in enumerate(names)}
        columns = [
            names,
            np.array([at[name] for name in own], np.int32).tobytes(),
            np.array([len(r) for r in read], np.int64).tobytes(),
            zlib.compress(np.concatenate(read).tobytes(), 1),
            zlib.compress(b" ".join([*numbers][2:]), 1),  # a word holds no blank
            rows,
            ids,
        ]
        return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        held, size = [], 0
        for batch in sliced(batches, 2):
            found = pc.fill_null(batch.column(2).cast(pa.binary()), b"").to_pylist()
            for text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, batch.column(3).to_pylist()):
                if held and size + len(text[2]) > LOT_BYTES:
                    yield lot(held)
                    held, size = [], 0
                held.append(text)
                size += len(text[2])
        if held:
            yield lot(held)

    return texts.mapInArrow(run, schema)


class _Lot:
    """A stored lot, with prefix polynomials over its words."""

    def __init__(self, languages: list[str], language: bytes, lengths: bytes, numbers: bytes, words: bytes, rows: list[int]):
        counts = np.frombuffer(lengths, np.int64)
        self.names = languages
        text = zlib.decompress(words)
        self.words = text.split(b" ") if text else []
        self.numbers = np.frombuffer(zlib.decompress(numbers), np.int32)
        self.language = np.repeat(np.frombuffer(language, np.int32), counts)
        self.row = np.repeat(np.array(rows, np.int64), counts)
        self.seeds = np.fromiter((xxhash.xxh3_64_intdigest(name.encode()) for name in languages), np.uint64, len(languages))
        is_word = self.numbers >= 0
        of_words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        hashes = np.zeros(len(self.numbers), np.uint64)
        hashes[is_word] = of_words[self.numbers[is_word]]
        self.breaks = np.concatenate([[0], np.cumsum(~is_word)])
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64, out=self.prefix[1:])
        self.inverse = _powers(_INVERSE, len(hashes))

    def places(self, n: int) -> np.ndarray:
        """Starts of all n-grams that lie within a piece."""
        if len(self.numbers) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.breaks[n:] == self.breaks[:-n])

    def fingerprints(self, places: np.ndarray, n: int) -> np.ndarray:
        """The polynomial between two places, divided by the power of the first, mixed with length and language."""
        sums = (self.prefix[places + n] - self.prefix[places]) * self.inverse[places]
        return _prints(sums, self.seeds[self.language[places]], n)


def _may_be_frequent(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    found = np.ones(len(prints), bool)
    for shift in (0, PRINT_BITS - MAP_BITS):
        at = (prints >> np.uint64(shift)) & np.uint64((1 << MAP_BITS) - 1)
        found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return found


def _frequent_places(lot: _Lot, n: int, bits: np.ndarray) -> np.ndarray:
    """Starts of n-grams whose two (n-1)-grams may both be frequent."""
    places = lot.places(n)
    shorter = lot.places(n - 1)
    frequent = np.zeros(len(lot.numbers) + 1, bool)
    frequent[shorter[_may_be_frequent(bits, lot.fingerprints(shorter, n - 1))]] = True
    return places[frequent[places] & frequent[places + 1]]


def _by_words(lot: _Lot, n: int, places: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and counts of the phrases: occurrences of one fingerprint are compared with the first of them,
    word by word, and those that differ are compared among themselves in the next round."""
    while len(places):
        _, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
        model = places[first][inverse]
        same = lot.language[places] == lot.language[model]
        for k in range(n):
            same &= lot.numbers[places + k] == lot.numbers[model + k]
        yield places[first], np.bincount(inverse[same], minlength=len(first))
        places, prints = places[~same], prints[~same]


def _read_lots(batches: Iterator[pa.RecordBatch]) -> Iterator[_Lot]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield _Lot(*(column[row].as_py() for column in batch.columns))


def _counted_prints(lots: DataFrame, n: int, bits: Broadcast) -> DataFrame:
    """Fingerprints of n-grams with their count and the first row that has them, over all tasks."""
    schema = "print long, n long, row long"
    arrow = _arrow_schema(lots.sparkSession, schema)

    def run(batches):
        for lot in _read_lots(batches):
            places = _frequent_places(lot, n, bits.value)
            prints, first, counts = np.unique(lot.fingerprints(places, n), return_index=True, return_counts=True)
            columns = [prints.view(np.int64), counts.astype(np.int64), lot.row[places[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    return lots.mapInArrow(run, schema).groupBy("print").agg(F.sum("n").alias("n"), F.min("row").alias("row"))


def _bit_map(prints: DataFrame) -> np.ndarray:
    """The map of the given fingerprints: at most 2^MAP_BITS bits reach the driver, whatever their number."""
    value = F.col("print")
    low = (1 << MAP_BITS) - 1
    places = F.array(value.bitwiseAND(F.lit(low)), F.shiftright(value, PRINT_BITS - MAP_BITS))
    words = (
        prints.select(F.explode(places).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    )
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    found = words.toArrow()
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _counted_words(lots: DataFrame) -> DataFrame:
    """(lang, phrase, f, row) of every word: words are short, so that they are counted as text from the start."""
    schema = "lang string, phrase binary, f long, row long"
    arrow = _arrow_schema(lots.sparkSession, schema)

    def run(batches):
        for lot in _read_lots(batches):
            texts, names = pa.array(lot.words, pa.binary()), pa.array(lot.names, pa.string())
            places = lot.places(1)
            for at, counts in _by_words(lot, 1, places, lot.fingerprints(places, 1)):
                columns = [names.take(pa.array(lot.language[at])), texts.take(pa.array(lot.numbers[at])), counts, lot.row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lots.mapInArrow(run, schema).groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("row").alias("row"))


def _with_prints(phrases: DataFrame) -> DataFrame:
    """Frequent phrases (lang, phrase, more) with their fingerprints, computed from the text."""
    schema = ", ".join(f"{name} {kind}" for name, kind in [*phrases.dtypes, ("print", "bigint")])
    arrow = _arrow_schema(phrases.sparkSession, schema)
    lang, text = phrases.columns.index("lang"), phrases.columns.index("phrase")

    def run(batches):
        for batch in batches:
            words = [phrase.split(b" ") if phrase else [] for phrase in batch.column(text).to_pylist()]
            sums = [sum(xxhash.xxh3_64_intdigest(w) * pow(_BASE, k, 1 << 64) for k, w in enumerate(own)) % (1 << 64) for own in words]
            seeds = [xxhash.xxh3_64_intdigest(name.encode()) for name in batch.column(lang).to_pylist()]
            prints = _prints(np.array(sums, np.uint64), np.array(seeds, np.uint64), [len(own) for own in words])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], schema=arrow)

    return phrases.mapInArrow(run, schema)


def _phrases(lots: DataFrame, maps: list[Broadcast]) -> DataFrame:
    """(lang, length, phrase, f) of all n-grams, from two words on, whose fingerprint may be frequent, counted by their words.

    The row of length 0 and phrase '' counts the words of a language.
    """
    schema = "lang string, length int, phrase binary, f long"
    arrow = _arrow_schema(lots.sparkSession, schema)

    def run(batches):
        for lot in _read_lots(batches):
            texts, names = pa.array(lot.words, pa.binary()), pa.array(lot.names, pa.string())
            every = np.bincount(lot.language[lot.places(1)], minlength=len(lot.names))
            yield rows(names, 0, pa.array([b""] * len(every), pa.binary()), every)
            for n in range(2, len(maps) + 1):
                places = _frequent_places(lot, n, maps[n - 2].value)
                prints = lot.fingerprints(places, n)
                likely = _may_be_frequent(maps[n - 1].value, prints)
                for at, counts in _by_words(lot, n, places[likely], prints[likely]):
                    words = [texts.take(pa.array(lot.numbers[at + k])) for k in range(n)]
                    yield rows(names.take(pa.array(lot.language[at])), n, pc.binary_join_element_wise(*words, b" "), counts)

    def rows(names, length, phrases, counts):
        columns = [names, np.full(len(counts), length, np.int32), phrases, counts]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return lots.mapInArrow(run, schema).groupBy("lang", "length", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """Every phrase of 1 to ``longest`` words that occurs ``least`` times in a language, with its exact count ``f``.

    Columns: lang, length, phrase (words parted by one blank), f, ``first_doc`` (id of the first row, as read, that its
    fingerprint points to) and ``collided`` (the fingerprint counts more than the phrase: another one shares it, and
    ``first_doc`` may be that one's). A row of length 0 and an empty phrase counts all words of its language.
    """
    language = F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        language.alias("lang"),
        F.col(text_column).cast("string").alias("text"),
        F.col(id_column).alias("id"),
    )
    kept = stored(_lots(rows), "collocation-lots")
    lots = kept.drop("ids")
    ids = kept.select(F.explode(F.arrays_zip("rows", "ids")).alias("of")).select(F.col("of.rows").alias("row"), F.col("of.ids").alias("first_doc"))
    context = docs.sparkSession.sparkContext
    words = stored(_counted_words(lots).filter(F.col("f") >= least), "frequent-words")
    maps, prints = [context.broadcast(_bit_map(_with_prints(words.select("lang", "phrase"))))], []
    for n in range(2, longest + 1):
        prints.append(stored(_counted_prints(lots, n, maps[-1]).filter(F.col("n") >= least), f"prints-{n}"))
        maps.append(context.broadcast(_bit_map(prints[-1])))
    phrases = _phrases(lots, maps).filter((F.col("f") >= least) | (F.col("length") == 0))
    if prints:
        pointed = reduce(DataFrame.unionByName, prints).withColumnsRenamed({"n": "print_f", "row": "print_row"})
        collided = F.coalesce(F.col("f") != F.col("print_f"), F.lit(False)).alias("collided")
        phrases = _with_prints(phrases).join(pointed, "print", "left").select("lang", "length", "phrase", "f", F.col("print_row").alias("row"), collided)
    else:
        phrases = phrases.select("lang", "length", "phrase", "f", F.lit(None).cast("long").alias("row"), F.lit(False).alias("collided"))
    single = words.select("lang", F.lit(1).alias("length"), "phrase", "f", "row", F.lit(False).alias("collided"))
    return (
        phrases.unionByName(single)
        .join(ids, "row", "left")
        .select("lang", "length", F.col("phrase").cast("string").alias("phrase"), "f", "first_doc", "collided")
    )


def _cut(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def scored(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` with l, r and score of their lowest-scoring cut, ties to the cut after the fewest words.

    Both parts of a frequent phrase are frequent, so that their counts are rows of ``phrases``.
    """
    words = F.split("phrase", " ", -1)
    cuts = candidates.select(
        "lang", "phrase", "length", "first_doc", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    ).select("*", _cut(words, 1, F.col("k")).alias("head"), _cut(words, F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    heads = broadcast_if_small(known.withColumnsRenamed({"part": "head", "part_f": "l"}))
    tails = broadcast_if_small(known.withColumnsRenamed({"part": "tail", "part_f": "r"}))
    score = F.expr("CAST((2000000BD * CAST(a AS DECIMAL(30,0))) div (l + r) AS BIGINT)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase", "length", "a", "first_doc")
        .agg(weakest)
        .select("lang", "phrase", "length", "a", "cut.l", "cut.r", "cut.score", "first_doc")
    )


def unshadowed(candidates: DataFrame, shadow: int = SHADOW) -> DataFrame:
    """Candidates whose words do not lie within a longer candidate that has ``shadow`` percent of their occurrences."""
    words = F.split("phrase", " ", -1)
    within = candidates.filter(F.col("length") > 2).select(
        "lang", "phrase", "length", "f", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m")
    )
    parts = (
        within.select("lang", "phrase", "f", "m", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("i"))
        .select("lang", _cut(words, F.col("i"), F.col("m")).alias("phrase"), F.col("f").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    shadowed = 100 * _exact("longer") >= shadow * _exact("f")
    return candidates.join(parts, ["lang", "phrase"], "left").filter(F.coalesce(~shadowed, F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shadow: int = SHADOW, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score, first_doc.

    A phrase of 2 to ``longest`` words that occurs ``least`` times (a) is scored floor(2000000 a / (l + r)) at its weakest
    cut into parts that occur l and r times; n counts the words of its language. A missing language is 'und', a missing text
    has no words. Repeated rows count each. Ties in score go to the larger a, then to the smaller phrase in byte order. Only
    the three named columns are read. An empty table gives no rows.
    """
    phrases = stored(frequent_phrases(docs, least, longest, id_column, lang_column, text_column), "frequent-phrases")
    candidates = phrases.filter(F.col("length") > 1)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = (
        scored(phrases.filter(F.col("length") > 0), unshadowed(candidates, shadow))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
    )
    totals = phrases.filter(F.col("length") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(broadcast_if_small(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "first_doc"
    )
