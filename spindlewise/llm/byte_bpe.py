"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes.

The hash is built once, on the driver, over the vocabulary: bucket, displacement, slot. A slot names one candidate, whose
bytes are compared, so strangers are never taken for members. A pre-token that is no member starts as a linked list of
bytes; a heap holds the ranks of neighbouring pairs, and the lowest rank, leftmost first, is merged until none is left.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import arrow_rows

_MASK = 0xFFFFFFFF
_ENTRY = 40  # bytes that a dict has for an entry, about
_SHORT = 24
_LOOSE, _CUT = re.compile(r" (?:\s|\Z)"), re.compile(r"(?= \S)")


@dataclass(frozen=True, eq=False)
class Vocabulary:
    """Token bytes by slot of the hash and by id. ``displacements`` below zero name the slot itself."""

    seed: int
    displacements: list[int]
    slots: list[tuple[bytes, int]]
    by_id: dict[int, bytes]

    def rank(self, piece: bytes) -> int | None:
        """Id of ``piece`` when it is a token."""
        low, high = _halves(piece, self.seed)
        d = self.displacements[high % len(self.displacements)]
        token, rank = self.slots[-d - 1 if d < 0 else (low + d * (high | 1)) % len(self.slots)]
        return rank if token == piece else None


def _halves(piece: bytes, seed: int) -> tuple[int, int]:
    value = xxhash.xxh3_64_intdigest(piece, seed)
    return value & _MASK, value >> 32


def vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """Minimal perfect hash over ``ranks``: large buckets search a displacement, single keys take what slots are left."""
    size = len(ranks)
    for seed in range(100):
        buckets: dict[int, list[tuple[int, int, bytes]]] = {}
        count = size * 2 // 5 + 1
        for token in ranks:
            low, high = _halves(token, seed)
            buckets.setdefault(high % count, []).append((low, high | 1, token))
        slots: list[tuple[bytes, int] | None] = [None] * size
        displacements = [0] * count
        free = None
        for bucket, keys in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
            if len(keys) == 1:
                free = free or iter([k for k, s in enumerate(slots) if s is None])
                at = next(free)
                displacements[bucket], slots[at] = -at - 1, (keys[0][2], ranks[keys[0][2]])
                continue
            for d in range(1 << 16):
                places = {(low + d * high) % size for low, high, _ in keys}
                if len(places) == len(keys) and all(slots[p] is None for p in places):
                    break
            else:
                break  # another seed
            displacements[bucket] = d
            for low, high, token in keys:
                slots[(low + d * high) % size] = (token, ranks[token])
        else:
            return Vocabulary(seed, displacements, slots, {r: t for t, r in ranks.items()})
    raise ValueError("no perfect hash found: are there equal tokens?")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, rank) -> list[int]:
    """Ids of a pre-token that is no token. ``rank`` gives the id of bytes, or None. n log n steps for n bytes.

    A heap entry is one number: rank, place of the left part and end of the right one, so equal ranks go left to right.
    The list is linked by ends: a part ends where the next one begins, and one that was merged away leads past the last.
    """
    n = len(piece)
    ends, before = [*range(1, n + 1), -1], list(range(-1, n))
    shift = n.bit_length()
    low = (1 << shift) - 1
    heap = [((r << shift | k) << shift) | k + 2 for k in range(n - 1) if (r := rank(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        end, left = entry & low, entry >> shift & low
        right = ends[left]
        if ends[right] != end:
            continue  # one of the two has been merged meanwhile
        ends[left], ends[right] = end, n
        before[end] = left
        if end < n and (r := rank(piece[left : (following := ends[end])])) is not None:
            push(heap, ((r << shift | left) << shift) | following)
        if (previous := before[left]) >= 0 and (r := rank(piece[previous:end])) is not None:
            push(heap, ((r << shift | previous) << shift) | end)
    ids, left = [], 0
    while left < n:
        if (r := rank(piece[left : ends[left]])) is not None:
            ids.append(r)
        left = ends[left]
    return ids


class Encoder(dict):
    """Ids (32-bit, packed) of runs of text, remembered for a bounded number of different short ones.

    A text is cut before each space that is followed by something else than white space. The pattern starts a match at
    every such place, whatever stands before, so runs are encoded each on its own. Those of one match of the pattern are
    remembered; others are put together from these, and a sixth as many, very short ones, are kept beside. When ``most`` are remembered, or ``most_bytes`` with what
    Python needs for them, they become the older half of the memory, from which those that come again return.
    """

    def __init__(self, words: Vocabulary, pattern: str, most: int = 300_000, longest: int = 64, most_bytes: int = 40 << 20):
        super().__init__()
        self.rank, self.pieces, self.most, self.longest = words.rank, regex.compile(pattern).findall, most, longest
        self.older: dict[str, bytes] = {}
        self.most_bytes, self.bytes = most_bytes, 0
        self.joined: dict[str, bytes] = {}
        self.pair = {token: rank for token, rank in words.slots}.get  # of merges, which ask for strangers mostly

    def __missing__(self, run: str) -> bytes:
        packed = self.joined.get(run)
        if packed is not None:
            return packed
        packed = self.older.pop(run, None)
        if packed is not None:
            self._remember(run, packed)
            return packed
        pieces = self.pieces(run)
        if len(pieces) != 1:
            packed = b"".join(map(self.__getitem__, pieces))
            if len(run) <= _SHORT:
                if len(self.joined) >= self.most // 6:
                    self.joined.clear()
                self.joined[run] = packed
            return packed
        data = run.encode()
        whole = self.rank(data)
        packed = array("i", merged(data, self.pair) if whole is None else (whole,)).tobytes()
        if len(run) <= self.longest:
            self._remember(run, packed)
        return packed

    def _remember(self, run: str, packed: bytes) -> None:
        if len(self) >= self.most or self.bytes >= self.most_bytes:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self[run] = packed
        self.bytes += getsizeof(run) + getsizeof(packed) + _ENTRY

    def encode(self, text: str) -> np.ndarray:
        if _LOOSE.search(text):
            runs = _CUT.split(text)
        else:
            runs = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CUT.split(text)
        return np.frombuffer(b"".join(map(self.__getitem__, runs)), dtype=np.int32)


@lru_cache(maxsize=1)
def _encoder(words: Vocabulary, pattern: str) -> Encoder:
    """One encoder in each Python process, so that tasks after the first find its memory filled.

    Each query brings a vocabulary of its own, so a second place would only keep what an earlier query remembered.
    """
    return Encoder(words, pattern)


def encoded(docs: DataFrame, words: Vocabulary, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, one row per row of ``docs``, without special tokens.

    Null and empty texts have no ids. Other columns are not read. Repeated rows are encoded each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def step():
        encoder = _encoder(shared.value, pattern)

        def batch(rows):
            ids = [encoder.encode(t) for t in rows.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]

        return batch

    source = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return arrow_rows(source, step, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>", text=1)


def decoder(words: Vocabulary, spark) -> Column:
    """Function from a column of ids to the bytes they stand for. Null ids give null; an unknown id is an error."""
    tokens = pa.array([words.by_id.get(k) for k in range(max(words.by_id, default=-1) + 1)], pa.binary())
    shared = spark.sparkContext.broadcast(tokens)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        ends = ids.offsets.to_numpy()
        flat = ids.values[ends[0] : ends[-1]] if len(ids) else []
        if not len(flat):
            return pa.array([b"" if valid else None for valid in ids.is_valid().to_pylist()], type=pa.binary())
        found = shared.value.take(flat)  # the bytes of all tokens in a row, so a text ends where its last token does
        if found.null_count:
            raise KeyError("ids that stand for no token")
        _, token_ends, data = found.buffers()
        text_ends = np.frombuffer(token_ends, np.int32)[ends - ends[0]]
        valid = pa.array(ids.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(text_ends), data])

    return decode


def digest(rows: DataFrame) -> DataFrame:
    """``n_tokens`` and SHA-256 of the ids as decimal text and of the decoded bytes, for (doc_id, ids, decoded)."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
