"""Toxic spans by a linear-chain conditional random field, trained on document labels.

Documents are labelled, tokens are not. So tokens of toxic training documents are labelled first: a token is toxic when
its word or one of its beginnings is much more frequent in toxic than in other training documents. A two-state chain
over those tokens is fitted by gradient ascent; forward-backward marginals of every token of a text are summed up to a
document score (logistic, fitted on documents the chain has not seen) and to the offsets of offending spans.

Only the model (weights of word beginnings) is broadcast. It is fitted on a sample of labelled rows whose size is bounded
by ``TrainingBounds``; scoring reads every whole text in Arrow batches and needs no shuffle.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import WORD, arrow_filter, arrow_rows, crc_fold
from spindlewise.llm.jaccard_join import WordHash, tokens_of

FOLDS, HELD_OUT_FOLD = 5, 0
_STRIP = b".,;:!?%*&$#|\"'()[]{}<>-_"
#: Tokens of a training sequence; longer texts are cut into several. Scoring never cuts.
_WINDOW = 128
_SCORED = "doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class TrainingBounds:
    """Most labelled rows the model is fitted on. Longer texts are not taken into the sample; scoring takes all."""

    toxic_rows: int = 2000
    other_rows: int = 4000
    longest_text: int = 50_000


@dataclass(frozen=True)
class Chain:
    """Weights of word beginnings, transitions and the document score. ``document`` is empty: no model, score ``prior``."""

    weights: dict[bytes, float]
    bias: float
    start: float
    moves: tuple[float, float, float, float]
    document: tuple[float, ...]
    prior: float = 0.0


def parts(token: bytes) -> list[bytes]:
    """The word, marked as whole, and its beginnings of three to eight letters, in lower case without outer marks."""
    word = token.strip(_STRIP).decode("utf-8", "replace").lower()
    return [("=" + word).encode(), *(word[:n].encode() for n in range(3, min(len(word), 9)))]


class Emissions(dict):
    """Weight of toxic over other for a token, remembered for a bounded number of different tokens."""

    def __init__(self, chain: Chain, most: int = 500_000):
        super().__init__()
        self.chain, self.most = chain, most

    def __missing__(self, token: bytes) -> float:
        get = self.chain.weights.get
        value = self.chain.bias + sum(get(part, 0.0) for part in parts(token))
        if len(self) >= self.most:
            self.clear()
        self[token] = value
        return value


def _odds(emissions: np.ndarray, moves, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds (toxic over other) of padded sequences, by step and sequence.

    ``emissions`` has a row per step and a column per sequence; what stands after a sequence's end must be zero, and
    only the forward half may be read there. Backward odds are handed the end by the caller's mask.
    """
    t00, t01, t10, t11 = np.exp(moves)
    forward = np.empty_like(emissions)
    forward[0] = start + emissions[0]
    for step in range(1, len(emissions)):
        odds = np.exp(np.clip(forward[step - 1], -50, 50))
        forward[step] = emissions[step] + np.log((t01 + t11 * odds) / (t00 + t10 * odds))
    return forward


def _backward(emissions: np.ndarray, ends: np.ndarray, moves) -> np.ndarray:
    t00, t01, t10, t11 = np.exp(moves)
    backward = np.zeros_like(emissions)
    for step in range(len(emissions) - 2, -1, -1):
        odds = np.exp(np.clip(emissions[step + 1] + backward[step + 1], -50, 50))
        backward[step] = np.where(step < ends - 1, np.log((t10 + t11 * odds) / (t00 + t01 * odds)), 0.0)
    return backward


def marginals(sequences: list[np.ndarray], chain: Chain, cells: int = 1 << 20) -> list[np.ndarray]:
    """Probability that a token is toxic, for each token of each sequence. Sequences of like length run side by side."""
    out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
    at = len(order)
    while at:
        longest = len(sequences[order[at - 1]])
        group = order[max(0, at - max(1, min(96, cells // longest))) : at]
        at -= len(group)
        lengths = np.array([len(sequences[i]) for i in group])
        padded = np.zeros((longest, len(group)))
        for column, i in enumerate(group):
            padded[: lengths[column], column] = sequences[i]
        both = _odds(padded, chain.moves, chain.start) + _backward(padded, lengths, chain.moves)
        values = 1 / (1 + np.exp(-np.clip(both, -50, 50)))
        for column, i in enumerate(group):
            out[i] = values[: lengths[column], column]
    return out


def _summary(p: np.ndarray) -> tuple[float, ...]:
    """What the document score sees: expected toxic tokens (log), the surest one, and their share (root)."""
    if not len(p):
        return (1.0, 0.0, 0.0, 0.0)
    total = float(p.sum())
    return (1.0, float(np.log1p(total)), float(p.max()), float(np.sqrt(total / len(p))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _distinct(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Without copies: a text that shares one of two smallest five-word passages (by hash) with an earlier one goes."""
    hashes, seen, kept = WordHash(), set(), []
    for text, label in rows:
        passages = tokens_of(text, hashes)
        marks = {(salt, int((passages * np.uint64(salt)).min(initial=2**64 - 1))) for salt in (1, 0x9E3779B97F4A7C15)}
        if not marks & seen:
            kept.append((text.lower(), label))
        seen |= marks
    return kept


def _toxic_parts(sequences: list[tuple[np.ndarray, int]], flat: np.ndarray, starts: np.ndarray, least_docs: int = 3, ratio: float = 8.0) -> np.ndarray:
    """For each part, whether it marks a token of a toxic document as toxic. Word w has the parts ``flat[starts[w]:starts[w + 1]]``."""
    docs = np.zeros((2, int(flat.max(initial=-1)) + 1), dtype=np.int32)
    for ids, label in sequences:
        own = [flat[starts[w] : starts[w + 1]] for w in np.unique(ids)]
        if own:
            docs[label, np.unique(np.concatenate(own))] += 1
    toxic = sum(label for _, label in sequences)
    other = len(sequences) - toxic
    return (docs[1] >= least_docs) & ((docs[1] + 0.5) / (toxic + 1) >= ratio * (docs[0] + 0.5) / (other + 1))


def fit(rows: list[tuple[bytes, int]], steps: int = 50, penalty: float = 2e-5) -> Chain:
    """A chain from (text, toxic) rows. With labels of one kind only, or none, every text scores the share of toxic rows."""
    prior = float(np.mean([label for _, label in rows])) if rows else 0.0
    docs = _distinct(rows)
    if len({label for _, label in docs}) < 2:
        return Chain({}, 0.0, 0.0, (0.0,) * 4, (), prior)
    learn = [d for k, d in enumerate(docs) if k % 4] if sum(label for _, label in docs) >= 16 else docs
    words: dict[bytes, int] = {}
    sequences = [(np.fromiter((words.setdefault(t, len(words)) for t in text.split()), dtype=np.int32), label) for text, label in learn]
    features: dict[bytes, int] = {}
    flat, sizes = array("i"), array("i")
    for word in words:
        own = [features.setdefault(p, len(features)) for p in parts(word)]
        flat.extend(own)
        sizes.append(len(own))
    flat, owner = np.array(flat), np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    marks = _toxic_parts(sequences, flat, np.append(0, np.cumsum(sizes)))
    marked = np.append(np.bincount(owner, weights=marks[flat], minlength=len(words)) > 0, False)
    windows = [(ids[k : k + _WINDOW], label) for ids, label in sequences for k in range(0, len(ids), _WINDOW)]
    windows.sort(key=lambda window: len(window[0]))
    groups = []
    for k in range(0, len(windows), 1024):
        part = windows[k : k + 1024]
        lengths = np.array([len(ids) for ids, _ in part])
        at = np.full((lengths.max(), len(part)), len(words), dtype=np.int32)  # the padding is a word of its own, without weight
        for column, (ids, _) in enumerate(part):
            at[: len(ids), column] = ids
        groups.append((at, lengths, at < len(words), marked[at] & np.array([bool(label) for _, label in part])))
    total = sum(len(ids) for ids, _ in windows) or 1
    w, rest = np.zeros(len(features)), np.array([-3.0, -1.0, 0.0, 0.0, 0.0, 0.0])  # bias, start, moves
    state = [np.zeros(len(w)), np.zeros(len(w)), np.zeros(6), np.zeros(6)]
    for step in range(1, steps + 1):
        emission = np.append(rest[0] + np.bincount(owner, weights=w[flat], minlength=len(words)), 0.0)
        by_word, g = np.zeros(len(words) + 1), np.zeros(6)
        for at, lengths, inside, toxic in groups:
            padded, gold = emission[at], toxic.astype(float)
            forward, backward = _odds(padded, rest[2:], rest[1]), _backward(padded, lengths, rest[2:])
            miss = np.where(inside, gold - _sigmoid(forward + backward), 0.0)
            by_word += np.bincount(at.ravel(), weights=miss.ravel(), minlength=len(by_word))
            g[1] += miss[0].sum()
            after = padded[1:] + backward[1:]
            joint = np.stack([np.full(after.shape, rest[2]), rest[3] + after, rest[4] + forward[:-1], rest[5] + forward[:-1] + after])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            pairs = np.stack([(1 - gold[:-1]) * (1 - gold[1:]), (1 - gold[:-1]) * gold[1:], gold[:-1] * (1 - gold[1:]), gold[:-1] * gold[1:]])
            g[2:] += ((pairs - joint) * inside[1:]).sum(axis=(1, 2))
        g[0] = by_word[:-1].sum()
        gw = np.bincount(flat, weights=by_word[owner], minlength=len(w)) / total * 1e3 - penalty * 1e3 * w
        for value, slope, (m, v) in ((w, gw, state[:2]), (rest, g / total * 1e3, state[2:])):
            m *= 0.9
            m += 0.1 * slope
            v *= 0.99
            v += 0.01 * slope * slope
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
    weights = {p: float(w[i]) for p, i in features.items() if abs(w[i]) > 0.02}
    chain = Chain(weights, float(rest[0]), float(rest[1]), tuple(map(float, rest[2:])), (), prior)
    check = [d for k, d in enumerate(docs) if not k % 4] if learn is not docs else docs
    emissions = Emissions(chain)
    found = marginals([np.array([emissions[t] for t in text.split()]) for text, _ in check], chain)
    x, y = np.array([_summary(p) for p in found]), np.array([label for _, label in check], dtype=float)
    beta = np.array([-2.0, 1.0, 1.0, 1.0])
    for _ in range(30):  # Newton steps with a ridge, which also keeps separable labels finite
        p = _sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
    return Chain(weights, chain.bias, chain.start, chain.moves, tuple(map(float, beta)), prior)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bounds: TrainingBounds = TrainingBounds()) -> list[tuple[bytes, int]]:
    """A bounded, repeatable sample of labelled (text, label) rows outside the held-out fold.

    Labels that are null, or have no document id, teach nothing; a document with several labels counts with the largest.
    Null texts count as empty ones. Of several texts under one id the smallest counts, so that the bounds hold for rows.
    """
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    pick = lambda is_toxic, most: known.where((F.col("label") > 0) == is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = pick(True, bounds.toxic_rows).unionAll(pick(False, bounds.other_rows))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(
        F.length("text") <= bounds.longest_text
    )
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = sorted((r.doc_id, r.text.encode(), int(r.label > 0)) for r in joined.collect())
    return [(text, label) for _, text, label in rows]


def _scores(texts: list[bytes], chain: Chain, emissions: Emissions) -> tuple[list[float], list[np.ndarray]]:
    """Score of each text and the marginals of its tokens."""
    if not chain.document:
        return [chain.prior] * len(texts), [np.zeros(0)] * len(texts)
    found = marginals([np.fromiter(map(emissions.__getitem__, t.split()), dtype=float) for t in texts], chain)
    return [float(_sigmoid(np.dot(chain.document, _summary(p)))) for p in found], found


def not_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all columns. Nothing is joined or shuffled for it."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        emissions = Emissions(shared.value)
        return lambda texts: [score < threshold for score in _scores(texts, shared.value, emissions)[0]]

    return arrow_filter(docs, "text", make)


def scored(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted and ``spans``, offsets of toxic spans in characters.

    Null texts are empty; an empty text scores as one without toxic tokens. Repeated rows score alike. A null id is in
    no fold and so not held out. Other columns are not read. An empty table gives none.
    """
    source = docs.select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def step():
        chain = model.value
        emissions = Emissions(chain)

        def batch(rows):
            texts = rows.column(2).to_pylist()
            scores, found = _scores(texts, chain, emissions)
            spans = [_spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, found)]
            return [rows.column(0), rows.column(1), scores, [int(s >= threshold) for s in scores], spans]

        return batch

    kind = source.schema["doc_id"].dataType.simpleString()
    return arrow_rows(source, step, _SCORED.format(kind=kind), text=2)


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of tokens that are toxic with probability a half at least."""
    spans: list[dict] = []
    last = -2
    for k, found in enumerate(re.finditer(WORD, text.decode("utf-8", "replace"))):
        if p[k] >= 0.5:
            if k == last + 1:
                spans[-1]["end"] = found.end()
            else:
                spans.append({"start": found.start(), "end": found.end()})
            last = k
    return spans


def toxicity(docs: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, then score all of ``docs``."""
    return scored(docs, fit(training_rows(docs, labels, "toxic", bounds)))
