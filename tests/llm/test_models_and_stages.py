"""The fitted models against plain versions of their arithmetic, and each stage of the pipeline against what it should keep."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindlewise.llm import jaccard_join, quality_model, toxicity

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


# quality model


def test_summed_normal_equations_equal_a_direct_ridge(spark):
    rng = np.random.default_rng(4)
    size = len(quality_model.STATISTICS)
    stats = rng.normal(size=(400, size)) * rng.uniform(0.1, 9, size)
    label = (stats[:, 0] + np.sin(stats[:, 1]) + rng.normal(size=400) / 3 > 0).astype(int)
    rows = spark.createDataFrame([(list(map(float, s)), int(y)) for s, y in zip(stats, label)], "stats array<double>, label int").repartition(7)
    model = quality_model.fit(rows)

    scaled = np.clip((stats - stats.mean(axis=0)) / stats.std(axis=0), -6, 6)
    draw = np.random.default_rng(quality_model.SEED)
    directions = draw.normal(0, 1 / quality_model.WIDTH, (size, quality_model.FEATURES))
    phases = draw.uniform(0, 2 * np.pi, quality_model.FEATURES)
    waves = [[1.0, *(math.sqrt(2 / quality_model.FEATURES) * math.cos(row @ directions[:, k] + phases[k]) for k in range(quality_model.FEATURES))] for row in scaled]
    # ridge as least squares with rows of its own for the penalty, none (but 1e-9) for the constant
    roots = np.sqrt(np.diag([1e-9, *[quality_model.RIDGE] * quality_model.FEATURES]))
    direct = np.linalg.lstsq(np.vstack([waves, roots]), np.concatenate([label, np.zeros(len(roots))]), rcond=None)[0]
    assert np.allclose(model.weights, direct, atol=1e-6)

    # the calibration never falls, stays within shares, and ties values to the share of their bins
    values = np.array(waves) @ direct
    scores = model.scores(stats)
    assert (np.diff(scores[np.argsort(values)]) >= -1e-9).all() and 0 <= scores.min() <= scores.max() <= 1
    assert scores.mean() == pytest.approx(label.mean(), abs=0.03)


def test_fourier_features_approximate_the_kernel():
    size = len(quality_model.STATISTICS)
    model = quality_model.Model(np.zeros(size), np.ones(size), np.zeros(quality_model.FEATURES + 1), None, 0.5)
    points = np.random.default_rng(1).normal(size=(30, size)) / 2
    near = model.features(points)[:, 1:] @ model.features(points)[:, 1:].T
    exact = np.exp(-((points[:, None] - points[None]) ** 2).sum(axis=2) / (2 * quality_model.WIDTH**2))
    assert np.abs(near - exact).mean() < 0.08


# toxicity model


def plain_marginals(emissions, chain):
    """Probability of toxic at each place, by sums over both states of what is before and after, in logarithms."""
    if not emissions:
        return []
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    move = lambda a, b: chain.moves[2 * a + b]
    ahead = [[0.0, chain.start + emissions[0]]]
    for e in emissions[1:]:
        ahead.append([add(ahead[-1][0] + move(0, b), ahead[-1][1] + move(1, b)) + b * e for b in (0, 1)])
    behind = [[0.0, 0.0]]
    for e in reversed(emissions[1:]):
        behind.insert(0, [add(move(a, 0) + behind[0][0], move(a, 1) + e + behind[0][1]) for a in (0, 1)])
    return [1 / (1 + math.exp((f[0] + b[0]) - (f[1] + b[1]))) for f, b in zip(ahead, behind)]


def plain_emission(chain, token):
    return chain.bias + sum(chain.weights.get(part, 0.0) for part in toxicity.parts(token))


def plain_summary(p):
    return [1.0, math.log1p(sum(p)), max(p, default=0.0), math.sqrt(sum(p) / len(p)) if p else 0.0]


@pytest.fixture(scope="module")
def training():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    plain = [word() for _ in range(300)]
    rows = []
    for k in range(60):
        words = rng.choices(plain, k=rng.randint(5, 60))
        if k % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["zorkwit", "qwuxle", "vozzip"], k=3)
        rows.append((" ".join(words).encode(), int(k % 5 == 0)))
    return rows


def test_scores_equal_a_plain_chain(spark, training):
    chain = toxicity.fit(training)
    texts = [text.decode() for text, _ in training] + ["", None, "  ", "zorkwit", "zorkwit " * 400, "new words only"]
    for row in toxicity.scored(docs(spark, texts), chain).collect():
        tokens = (texts[row.doc_id] or "").encode().split()
        p = plain_marginals([plain_emission(chain, t) for t in tokens], chain)
        score = 1 / (1 + math.exp(-sum(b * x for b, x in zip(chain.document, plain_summary(p)))))
        assert row.score == pytest.approx(score, abs=1e-7) and row.predicted == int(row.score >= 0.5)
        marked = {k for k, m in enumerate(re_tokens(texts[row.doc_id] or "")) if any(s.start <= m[0] and m[1] <= s.end for s in row.spans)}
        assert marked == {k for k, x in enumerate(p) if x >= 0.5}


def re_tokens(text):
    at, out = 0, []
    for token in text.split():
        at = text.index(token, at)
        out.append((at, at + len(token)))
        at += len(token)
    return out


def test_the_fit_is_where_the_document_likelihood_is_greatest(training):
    """Of fewer than 16 toxic rows all fit both halves: the document weights must be a zero of the penalized gradient."""
    chain = toxicity.fit(training)
    rows = toxicity._distinct(training)
    x = np.array([plain_summary(plain_marginals([plain_emission(chain, t) for t in text.split()], chain)) for text, _ in rows])
    y = np.array([label for _, label in rows])
    beta = np.array(chain.document)
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs(x.T @ (y - p) - 0.05 * beta).max() < 1e-4
    assert ((p >= 0.5) == (y == 1)).all()


def test_the_chain_learns_the_marked_tokens(training):
    chain = toxicity.fit(training)

    def likelihood(c):
        total = 0.0
        for text, label in training:
            tokens = text.split()
            gold = [int(label and t in (b"zorkwit", b"qwuxle", b"vozzip")) for t in tokens]
            e = [plain_emission(c, t) for t in tokens]
            path = c.start * gold[0] + sum(a * g for a, g in zip(e, gold)) + sum(c.moves[2 * a + b] for a, b in zip(gold, gold[1:]))
            ahead = [0.0, c.start + e[0]]
            for value in e[1:]:
                ahead = [np.logaddexp(ahead[0] + c.moves[b], ahead[1] + c.moves[2 + b]) + b * value for b in (0, 1)]
            total += path - np.logaddexp(*ahead)
        return total

    start = toxicity.Chain({}, -3.0, -1.0, (0.0,) * 4, (), 0.0)
    assert likelihood(chain) > likelihood(start) / 4  # both negative; the start knows no token
    assert all(plain_emission(chain, t) > 0 for t in (b"zorkwit", b"qwuxle", b"vozzip"))


def test_a_repeated_id_is_one_training_row(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    held_in = toxicity.training_rows(docs(spark, ["b", "a", "c", "a", None], [1, 1, 1, 2, 3]), labels, "toxic")
    known = {i: label for i, label in ((1, 1), (2, 0), (3, 0)) if zlib_fold(i) != toxicity.HELD_OUT_FOLD}
    want = {1: (b"a", 1), 2: (b"a", 0), 3: (b"", 0)}
    assert held_in == [want[i] for i in sorted(known)]


def zlib_fold(number):
    import zlib

    return zlib.crc32(str(number).encode()) % toxicity.FOLDS


# near copies


def test_one_of_exactly_repeated_rows_stays(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [base, base, base + " x", "alone and short text of six", "alone and short text of six", "", "", None]
    ids = [3, 3, 5, 8, 8, 9, 9, 10]
    kept = sorted((r.doc_id, r.text or "") for r in jaccard_join.one_of_each(docs(spark, texts, ids)).collect())
    assert kept == [(3, base), (8, texts[3]), (9, ""), (9, ""), (10, "")]
    same_id = jaccard_join.one_of_each(docs(spark, [base, base + " x"], [4, 4])).collect()
    assert len(same_id) == 1


# stages


def plain_components(texts):
    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {pair for ids in holders.values() for pair in itertools.combinations(ids, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i for i in texts if not sets[i] or root(i) == i}


def lower_ascii(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_each_stage_keeps_what_it_should(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    best = {}
    expected = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).filter("score < 0.5").collect()},
        "quality": lambda d: {r.doc_id for r in quality_model.quality(d, labels).filter(F.col("score") >= quality_model.THRESHOLD).collect()},
        "exact_dedup": lambda d: {max(ids) for ids in grouped(d).values()},
        "near_dedup": lambda d: plain_components({r.doc_id: r.text for r in d.collect()}),
        "packing": lambda d: {r.doc_id for r in d.collect()},
    }

    def grouped(d):
        groups = {}
        for r in d.collect():
            groups.setdefault(lower_ascii(r.text), []).append(r.doc_id)
        return groups

    assert list(expected) == [name for name, _ in corpus_pipeline.STAGES]
    dealt = table
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, dealt, FOLDER).cache()
        kept = [r.doc_id for r in left.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) == expected[name](dealt), name
        best[name] = len(kept)
        dealt = left
    assert table.count() > best["toxicity"] > best["quality"] > best["exact_dedup"] > best["near_dedup"] == best["packing"]


# tables that may be broadcast


def test_broadcasts_are_bounded_by_rows_and_by_bytes(spark, monkeypatch):
    from spindlewise.llm import common

    table = common.stored(spark.range(1000).select("id", F.array(F.lit("x"), F.repeat(F.lit("é"), 500)).alias("texts"), F.struct(F.lit(1).alias("a")).alias("s")), "broadcast-test")
    hinted = lambda: "broadcast" in common.broadcast_if_small(table)._jdf.queryExecution().logical().toString()
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 900_000)
    assert not hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2_000_000)
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 999)
    assert not hinted()
    assert "broadcast" in common.broadcast_if_small(table.limit(0))._jdf.queryExecution().logical().toString()
