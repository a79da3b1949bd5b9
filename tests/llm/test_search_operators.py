"""License notices, hard negatives and collocations: edge cases, and plain versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlewise.llm import collocations, hard_negatives, license_scan

CLASHING = "doc_id long, text string, lang string, source string, row long, n long, word string, label string, step int, print long"


def docs(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(k, t, l, None, 1, 1, "x", "y", 8, 5) for k, (t, l) in enumerate(zip(texts, langs))], CLASHING)


# license notices


def plain_licenses(text, templates, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, labels, share = [], set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        wanted = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        places += at
        labels |= {label} if at else set()
    base = set(labels)
    for label, example in templates:
        wanted = re.findall(r"[0-9a-z]+", example.lower())
        step = max(8, 1 << math.ceil(math.log2(len(wanted))))
        for start in range(0, len(words), step):
            held = len(set(words[start : start + 2 * step]) & set(wanted))
            if 100 * held >= threshold * len(set(wanted)):
                labels.add(label)
                share = max(share, held / len(set(wanted)))
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), 1.0 if places else share


def test_licenses_equal_a_plain_scan(spark):
    rng = random.Random(5)
    words = "the license software permission free of charge any person a copy é MIT CC BY apache granted to hereby rights all reserved".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", " \n", "mit  license\nMIT-License mit license", "x " * 40_000 + license_scan.TEMPLATES[0].text + " y" * 3000, texts[0], texts[0]]
    for threshold in (60, 80, 100):
        got = license_scan.licensed(docs(spark, texts), threshold=threshold).collect()
        assert len(got) == len(texts)
        for row in got:
            want = plain_licenses(texts[row.doc_id], license_scan.TEMPLATES, threshold)
            assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels) == want[:6]
            assert row.score == pytest.approx(want[6])


def test_a_notice_is_found_across_blocks_and_changed_words(spark):
    notice = license_scan.words_of(license_scan.TEMPLATES[8].text.encode())
    assert license_scan.TEMPLATES[8].label == "bsd"
    for shift in (0, 1, 15, 31, 33):
        changed = [b"filler"] * shift + [w if k % 7 else b"other" for k, w in enumerate(notice)]
        (row,) = license_scan.licensed(docs(spark, [b" ".join(changed).decode()])).collect()
        assert row.labels == ["bsd"] and 0.8 <= row.score < 1
        assert any(n.label == "bsd" and n.first_word <= shift and shift + len(notice) <= n.first_word + n.n_words for n in row.notices)


def test_license_edges(spark):
    empty = docs(spark, []).limit(0)
    assert license_scan.licensed(empty).count() == 0
    (row,) = license_scan.licensed(docs(spark, ["cc by"]), templates=()).collect()
    assert (row.labels, row.score, row.notices) == (["cc-by"], 1.0, None)
    assert license_scan.licensed(docs(spark, ["plain"]), templates=(license_scan.Template("none", "..."),)).first().labels == []


# hard negatives

VECTORS = "vec_id long, label long, embedding array<float>, pack long, key long, score double"


def plain_negatives(rows, positives=5, negatives=3):
    rows = {i: (label, v) for i, label, v in rows}
    out = []
    for anchor, (label, v) in rows.items():
        if anchor % 50:
            continue
        score = {i: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, w)) for i, (_, w) in rows.items() if i != anchor}
        best = sorted((i for i in score if rows[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            fits = [i for i in score if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for rank, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:negatives], 1):
                out.append((anchor, p, rank, i, score[p], score[i]))
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, label, v, 0, 0, 0.0) for i, label, v in rows], VECTORS)


def mined(spark, rows, **settings):
    found = hard_negatives.mined(vectors(spark, rows), F.col("vec_id") % 50 == 0, **settings)
    return sorted(tuple(r) for r in found.collect())


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(3)), [float(x) for x in np.float32(centres[k % 6] + rng.normal(size=8) / 4)]) for k in range(700)]
    rows[60] = (60, 1, rows[50][2])  # equal vectors and ties
    rows[61] = (61, 2, rows[50][2])
    want = plain_negatives(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    for name, value in {"BLOCK_ROWS": 32, "PACK_ROWS": 4, "CHUNK_BLOCKS": 5, "FIRST_BLOCKS": 1}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(spark, rows) == want


def test_negative_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.75, 9.0]), (3, 2, [0.6, -2.0]), (50, None, [1.0, 1.0])]
    bad = [(4, 1, None), (5, 1, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (None, 1, [1.0, 1.0])]
    assert mined(spark, good + bad) == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 3, 65536, 256 * 153)]
    again = [good[0], (0, 2, [1.0, 0.0]), *good[1:4], good[1]]  # repeated ids: the smallest label counts
    assert mined(spark, again) == mined(spark, good)
    assert mined(spark, good[1:4]) == [] and mined(spark, []) == [] and mined(spark, [(0, 1, [])]) == []
    assert mined(spark, [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [1.0])]) == []  # a negative positive score leaves no window


def test_hilbert_curve_visits_each_cell_once_and_moves_by_one():
    for dimensions, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = hard_negatives.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_large_components_are_exact():
    a, b = np.array([[2.0**33, 3.0]]), np.array([[2.0**28, 1.0], [1.0, 2.0**40]])
    assert hard_negatives._inner(a, b).tolist() == [[2**61 + 3, 2**33 + 3 * 2**40]]


def test_zone_maps_leave_out_far_blocks(spark):
    rows = [(k, k % 2, [10.0 if k < 400 else -10.0, float(np.float32(k % 7))]) for k in range(800)]
    part = hard_negatives.taking_part(vectors(spark, rows))
    count, dimensions, axes = hard_negatives._axes(part)
    keyed = hard_negatives._with_key(part, dimensions, axes)
    blocks = hard_negatives._packed(keyed, dimensions, count, 50, hard_negatives.BLOCK_SCHEMA, True, "test-blocks")
    packs = hard_negatives._packed(keyed.filter("vec_id = 0"), dimensions, 1, 4, hard_negatives.PACK_SCHEMA, False, "test-packs")
    search = hard_negatives._Search(packs, blocks, dimensions, count)
    window = packs.select("pack", F.lit(0).alias("place"), F.lit(0).alias("slot"), F.lit(1).cast("long").alias("low"), F.lit(1 << 60).cast("long").alias("high"))
    chosen = search.bounded(hard_negatives._by_pack(window)).count()
    assert blocks.count() >= 16 and 8 <= chosen <= 9


# collocations


def plain_collocations(texts, langs, least, top=2000, shadow=80):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3, 4):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        kept = [p for p, a in f.items() if a >= least and len(p) > 1]
        inside = defaultdict(int)
        for p in kept:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], f[p])
        rows = []
        for p in kept:
            if 100 * inside.get(p, -1) >= shadow * f[p]:
                continue
            score, _, l, r = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found_collocations(table, **settings):
    rows = collocations.collocations(table, **settings).collect()
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def test_collocations_equal_a_plain_count(spark):
    rng = random.Random(8)
    words = ["a", "b", "New", "york", "É", "ß", "x\x00y", "　", "don't", "b"]
    joins = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "\x0b"]
    texts = ["".join(w + rng.choice(joins) for w in rng.choices(words, k=rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " . ", "new york city " * 30, "new york city " * 30, "y" * 30_000]
    langs = [rng.choice(["en", "de", None, ""]) for _ in texts]
    for least, top in ((2, 2000), (5, 7)):
        want = plain_collocations(texts, langs, least, top)
        assert len(want) > 20 and found_collocations(docs(spark, texts, langs), least=least, top=top) == want


def test_phrases_point_to_their_first_row(spark):
    table = docs(spark, ["no", "red apple", "a red apple", None], ["en", "en", "en", None]).coalesce(1)
    rows = {(r.lang, r.phrase): r for r in collocations.frequent_phrases(table, least=2).collect()}
    assert (rows["en", "red apple"].f, rows["en", "red apple"].first_doc) == (2, 1)
    assert rows["en", ""].f == 6 and rows["und", ""].f == 0 and not any(r.collided for r in rows.values())


def test_collocation_edges(spark):
    assert found_collocations(docs(spark, []).limit(0)) == []
    assert found_collocations(docs(spark, [None, ""], [None, None])) == []


def lot(*texts):
    """(language, text) as a stored lot is read back."""
    numbers = collocations._Numbers()
    read = [numbers.read(text) for _, text in texts]
    names = sorted({name for name, _ in texts})
    own = np.array([names.index(name) for name, _ in texts], np.int32)
    lengths = np.array([len(r) for r in read], np.int64)
    words = zlib.compress(b" ".join([*numbers][2:]))
    return collocations._Lot(names, own.tobytes(), lengths.tobytes(), zlib.compress(np.concatenate(read).tobytes()), words, list(range(len(texts))))


def test_phrases_with_one_fingerprint_are_told_apart():
    one = lot(("en", b"a b a b c a b"), ("de", b"a b. b a"))
    places = one.places(2)
    found = collocations._by_words(one, 2, places, np.zeros(len(places), np.uint64))
    rounds = [(at, count) for ats, counts in found for at, count in zip(ats, counts)]
    texts = {(one.names[one.language[at]], *(one.words[w] for w in one.numbers[at : at + 2])): count for at, count in rounds}
    assert texts == {("en", b"a", b"b"): 3, ("en", b"b", b"a"): 1, ("en", b"b", b"c"): 1, ("en", b"c", b"a"): 1, ("de", b"a", b"b"): 1, ("de", b"b", b"a"): 1}
    assert sum(texts.values()) == len(places)


def test_fingerprints_of_texts_equal_those_of_places(spark):
    one = lot(("en", b"red apple pie. red"), ("de", b"red apple"))
    frame = spark.createDataFrame([("en", bytearray(b"red apple")), ("en", bytearray(b"red apple pie")), ("de", bytearray(b"red apple")), ("en", bytearray(b"red"))], "lang string, phrase binary")
    prints = {(r.lang, bytes(r.phrase)): r.print for r in collocations._with_prints(frame).collect()}
    for n in (1, 2, 3):
        for at, value in zip(one.places(n), one.fingerprints(one.places(n), n)):
            key = one.names[one.language[at]], b" ".join(one.words[w] for w in one.numbers[at : at + n])
            assert prints.get(key, int(value)) == int(value)
    assert len(set(prints.values())) == 4 and max(prints.values()) < 2**48


def test_fingerprints_do_not_depend_on_the_lot():
    alone, after = lot(("en", b"one two three")), lot(("de", b"other words, one two"), ("en", b"x one two three"))
    for n in (1, 2, 3):
        a, b = (set(x.fingerprints(x.places(n), n).tolist()) for x in (alone, after))
        assert a <= b


def test_long_text_is_read_in_sections(monkeypatch):
    text = b" ".join(b"w%d" % (k % 50) for k in range(5000)) + b". end"
    whole = collocations._Numbers().read(text)
    monkeypatch.setattr(collocations, "LOT_BYTES", 100)
    assert (collocations._Numbers().read(text) == whole).all()
