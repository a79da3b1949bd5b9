"""The operators on hand-made edge cases and against plain versions."""

import collections
import gc
import hashlib
import io
import itertools
import random
import re
import sys
import weakref
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindlewise.llm import (
    byte_bpe,
    chat_format,
    exact_dedup,
    jaccard_join,
    line_templates,
    packing,
    quality_model,
    quality_rules,
    toxicity,
    warc_zip,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
ODD = [None, "", " \n\t ", "a", "Same text here", "same TEXT here", "same TEXT here", "é É ß \U0001f600", "x " * 3000, "y" * 20_000]


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, [*ODD, "no id"], [*range(len(ODD)), None])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")


def test_odd_and_empty_tables_give_a_row_for_each_row(spark, odd, labels):
    words = byte_bpe.vocabulary({bytes([k]): k for k in range(256)})
    operators = [
        lambda d: quality_rules.ledger(quality_rules.measured(d)),
        lambda d: toxicity.toxicity(d, labels),
        jaccard_join.joined,
        lambda d: byte_bpe.encoded(d, words, r"\S+|\s+"),
        packing.packed,
        exact_dedup.deduplicated,
        line_templates.without_recurring_lines,
        lambda d: quality_model.quality(d, labels),
    ]
    for operator in operators:
        assert operator(odd).count() == odd.count()
        assert operator(odd.limit(0)).count() == 0


def test_rules_and_ablation(spark):
    assert quality_rules.measure(None) == (0,) * 6
    assert quality_rules.measure("a b c\na b c\n#x") == (7, 8, 1, 3, 1, 6)
    bits = spark.createDataFrame([(1,), (3,), (2,), (2,), (0,), (4,)], "failed_bits long")
    got = {r.rule: (r.failing, r.only_this) for r in quality_rules.ablation(bits, "base").collect()}
    assert got == {"few_words": (2, 1), "repeated_words": (3, 2)}


def test_chat_reads_back_what_went_in(spark):
    hard = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>", "\\<|next|>\\", "<|>", "", None, "a\\", "<", "|>"]
    random.seed(1)
    rows = [(c, t, random.choice(["user", "assistant", "<|x|>", None]), random.choice(hard)) for c in (1, 2, None) for t in range(9)]
    turns = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")
    for row in chat_format.read_back(chat_format.formatted(turns)).collect():
        want = sorted(((t, r or "", x or "") for c, t, r, x in [*rows, rows[0]] if c == row.conv_id))
        assert [(t.role, t.text) for t in row.turns] == [(r, x) for _, r, x in want]
        assert "".join(s.piece for s in row.segments) == row.formatted
        blocks = sum(1 for k, w in enumerate(want) if not k or want[k - 1][1] != w[1])
        assert row.formatted.count("<|turn|>") == row.formatted.count("<|end|>\n") == blocks
    assert chat_format.formatted(turns.limit(0)).count() == 0


def test_chain_marginals_equal_enumeration():
    chain = toxicity.Chain({}, 0.0, 0.3, (0.5, -0.7, -0.2, 0.9), ())
    for emissions in ([0.4], [1.0, -2.0, 0.5, 3.0]):
        total, on = 0.0, np.zeros(len(emissions))
        for states in itertools.product((0, 1), repeat=len(emissions)):
            value = 0.3 * states[0] + sum(e * s for e, s in zip(emissions, states))
            value = np.exp(value + sum(chain.moves[2 * a + b] for a, b in zip(states, states[1:])))
            total += value
            on += value * np.array(states)
        (got,) = toxicity.marginals([np.array(emissions)], chain)
        assert np.allclose(got, on / total)


def test_models_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    documents, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(documents, known).join(known, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.toxic).mean() > 0.95 and scored.score.between(0, 1).all()
    assert scored[scored.toxic == 1].predicted.mean() > 0.8
    scored = quality_model.quality(documents, known).join(known, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.97 and scored.score.between(0, 1).all()


def test_isotonic_is_the_least_squares_fit():
    got = quality_model.isotonic(np.arange(5), np.array([1, 0, 2, 1, 3]), np.array([2, 2, 2, 2, 3]))
    assert np.allclose(got, [0.25, 0.25, 0.75, 0.75, 1.0])


def _components(texts):
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    at = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((at[a], at[b]))
            at = [low if x == high else x for x in at]
    return [(len(s), c) for s, c in zip(sets, at)]


@pytest.mark.parametrize("short,hot", [(16, 512), (2, 512), (2, 4)])
def test_join_equals_brute_force(spark, monkeypatch, short, hot):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    random.seed(5)
    word = lambda: f"w{random.randrange(400)}"
    texts = list(ODD)
    for _ in range(3):
        base = [word() for _ in range(80)]
        for _ in range(14):
            copy = [word() if random.random() < 0.02 else w for w in base]
            texts.append(" ".join(copy))
    passage = [word() for _ in range(12)]
    texts += [" ".join([word() for _ in range(20)] + passage) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts)
    kept = {r.doc_id for r in jaccard_join.one_of_each(docs(spark, texts)).collect()}
    assert kept == {k for k, (_, c) in enumerate(_components(texts)) if c == k}


def test_bpe_equals_the_public_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    words = byte_bpe.vocabulary(ranks)
    assert all(words.rank(token) == rank for token, rank in ranks.items()) and words.rank(b"no such token") is None
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in ODD] + [" \n  x y  z \x1c a  ", "'s 's's  's", "a" * 5000, "\0 a\0  b", "<|endoftext|>"]
    rows = byte_bpe.encoded(docs(spark, texts), words, P.PATTERN).withColumn("bytes", byte_bpe.decoder(words, spark)("ids"))
    for row in rows.collect():
        assert row.ids == other.encode_ordinary(texts[row.doc_id])
        assert bytes(row.bytes).decode() == texts[row.doc_id]
    small = byte_bpe.Encoder(words, P.PATTERN, most=3)
    assert all(small.encode(t).tolist() == other.encode_ordinary(t) for t in texts for _ in range(2))


def test_bpe_decodes_null_empty_and_strange_ids(spark):
    words = byte_bpe.vocabulary({b"a": 0, b"bcd": 1, "\u00e9".encode(): 3})
    decode = byte_bpe.decoder(words, spark)
    rows = spark.createDataFrame([(0, None), (1, []), (2, [1, 0, 3]), (3, None), (4, [0])], "k int, ids array<int>").coalesce(1)
    got = {r.k: r.text for r in rows.select("k", decode("ids").alias("text")).collect()}
    assert got == {0: None, 1: b"", 2: b"bcda\xc3\xa9", 3: None, 4: b"a"}
    assert [r.text for r in rows.filter("k < 2").orderBy("k").select(decode("ids").alias("text")).collect()] == [None, b""]
    for strange in (2, 4, -1):
        with pytest.raises(Exception, match="KeyError|IndexError|out of bounds"):
            spark.createDataFrame([([strange],)], "ids array<int>").select(decode("ids")).collect()


def test_bpe_remembers_a_bounded_number_of_bytes():
    words = byte_bpe.vocabulary({bytes([k]): k for k in range(256)})
    encoder = byte_bpe.Encoder(words, r"\w+|\W", most=3)
    for run in ("a", "b", "c", "d", "a", "b", "c", "a,b", "d"):
        assert encoder.encode(run).tolist() == list(run.encode())
        assert len(encoder) <= 3 and len(encoder.older) <= 3
    large = byte_bpe.Encoder(words, r"\w+|\W", most_bytes=20_000)
    for k in range(2_000):
        large.encode(f"{k:x}" * 9)
    assert all(sum(sys.getsizeof(x) for item in half.items() for x in item) <= 20_000 for half in (large, large.older))
    kept = weakref.ref(byte_bpe._encoder(words, r"\w+"))
    byte_bpe._encoder(byte_bpe.vocabulary({b"a": 0}), r"\w+")
    gc.collect()
    assert kept() is None  # what an earlier query remembered is gone


def test_boundaries_have_the_least_padding():
    random.seed(2)
    for _ in range(100):
        lengths = sorted(random.sample(range(60), random.randint(1, 8)))
        histogram = [(length, random.randint(1, 9)) for length in lengths]
        for buckets in range(1, 5):
            sets = (sorted({*c, lengths[-1]}) for r in range(buckets) for c in itertools.combinations(lengths, r))
            assert packing.padding(histogram, packing.boundaries(histogram, buckets)) == min(packing.padding(histogram, s) for s in sets)


def test_batches_are_full_and_within_budget(spark):
    rows = packing.packed(docs(spark, ["w " * (k % 90) for k in range(500)] + ["w " * 700]), buckets=4, budget=400, shard_rows=20).toPandas()
    assert len(rows) == 501 and (rows.n_tokens <= rows.bucket_tokens).all()
    for bucket, group in rows.groupby("bucket"):
        capacity = max(1, 400 // max(1, group.bucket_tokens.iloc[0]))
        assert sorted(zip(group.batch, group.slot)) == [divmod(k, capacity) for k in range(len(group))]


def test_copies(spark, odd):
    rows = {r.doc_id: r for r in exact_dedup.deduplicated(odd).collect()}
    assert (rows[4].keep_id, rows[4].group_size, rows[4].kept, rows[6].kept) == (6, 3, False, True)
    assert rows[0].keep_id == 1 and rows[0].text_sha256 == hashlib.sha256(b"").hexdigest()
    twice = odd.unionAll(odd)
    assert sum(r.kept for r in exact_dedup.deduplicated(twice).collect()) == sum(r.kept for r in rows.values())
    assert exact_dedup.without_copies(twice).count() == sum(r.kept for r in rows.values())
    assert exact_dedup.without_copies(odd).columns == odd.columns


def test_recurring_lines(spark):
    line = "On host {} the disk was found full and is now closed"
    texts = [f"{chr(97 + k) * 5} is an own line of this text\n{line.format(k)}\nend" for k in range(6)] + ["nothing here", None]
    rows = {r.doc_id: r for r in line_templates.without_recurring_lines(docs(spark, texts)).collect()}
    assert all(rows[k].text == texts[k].split("\n")[0] and rows[k].n_dropped == 2 for k in range(6))
    assert rows[6].text == texts[6] and rows[7].text is None and rows[7].n_lines == 0
    few = {r.doc_id: r for r in line_templates.without_recurring_lines(docs(spark, texts[:4] * 3)).collect()}
    assert all(r.n_dropped == 0 for r in few.values())


@pytest.mark.parametrize("values", [3, 12])
def test_fields_of_a_template_stay_masked_as_it_grows(spark, values):
    line = "This weekly note was written by {} for the readers in {}"
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(values)]
    rare = [line.format(f"{a}x", f"{b}y") for a in names for b in names]
    # two values that most lines have, and one line that has neither
    usual = [line.format("most", "places")] * 9 + [line.format(f"{a}z", "places") for a in names[:3]] + [line.format("most", f"{b}w") for b in names[:3]]
    texts = [f"{x}\nown {k:b}".replace("0", "o").replace("1", "i") for k, x in enumerate([*rare, *usual, line.format("odd", "ends")])]
    got = line_templates.without_recurring_lines(docs(spark, texts)).collect()
    assert all(r.n_dropped == 1 and r.text == texts[r.doc_id].split("\n")[1] for r in got)
    shown = {r.template for r in line_templates.templates(docs(spark, texts)).collect()}
    assert line.format("<*>", "<*>") in shown


def test_short_lines_recur_and_fields_may_follow_three_words(spark):
    names = ["ada", "bo", "cy", "dee", "eve", "flo"]
    short = ["Released under the MIT License.", "All rights reserved", "Read more", "Page 7 of 9", "Updated on 2024"]
    texts = ["\n".join([*short, f"From the host {x} came this short note", f"It was {x}", f"own {x}"]) for x in names]
    for row in line_templates.without_recurring_lines(docs(spark, texts)).collect():
        x = names[row.doc_id]
        assert row.text == f"It was {x}\nown {x}" and row.n_dropped == 6


def plain_recurring(texts, least=5):
    """Places (text, line) of recurring lines, counted the plain way."""
    lines = {}
    for text in set(t or "" for t in texts):
        for at, line in enumerate(text.split("\n")):
            words = ["<*>" if any(c in "0123456789" for c in w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if words:
                lines[text, at] = words
    lead = line_templates.LEADING
    leaf = lambda w: (len(w), *w[:lead])
    holders = collections.defaultdict(set)
    for (text, _), words in lines.items():
        for place, word in enumerate(words[lead:], lead):
            holders[leaf(words), place, word].add(text)
    masks, texts_of = collections.defaultdict(set), collections.defaultdict(set)
    for (text, at), words in lines.items():
        led = sum(w != "<*>" for w in words[:lead])
        own = {(p, w): len(holders[leaf(words), p, w]) for p, w in enumerate(words[lead:], lead) if w != "<*>"}
        levels = {n for n in own.values() if n >= least} if own else {0}
        for level in levels:
            mask = frozenset(k for k, n in own.items() if n >= level)
            if 2 * (led + len(mask)) >= len(words):
                masks[text, at].add((leaf(words), mask))
                texts_of[leaf(words), mask].add(text)
    return {place for place, own in masks.items() if any(len(texts_of[m]) >= least for m in own)}


def test_recurring_lines_equal_a_plain_count(spark):
    random.seed(11)
    words = ["Posted", "by", "the", "note", "in", "42", "a1", "town", "É"]
    texts = ["\n".join(" ".join(random.choices(words, k=random.randint(0, 5))) for _ in range(random.randint(0, 6))) for _ in range(150)]
    texts += [texts[3], texts[3], None, "", "\n\n", "x\ty\r\n x y", "w " * 4000, *(f"one {k}\n\tPage {k} of 9" for k in range(7))]
    want = plain_recurring(texts)
    assert len(want) > 50
    for row in line_templates.without_recurring_lines(docs(spark, texts)).collect():
        lines = (texts[row.doc_id] or "").split("\n")
        kept = [line for at, line in enumerate(lines) if ((texts[row.doc_id] or ""), at) not in want]
        assert (row.text or "") == "\n".join(kept) and row.n_dropped == len(lines) - len(kept)


@pytest.mark.parametrize("line", ["Posted by {} in the weekly forum of our town", "Advertisement"])
def test_lines_with_an_early_field_and_of_one_word_recur(spark, line):
    names = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(40)]
    texts = [f"{line.format(x)}\n{x} {x} alone" for x in names]
    assert all(r.n_dropped == 1 for r in line_templates.without_recurring_lines(docs(spark, texts)).collect())


SCRIPTS = {
    "chinese": range(0x4E00, 0x9FA5), "cyrillic": range(0x430, 0x450), "hindi": range(0x915, 0x93A), "thai": range(0xE01, 0xE2F), "hebrew": range(0x5D0, 0x5EB),
    "kana": range(0x3041, 0x3097), "digits": range(0x30, 0x3A), "latin": range(0x61, 0x7B), "emoji": range(0x1F600, 0x1F640),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_chunks_follow_the_content_in_any_script(spark, script):
    random.seed(6)
    text = "".join(chr(c) for c in random.choices(SCRIPTS[script], k=60_000))
    first, moved = (set(r.hashes) for r in exact_dedup.described(docs(spark, [text, "x" + text])).select(F.col("recipe.hash").alias("hashes")).collect())
    assert len(first & moved) >= len(first) - 3 and len(first) > 50


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide):
    data = _Bytes()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as archive:
        for name in ("a", "b/ü"):
            with archive.open(name, "w", force_zip64=wide) as member:
                member.write(name.encode() * 100)
        archive.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        archive.comment = b"PK\5\6 is no end"
    found = warc_zip.members(data)
    assert {n: data.getvalue()[at : at + size] for n, (at, size) in found.items()} == {n: n.encode() * 100 for n in ("a", "b/ü")}
    with pytest.raises(ValueError):
        warc_zip.members(_Bytes(b"no archive" * 10))


def test_more_members_than_a_short_directory_counts():
    data = _Bytes()
    with zipfile.ZipFile(data, "w") as archive:
        for k in range(70_000):
            archive.writestr(str(k), b"")
    assert len(warc_zip.members(data)) == 70_000


def test_archives(spark):
    html = ["x" * 200, "x" * 200, "x" * 200, "short", "short", None, "", "ü" * 60 + "\r\n\r\n", "z" * 150]
    pages = spark.createDataFrame([(k, None if k % 2 else "http://a b/\r\nX: 1", h, 1) for k, h in enumerate(html)] + [(None, None, "x" * 200, 1)], "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in warc_zip.archived(pages).collect()}
    assert len(got) == 10 and {k for k, r in got.items() if r.record_type == "revisit"} == {1, 2} and got[1].refers_to == 0
    for k, h in enumerate(html):
        payload = (h or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert got[k].payload is None if got[k].record_type == "revisit" else bytes(got[k].payload) == payload
    assert warc_zip.archived(pages.limit(0)).count() == 0
