"""License notices: an exact set-similarity join of text blocks with notice templates.

A block is a window of words, twice as wide as the longest template of its class and moved by half its width, so that any
notice written in one piece lies whole inside some block. A block meets a template when it holds at least ``THRESHOLD``
percent of the template's different words. Words are ordered by how often they occur in all texts, rarest first; a pair that
meets the threshold then shares a word of both prefixes, so that blocks without a prefix word of any template are never made,
and the others meet their templates through an equi-join on prefix words. A length and a positional bound come before the
sets are compared. All of this only saves work: the pairs found are exactly those over the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import arrow_rows, broadcast_if_small, stored

#: Percent of a template's different words that a block must hold.
THRESHOLD = 80

#: Step of the shortest blocks; longer templates have a step of the next power of two.
LEAST_STEP = 8


class Template(NamedTuple):
    label: str
    text: str


# Phrases that by themselves name a license, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening passages of public licenses and the notices they ask for.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("mit", "Released under the MIT License"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    Template("apache", "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "You should have received a copy of the GNU Affero General Public License along with this program"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("all-rights-reserved", "All rights reserved"),
)

#: What is a word: runs of digits, ASCII letters (lower-cased) and everything beyond ASCII, read on UTF-8 bytes.
_IN_WORD = bytes(b if chr(b).isdigit() or chr(b).islower() or b >= 0x80 else b + 32 if chr(b).isupper() else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_IN_WORD).split()


class _Posting(NamedTuple):
    """A template behind one of its prefix words; words are ranks in the global order."""

    step: int
    token: int
    place: int
    template: int
    label: str
    need: int
    tokens: list[int]


def _needed(size: int, threshold: int) -> int:
    return -(-threshold * size // 100)


def _step(length: int) -> int:
    return max(LEAST_STEP, 1 << (length - 1).bit_length())


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def frequencies(docs: DataFrame, words: frozenset[bytes], text_column: str = "text") -> dict[bytes, int]:
    """How often each of ``words`` occurs in all texts. The result has a row for each word at most."""

    def step():
        def batch(rows):
            counts = Counter()
            for text in _texts(rows, 0):
                counts.update(filter(words.__contains__, words_of(text)))
            return [[w for w in counts], [*counts.values()]]

        return batch

    counted = arrow_rows(docs.select(F.col(text_column).cast("string")), step, "word binary, n long", text=0)
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {bytes(row.word): row.n for row in found}


def _phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Starts of all phrases, and their labels."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in phrases.items():
        at = line.find(phrase)
        while at >= 0:
            places.append(line.count(b" ", 0, at))
            labels.add(label)
            at = line.find(phrase, at + 1)
    return places, labels


def _postings(templates: Sequence[Template], ranks: dict[bytes, int], threshold: int) -> list[_Posting]:
    postings = []
    for number, template in enumerate(templates):
        words = words_of(template.text.encode())
        if not words:
            continue
        tokens = sorted({ranks[w] for w in words})
        need = max(1, _needed(len(tokens), threshold))
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            postings.append(_Posting(_step(len(words)), token, place, number, template.label, need, tokens))
    return postings


def scanned(docs: DataFrame, templates: Sequence[Template], postings: list[_Posting], ranks: dict[bytes, int], id_column="doc_id", text_column="text") -> DataFrame:
    """One row per row of ``docs``: phrase measures, and the blocks that hold a prefix word, as ascending ranks."""
    classes = {}
    for posting in postings:
        prefix, known, needs = classes.setdefault(posting.step, (set(), set(), []))
        prefix.add(posting.token)
        known.update(posting.tokens)
        needs.append(posting.need)
    phrases = {b" " + phrase.encode() + b" ": label for phrase, label in PHRASES.items()}

    def blocks_of(ids: np.ndarray, marks: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> list[dict]:
        found = []
        for step, (in_prefix, in_class, least) in marks.items():
            hits = np.flatnonzero(in_prefix[ids]) // step
            for block in np.unique(np.concatenate([hits, hits - 1])) if len(hits) else ():
                if block < 0:
                    continue
                window = ids[block * step : (block + 2) * step]
                tokens = np.unique(window[in_class[window]])
                if len(tokens) >= least:
                    found.append({"step": step, "start": int(block * step), "tokens": tokens.tolist()})
        return found

    def make():
        marks = {}
        for step, (prefix, known, needs) in classes.items():
            in_prefix, in_class = np.zeros(len(ranks) + 1, bool), np.zeros(len(ranks) + 1, bool)  # the last place: unknown words
            in_prefix[list(prefix)] = in_class[list(known)] = True
            marks[step] = (in_prefix, in_class, min(needs))

        def batch(rows):
            made = []
            for text in _texts(rows, 1):
                words = words_of(text)
                places, labels = _phrase_places(words, phrases)
                ids = np.fromiter(map(ranks.get, words, repeat(-1)), np.int64, len(words))
                made.append((len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), blocks_of(ids, marks)))
            return [rows.column(0), *(list(x) for x in (zip(*made) if made else [()] * 6))]

        return batch

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
        "blocks array<struct<step: int, start: long, tokens: array<int>>>"
    )
    return arrow_rows(source, make, schema, text=1)


def met(rows: DataFrame, postings: list[_Posting]) -> DataFrame:
    """Pairs over the threshold: ``row``, the block's ``start`` and ``step``, ``template``, ``label``, ``overlap``, ``size``.

    A pair may share several prefix words; it is taken at the smallest word it shares, where both bounds hold.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(postings, "step int, token int, place int, template int, label string, need int, wanted array<int>")
    least = table.groupBy("step").agg(F.min("need").alias("least"))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*").join(broadcast_if_small(least), "step")
    size = F.size("tokens")
    prefixed = blocks.select("row", "step", "start", "tokens", F.posexplode(F.slice("tokens", F.lit(1), size - F.col("least") + 1)).alias("at", "token"))
    left_of_both = 1 + F.least(F.size("wanted") - F.col("place") - 1, size - F.col("at") - 1)
    shared = F.array_intersect("tokens", "wanted")
    return (
        prefixed.join(broadcast_if_small(table), ["step", "token"])
        .filter((size >= F.col("need")) & (left_of_both >= F.col("need")))
        .withColumn("shared", shared)
        .filter((F.size("shared") >= F.col("need")) & (F.array_min("shared") == F.col("token")))
        .select("row", "start", "step", "template", "label", F.size("shared").alias("overlap"), F.size("wanted").alias("size"))
    )


def licensed(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: int = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: phrase measures, ``base_labels``, ``labels`` (of phrases and of templates met),
    ``notices`` (label, first word and width of every block met, with its share of the template) and ``score``.

    The score is the largest share of a template that a block holds, 1 where a phrase stands, and 0 for a text with neither.
    Null and empty texts have no words and no labels. Repeated rows and rows without an id are scanned each; an empty table
    gives none. Only the two named columns are read. A template without words is never met. ``templates`` is a list the
    caller holds, so its postings are small; they are broadcast only where they have been counted.
    """
    ranks, postings = ordered(docs, templates, threshold, text_column)
    rows = stored(scanned(docs, templates, postings, ranks, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    share = F.col("overlap") / F.col("size")
    notice = F.struct("label", F.col("start").alias("first_word"), (2 * F.col("step")).alias("n_words"), share.alias("share"))
    found = met(rows, postings).groupBy("row").agg(
        F.array_sort(F.collect_set(notice)).alias("notices"), F.max(share).alias("share")
    )
    labels = F.array_union("base_labels", F.coalesce(F.transform("notices", lambda n: n["label"]), F.array().cast("array<string>")))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_sort(labels).alias("labels"),
        "notices",
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def ordered(docs: DataFrame, templates: Sequence[Template], threshold: int = THRESHOLD, text_column: str = "text") -> tuple[dict[bytes, int], list[_Posting]]:
    """Ranks of the templates' words in the global order (rarest first, ties by bytes), and the prefix postings."""
    counts = frequencies(docs, frozenset(w for t in templates for w in words_of(t.text.encode())), text_column)
    ranks = {word: rank for rank, word in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    return ranks, _postings(templates, ranks, threshold)
