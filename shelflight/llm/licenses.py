"""Operator 5: license texts in documents, by winnowed fingerprints and alignment.

The templates' word trigrams are hashed, winnowed (of every WINDOW neighbouring
hashes the smallest stays) and put in an inverted index. A document's trigrams are
winnowed the same way; a shared run of GRAM + WINDOW - 1 words always shares a
fingerprint. Fingerprints that meet on about the same diagonal make a candidate, and
a banded alignment of the template with the document around that diagonal tells how
much of the template is there, and where.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelflight.llm.common import column, id_and_text, known_runs, map_arrow, word_numbers, words

GRAM = 3
WINDOW = 3
# Half the width of the alignment band, in words.
BAND = 8
# Share of a template's words that must be found in order.
LEAST_COVERAGE = 0.8
# Templates of fewer words must be there word for word: one other word is another license.
SHORT = 20
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 16 << 20

# Notices and license texts as their publishers word them (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
        "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

FOUND = T.StructType([
    T.StructField("license_id", T.StringType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    ]))),
])


def templates(spark: SparkSession) -> DataFrame:
    """``license_id, text`` of the templates above."""
    return spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string")


def fingerprints(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) that winnowing keeps of a sequence of word numbers.

    A hash is kept if it is the smallest of some WINDOW neighbours, or of the whole
    sequence if that is shorter; equal ones are all kept. Trigrams with an unknown
    word count as the largest hash and are never kept.
    """
    n = len(run) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(GRAM):
        part = run[i:i + n].astype(np.uint64)
        hashes = (hashes ^ part) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        known &= part > 0
    largest = np.uint64(0xFFFFFFFFFFFFFFFF)
    hashes[~known] = largest
    padded = np.concatenate([np.full(WINDOW - 1, largest), hashes, np.full(WINDOW - 1, largest)])
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    smallest = views.min(axis=1)  # of the windows that end at each place and after
    # the windows over the edges count: they are the whole of a short sequence
    keep = np.zeros(n, bool)
    for i in range(WINDOW):
        keep |= hashes == smallest[i:i + n]
    place = np.flatnonzero(keep & known)
    return place, hashes[place]


class Templates:
    """Templates as word numbers, and the inverted index of their fingerprints."""

    def __init__(self):
        self.names: list[str] = []
        self.texts: list[list[int]] = []
        self.vocabulary: dict[bytes, int] = {}
        self.index: dict[int, list[tuple[int, int]]] = {}

    def add(self, name: str, text: bytes) -> None:
        found = words(text)
        if not found:
            return
        number = self.vocabulary
        ids = [number.setdefault(w, len(number) + 1) for w in found]
        for place, value in zip(*(x.tolist() for x in fingerprints(np.array(ids)))):
            self.index.setdefault(value, []).append((len(self.texts), place))
        self.names.append(name)
        self.texts.append(ids)

    def hashes(self) -> np.ndarray:
        return np.sort(np.array(list(self.index), np.uint64))


def align(template: list[int], document: list[int], low: int, high: int) -> tuple[list[int], int, int]:
    """Best local alignment of a template with a document, where document place minus
    template place stays within ``low`` to ``high``. Returns the document places that
    match a template word, and the first place and the end of the alignment."""
    pairs, stop = align_pairs(template, document, low, high)
    return [j for _, j in pairs], pairs[0][1] if pairs else 0, stop


def align_pairs(template: list[int], document: list[int], low: int, high: int) -> tuple[list[tuple[int, int]], int]:
    """``align`` as (template place, document place) of equal words, and its end."""
    width = high - low + 1
    before = [0] * (width + 1)
    moves: list[list[int]] = []
    best, at = 0, None
    for i, word in enumerate(template):
        row, move, left = [0] * (width + 1), [0] * width, 0
        for d in range(width):
            j = i + low + d
            score, how = 0, 0
            if 0 <= j < len(document):
                diagonal = before[d] + (MATCH if document[j] == word else MISMATCH)
                if diagonal > score:
                    score, how = diagonal, 1
                if before[d + 1] + GAP > score:  # the template's word is left out
                    score, how = before[d + 1] + GAP, 2
                if d and left + GAP > score:  # the document's word is extra
                    score, how = left + GAP, 3
                if score > best:
                    best, at = score, (i, d)
            row[d], move[d], left = score, how, score
        before = row
        moves.append(move)
    matched, stop, j = [], 0, 0
    if at:
        i, d = at
        stop = i + low + d + 1
        while i >= 0 and 0 <= d < width and moves[i][d]:
            j = i + low + d
            how = moves[i][d]
            if how == 1:
                if document[j] == template[i]:
                    matched.append((i, j))
                i -= 1
            elif how == 2:
                i, d = i - 1, d + 1
            else:
                d -= 1
    matched.reverse()
    return matched, stop


def _chains(pieces: list[list[tuple[int, int]]], reach: int) -> list[list[tuple[int, int]]]:
    """For each piece (pairs of template and document places) the chain of pieces with
    the most pairs that ends with it: both places rise, and a piece starts within
    ``reach`` words after the one before. Pieces come in the order of their starts, so a
    chain that ends too far before one of them is done with."""
    chains, near = [], []
    for piece in sorted(pieces, key=lambda p: p[0][1]):
        near = [chain for chain in near if piece[0][1] - chain[-1][1] <= reach]
        best = piece
        for chain in near:
            i, j = chain[-1]
            after = [p for p in piece if p[0] > i and p[1] > j]
            if after and len(chain) + len(after) > len(best):
                best = chain + after
        chains.append(best)
        near.append(best)
    return chains


def scan(text: bytes, blocks: list[tuple[Templates, np.ndarray]], least: float = LEAST_COVERAGE) -> list[tuple]:
    """(license, coverage, first word, end, spans) of each place where a template's
    coverage reaches ``least``, or where a template of fewer than SHORT words is word for
    word, in the document's order. Of places of one template
    that overlap the best stays."""
    out = []
    for known, hashes in blocks:
        numbers = word_numbers(text, known.vocabulary)
        run, where = known_runs(numbers, GRAM)
        place, value = fingerprints(run)
        if not len(hashes):
            continue
        at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == value)
        seeds: dict[int, set[int]] = {}
        for p, v in zip(where[place[hit]].tolist(), value[hit].tolist()):
            for template, q in known.index[v]:
                seeds.setdefault(template, set()).add(p - q)
        for template, diagonals in seeds.items():
            words_, found, pieces = known.texts[template], [], []
            short = len(words_) < SHORT
            for low, high in _bands(sorted(diagonals)):
                first = max(0, low)
                part = numbers[first:max(0, high) + len(words_)].tolist()
                # copies that follow each other closely share a band: take the best
                # alignment, blank it and look again
                while True:
                    pairs, stop = align_pairs(words_, part, low - first, high - first)
                    if len(pairs) < min(GRAM, len(words_)):
                        break
                    start, coverage = pairs[0][1], len(pairs) / len(words_)
                    placed = [(i, j + first) for i, j in pairs]
                    if short:
                        if coverage == 1 and stop - start == len(words_):
                            found.append((-coverage, start + first, stop + first, [j for _, j in placed]))
                    elif coverage >= least:
                        found.append((-coverage, start + first, stop + first, [j for _, j in placed]))
                    else:
                        pieces.append(placed)
                    part[start:stop] = [0] * (stop - start)
            # words put in or left out move the rest to another band
            for chain in _chains(pieces, len(words_)):
                coverage = len(chain) / len(words_)
                if coverage >= least:
                    found.append((-coverage, chain[0][1], chain[-1][1] + 1, [j for _, j in chain]))
            taken: list[tuple[int, int]] = []  # in order, none overlapping
            for cost, start, stop, matched in sorted(found):
                i = bisect_left(taken, (start, stop))
                free = i == len(taken) or stop <= taken[i][0]
                if free and (not i or taken[i - 1][1] <= start):
                    taken.insert(i, (start, stop))
                    out.append((known.names[template], -cost, start, stop, _spans(matched)))
    out.sort(key=lambda m: (m[2], m[3], m[0] or ""))
    return out


def _bands(diagonals: list[int]) -> list[tuple[int, int]]:
    """Diagonals closer than BAND share a band, which reaches BAND beyond them; a band
    spans 4 BAND at most, and the next one starts anew around its first diagonal."""
    bands, first, last = [], diagonals[0], diagonals[0]
    for d in diagonals[1:]:
        if d - last > BAND or d - first > 2 * BAND:
            bands.append((first - BAND, last + BAND))
            first = d
        last = d
    return [*bands, (first - BAND, last + BAND)]


def _spans(places: list[int]) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for p in places:
        if spans and spans[-1][1] == p:
            spans[-1][1] = p + 1
        else:
            spans.append([p, p + 1])
    return [tuple(s) for s in spans]


def _sent(catalogue: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list:
    """Broadcast blocks of templates; the driver holds one block at a time."""
    context, blocks, current, size = catalogue.sparkSession.sparkContext, [], Templates(), 0
    rows = catalogue.select(
        column(id_col).cast("string").alias("name"),
        F.coalesce(column(text_col), F.lit("")).cast("binary").alias("text"),
    )
    for row in rows.toLocalIterator():
        if size and size + len(row["text"]) > block_bytes:
            blocks.append(context.broadcast(current))
            current, size = Templates(), 0
        current.add(row["name"], bytes(row["text"]))
        size += len(row["text"])
    return [*blocks, context.broadcast(current)]


def license_matches(
    docs: DataFrame, catalogue: DataFrame, least_coverage: float = LEAST_COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", license_col: str = "license_id",
    license_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, license_id, coverage, start, stop, spans``: a row for each place in a
    document where ``least_coverage`` or more of a template's words align; a template of
    fewer than SHORT words must be there word for word. Parts of a template that follow
    each other in its order, within as many words as it has, are one place.

    Places are word numbers from 0; ``spans`` are the runs of matching words in
    ``start`` to ``stop``. A template that shares no run of GRAM + WINDOW - 1 words
    with the place may be missed. Null and blank texts match nothing, templates
    without words are left out, templates that repeat a name or a text match each.
    Repeated documents and null ids stay. Empty tables give no rows.
    """
    sent = _sent(catalogue, license_col, license_text_col, block_bytes)
    given = id_and_text(docs, id_col, text_col)
    schema = T.StructType([given.schema["doc_id"], T.StructField("found", T.ArrayType(FOUND))])

    def start():
        blocks = [(b.value, b.value.hashes()) for b in sent]

        def step(batch):
            names = FOUND.names
            rows = [
                [
                    dict(zip(names, (n, c, a, b, [{"start": x, "stop": y} for x, y in s])))
                    for n, c, a, b, s in scan(t.as_py(), blocks, least_coverage)
                ]
                for t in batch.column("text")
            ]
            return [batch.column("doc_id"), rows]

        return step

    found = map_arrow(given, schema, start)
    return found.select("doc_id", F.inline("found"))
