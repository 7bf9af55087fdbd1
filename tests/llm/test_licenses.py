"""License scans against alignment of every template at every place."""

import random

import numpy as np
import pytest

from shelflight.llm import licenses as lic
from tests.llm.helpers import docs_of

TEMPLATES = "license_id string, text string"


def prepared(texts):
    known = lic.Templates()
    for name, text in texts.items():
        known.add(name, text.encode())
    return [(known, known.hashes())]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def noisy(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        i = draw.randrange(1, len(words) - 1)
        kind = draw.randrange(3)
        if kind == 0:
            words[i] = "zzz"
        elif kind == 1:
            words.insert(i, "yyy")
        else:
            del words[i]
    return words


def test_planted_templates_with_edits():
    draw = random.Random(2)
    blocks = prepared(lic.TEMPLATES)
    for name, text in lic.TEMPLATES.items():
        words = [w.decode() for w in lic.words(text.encode())]
        for _ in range(6):
            edits = draw.randrange(0, max(1, len(words) // 12) + 1)
            copy = noisy(draw, words, edits)
            before = [f"q{draw.randrange(50)}" for _ in range(draw.randrange(60))]
            doc = " ".join([*before, *copy, "tail", "words"])
            expected = longest_common(words, copy) / len(words)
            found = {m[0]: m for m in lic.scan(doc.encode(), blocks)}
            runs = max(sum(1 for _ in g) for g in [copy])  # noqa: F841
            if expected >= 0.9 and len(words) >= 20:
                assert name in found, (name, copy)
            if name in found:
                _, coverage, start, stop, spans = found[name]
                assert coverage <= expected + 1e-9 and coverage >= lic.LEAST_COVERAGE
                assert len(before) <= start < stop <= len(before) + len(copy)
                assert sum(b - a for a, b in spans) == round(coverage * len(words))


def test_every_notice_line_of_the_given_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r.doc_id, r.license_id) for r in lic.license_matches(docs, lic.templates(spark)).collect()}
    lines = {k: v for k, v in lic.TEMPLATES.items() if k.endswith("-notice")}
    expected = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if v in r.text}
    assert expected and {f for f in found if f[1] in lines} == expected


def test_alignment_equals_common_words_when_the_band_is_wide():
    draw = random.Random(8)
    for _ in range(100):
        template = [draw.randrange(1, 50) for _ in range(25)]
        document = noisy(draw, template, draw.randrange(4))
        document = [0 if isinstance(w, str) else w for w in document]
        matched, start, stop = lic.align(template, document, -30, 30)
        assert matched == sorted(set(matched)) and all(start <= m < stop for m in matched)
        assert len(matched) <= longest_common(template, document)
        assert len(matched) >= longest_common(template, document) - 4


@pytest.mark.parametrize("n", [0, 2, 3, 4, 5, 9])
def test_winnowing_keeps_a_fingerprint_of_every_window(n):
    draw = np.random.default_rng(n)
    run = draw.integers(1, 9, n)
    place, value = lic.fingerprints(run)
    grams = max(0, n - lic.GRAM + 1)
    for at in range(max(0, grams - lic.WINDOW + 1)):
        assert any(at <= p < at + lic.WINDOW for p in place.tolist())
    if 0 < grams < lic.WINDOW:
        assert len(place)
    inner, hashes = lic.fingerprints(np.concatenate([[0, 0], run, [0]]))
    assert dict(zip((inner - 2).tolist(), hashes.tolist())) == dict(zip(place.tolist(), value.tolist()))


def test_edge_cases(spark):
    catalogue = [("A", "one two three four five six"), ("B", None), ("C", " ,"), ("A", "one two three four five six"),
                 (None, "red green blue pink grey")]
    text = "One, two three four five six"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, f"x {text} y {text}"), (4, "one two three"),
            (5, "z " * 50_000 + text), (6, "red green blue pink grey")]
    docs = docs_of(spark, rows).selectExpr("*", "1 as found", "2 as license_id")
    found = lic.license_matches(docs, spark.createDataFrame(catalogue, TEMPLATES)).collect()
    got = sorted(((r.doc_id, r.license_id, r.start, r.stop) for r in found), key=repr)
    expected = [(1, "A", 0, 6)] * 4 + [(None, "A", 1, 7)] * 2 + [(None, "A", 8, 14)] * 2
    expected += [(5, "A", 50_000, 50_006)] * 2 + [(6, None, 0, 5)]
    assert got == sorted(expected, key=repr)
    split = lic.license_matches(docs, spark.createDataFrame(catalogue, TEMPLATES), block_bytes=1).collect()
    assert sorted(((r.doc_id, r.license_id, r.start, r.stop) for r in split), key=repr) == got
    assert lic.license_matches(docs, spark.createDataFrame([], TEMPLATES)).count() == 0
    assert lic.license_matches(docs_of(spark, []), lic.templates(spark)).count() == 0


def test_many_places_in_one_text():
    text = ("Released under the MIT License. " * 3000).encode()
    found = lic.scan(text, prepared(lic.TEMPLATES))
    assert [m[2] for m in found if m[0] == "MIT-notice"] == list(range(0, 15_000, 5))


def test_long_insertions_and_deletions_are_chained():
    blocks = prepared(lic.TEMPLATES)
    for name in ("MIT", "BSD-2-Clause", "Apache-2.0"):
        words = [w.decode() for w in lic.words(lic.TEMPLATES[name].encode())]
        half = len(words) // 2
        for size in (9, 20, 40):
            copy = words[:half] + [f"q{i}" for i in range(size)] + words[half:]
            found = {m[0]: m for m in lic.scan(" ".join(["x"] * 7 + copy).encode(), blocks)}
            assert found[name][1:4] == (1.0, 7, 7 + len(copy)), (name, size)
        copy = words[:half] + words[half + 10:]
        found = {m[0]: m for m in lic.scan(" ".join(copy).encode(), blocks)}
        assert name in found and found[name][1] == (len(words) - 10) / len(words)


@pytest.mark.parametrize("line", [
    "Released under the BSD License.", "Licensed under CC BY-SA 4.0.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
])
def test_a_notice_of_another_license_is_not_found(line):
    assert lic.scan(f"Some words. {line} More words.".encode(), prepared(lic.TEMPLATES)) == []


def test_many_copies_of_a_notice_in_one_text():
    """Chains that ended long ago are not looked at again: time follows the text's length."""
    known = lic.Templates()
    for name, text in lic.TEMPLATES.items():
        known.add(name, text.encode())
    line = lic.TEMPLATES["Apache-2.0-notice"]
    found = lic.scan(" ".join([line] * 1500).encode(), [(known, known.hashes())])
    assert sum(name == "Apache-2.0-notice" for name, *_ in found) == 1500
