"""Collocations and their counters against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelflight.llm import collocations, quotient
from tests.llm.helpers import docs_of

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, share=50, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            own.update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    made = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in often.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            made.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(made)


def found(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.integers(0, 12), st.integers(0, 2**32 - 1))
def test_filters_lose_nothing(bits, n, prefix, seed):
    rng = np.random.default_rng(seed)
    half = quotient.half_bits(bits)
    words = tuple(rng.integers(0, min(1 << bits, 9 + (seed % 2) * (1 << 32)), n, dtype=np.uint64) for _ in range(3))
    keys = quotient.permute(*quotient.pack(words, bits), half)
    times = rng.integers(1, 700, n)
    made = quotient.counted(*keys, times, half)
    prefix = min(prefix, half)
    back = [quotient.read(quotient.write(*part, half, prefix)) for _, *part in quotient.cut(*made, half, prefix)]
    both = quotient.merge([*back, *back], half) if back else made
    phrases = quotient.unpack(*quotient.restore(both[0], both[1], half), bits)
    got = dict(zip(zip(*(p.tolist() for p in phrases)), both[2].tolist()))
    want = Counter()
    for *phrase, t in zip(*(w.tolist() for w in words), times.tolist()):
        want[tuple(phrase)] += 2 * t
    assert got == dict(want)


def test_equal_sized_ranges():
    """Keys of consecutive word numbers fall evenly into ranges."""
    for bits in (8, 20, 32):
        n = np.arange(1, 1 << 8, dtype=np.uint64)
        first, second = (x.ravel() for x in np.meshgrid(n, n))
        half = quotient.half_bits(bits)
        high, _ = quotient.permute(*quotient.pack((first, second, first), bits), half)
        sizes = np.bincount((high >> np.uint64(half - 5)).astype(int), minlength=32)
        assert sizes.max() < 1.3 * sizes.mean()


@pytest.mark.parametrize("fan", [8, 1])
def test_merging_in_rounds(spark, monkeypatch, fan):
    """Many segments: one round, or many rounds of two segments and two ranges."""
    monkeypatch.setattr(collocations, "FAN_BITS", fan)
    monkeypatch.setattr(collocations, "SEGMENT_WORDS", 300)
    monkeypatch.setattr(collocations, "TOGETHER", 1 << 10)
    monkeypatch.setattr(collocations, "RANGE_KEYS", 64)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        words = [f"w{x}" for x in rng.zipf(1.6, 40) % 60]
        words[10:10] = ["New", "york", "city"] * (i % 3)
        rows.append(([None, "en", "fr"][i % 3], " ".join(words) + ". " + " ".join(words[:5])))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert found(collocations.collocations(docs)) == plain(rows)


def test_top_and_share(spark):
    rows = [("en", "a b c. a b. " * 3 + f"x{i % 4} y z, a b c d")for i in range(30)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for share, top in ((50, 3), (100, 2000), (1, 5)):
        assert found(collocations.collocations(docs, share=share, top=top)) == plain(rows, share=share, top=top)


def test_scores_are_exact(spark):
    cases = [(10**14, 2 * 10**14, 3 * 10**14), (7, 9, 11), (3037000500, 3037000501, 3037000500), (10**15 - 1, 10**15 - 1, 10**15)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = df.select(collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"), "a", "l", "r").collect()
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in got)


def test_odd_rows(spark):
    long = "very Long text\x0bwith\tlines; " * 5000
    rows = [
        (None, None), (None, "É b c " * 12), ("und", "É b c " * 12), ("en", ""), ("en", " \t\n.,"), ("en", "one"), ("fr", None),
        ("en", long), ("en", long), ("de", "same same " * 10), ("de", "x\u0000y x\u0000y " * 7 + "\x1c z"),
    ]
    docs = spark.createDataFrame(
        [(*r, "k", 0, 0, "w", 1) for r in rows],
        "lang string, text string, segment string, local int, n int, word string, a int",
    )
    assert found(collocations.collocations(docs)) == plain(rows)
    assert collocations.collocations(docs_of(spark, [], "lang string, text string")).count() == 0
    assert collocations.collocations(docs_of(spark, [("en", "a b c")], "lang string, text string")).count() == 0
