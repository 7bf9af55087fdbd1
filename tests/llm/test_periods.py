"""Runs of repeated words against every period of every stretch, compared word by word."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from shelflight.llm import periods, queries
from tests.llm.helpers import by_id, docs_of


def plain_runs(words, shortest=12):
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stop = i + q
            if stop - start >= max(shortest, 2 * q):
                least.setdefault((start, stop), q)
    return sorted((s, e - s, q) for (s, e), q in least.items())


def plain_order(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def plain_looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def found_runs(df):
    return {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in df.collect()}


def expected(words, shortest=12):
    runs = plain_order(plain_runs(words, shortest))
    return runs, plain_collapsed(words, runs), len(words)


LETTERS = st.lists(st.sampled_from("ab"), max_size=90) | st.lists(st.sampled_from("abcd"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.integers(1, 9), st.integers(1, 6), st.sampled_from([2, 3, 7, 12, 20]))
def test_stretches_of_an_array(tail, period, times, shortest):
    words = tail[:7] + (tail[:period] * times) + tail
    numbers = np.array([ord(w) for w in words], np.int64)
    start, stop, q = periods.stretches(numbers, shortest=shortest)
    assert sorted(zip(start.tolist(), (stop - start).tolist(), q.tolist())) == plain_runs(words, shortest)


def test_colliding_hashes_are_solved_again(monkeypatch):
    plain = periods._mixed
    calls = []

    def first_poor(values):
        calls.append(1)
        return plain(values) % np.uint64(3) if len(calls) < 9 else plain(values)

    monkeypatch.setattr(periods, "_mixed", first_poor)
    words = list("abcabcabcabcabcxyabababababababz" * 2)
    start, stop, q = periods.stretches(np.array([ord(w) for w in words], np.int64))
    assert sorted(zip(start.tolist(), (stop - start).tolist(), q.tolist())) == plain_runs(words)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 700, 5000])
def test_tiles_hold_every_run(n):
    cut = list(periods.tiles(n, 64))
    for octave in range((n // 2).bit_length() if n > 1 else 0):
        spans = [(a, b) for a, b, low, high in cut if low <= octave <= high]
        assert spans[0][0] == 0 and spans[-1][1] == n
        for (_, stop), (start, _) in zip(spans, spans[1:]):
            assert stop - start >= max(12, 4 << octave)


def test_tiled_documents_equal_plain_search(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3 + i, 300 + 20 * i)]
        a, p = int(rng.integers(0, 200)), int(rng.integers(1, 120))
        stop = int(rng.integers(a, len(words)))
        words[a:stop] = [words[a + (j - a) % p] for j in range(a, stop)]
        texts.append(words)
    docs = docs_of(spark, [(i, " ".join(w)) for i, w in enumerate(texts)])
    found = found_runs(periods.periodic_runs(docs, long_bytes=100, tile_words=64))
    assert found == {i: expected(w) for i, w in enumerate(texts)}
    assert any(runs for runs, _, _ in found.values())


def test_query_on_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = by_id(queries.op13_periodic_runs(spark, sf), *columns)
    assert len(found) == len(rows)
    for row in rows:
        words = plain_looped(row.doc_id, row.text)
        runs, collapsed, _ = expected(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert found[row.doc_id] == (
            len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest(),
        )


def test_long_periodic_texts(spark):
    """One word, a period just below half of the text, and a text of no repeats."""
    half = [f"x{i}" for i in range(40_000)]
    texts = {1: ["a"] * 200_000, 2: half * 2, 3: [f"y{i}" for i in range(100_000)], 4: ["b", "c"] * 70_000 + half[:30_000]}
    found = found_runs(periods.periodic_runs(docs_of(spark, [(i, " ".join(w)) for i, w in texts.items()])))
    assert found[1] == ([(0, 200_000, 1)], "a", 200_000)
    assert found[2] == ([(0, 80_000, 40_000)], " ".join(half), 80_000)
    assert found[3][0] == []
    assert found[4] == ([(0, 140_000, 2)], " ".join(["b", "c", *half[:30_000]]), 170_000)


def test_odd_rows(spark):
    long = "ab cd\t" * 40
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "a " * 12), (5, "a " * 12), (None, "a " * 13), (None, long),
        (None, long), (6, "a " * 11),
    ]
    extra = [(i, t, t, 0, 0, 0) for i, t in rows]
    docs = spark.createDataFrame(extra, "doc_id long, text string, runs string, text_hash int, start int, _id int")
    for long_bytes in (0, 1 << 16):
        got = sorted(
            (repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed)
            for r in periods.periodic_runs(docs, long_bytes=long_bytes, tile_words=16).collect()
        )
        want = []
        for i, t in rows:
            runs, collapsed, n = expected((t or "").split())
            want.append((repr(i), n, runs, collapsed))
        assert got == sorted(want)
    assert periods.periodic_runs(docs_of(spark, [])).count() == 0
    blank = by_id(periods.digest(periods.periodic_runs(docs_of(spark, [(1, None)]))), "n_runs", "start", "runs_sha256")
    assert blank[1] == (0, None, hashlib.sha256(b"").hexdigest())
