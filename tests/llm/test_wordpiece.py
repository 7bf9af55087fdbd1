"""Word-piece counts against greedy longest match."""

import re

import public_tokenizers as vocabularies
from hypothesis import given, settings, strategies as st

from shelflight.llm import wordpiece
from tests.llm.helpers import by_id, docs_of

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


def greedy(first, later, word):
    n = at = 0
    while at < len(word):
        pieces = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


PIECE = st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b))


@settings(max_examples=300, deadline=None)
@given(st.sets(PIECE, max_size=14), st.sets(PIECE, max_size=14), st.lists(PIECE, max_size=6).map(b"".join))
def test_automaton_is_greedy_longest_match(first, later, word):
    assert wordpiece.Automaton(first, later).count(word) == greedy(first, later, word)


def vocabulary():
    import base64

    tokens = [base64.b64decode(line.split()[0]) for line in open(RANKS, "rb") if line.strip()]
    later = {t for t in tokens if t[:1] != b" "}
    return later | {t[1:] for t in tokens if t[:1] == b" "} - {b""}, later


def test_given_table(spark, sf):
    first, later = vocabulary()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = by_id(wordpiece.token_counts(docs, RANKS), "n_words", "n_tokens", "n_unknown")
    for row in docs.collect():
        words = re.findall(rb"[^\t-\r !-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]", row.text.encode())
        assert found[row.doc_id] == (len(words), sum(greedy(first, later, w) for w in words), 0)


def test_unknown_words_and_small_cache(monkeypatch):
    count = wordpiece.Counter(wordpiece.Automaton({b"ab", b"a"}, {b"b"}))
    assert count(b"ab a zz abb zz") == (5, 6, 2)
    monkeypatch.setattr(wordpiece, "CACHE_WORDS", 1)
    monkeypatch.setattr(wordpiece, "CACHE_LENGTH", 2)
    for _ in range(2):
        assert count(b"ab a zz abb zz") == (5, 6, 2)


def test_long_word_is_linear():
    assert wordpiece.automaton(RANKS).count(b"a" * 1_000_000) > 0


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a"), (4, "same"), (4, "same"), (5, "x" * 200_000)]
    docs = docs_of(spark, rows).selectExpr("*", "0 as n_words")
    found = wordpiece.token_counts(docs, RANKS).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.n_words for r in found} == {1: 0, 2: 0, 3: 0, None: 1, 4: 1, 5: 1}
    assert wordpiece.token_counts(docs_of(spark, []), RANKS).count() == 0
