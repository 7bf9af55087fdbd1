"""Byte-level BPE against single calls of the library."""

import hashlib

import public_tokenizers as vocabularies
from hypothesis import given, settings, strategies as st

from shelflight.llm import bpe
from tests.llm.helpers import by_id, docs_of

RANKS, PATTERN = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN


def whole(text):
    return bpe.encoding(RANKS, PATTERN).encode_ordinary(text)


def test_round_trip_of_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = bpe.round_trip_digest(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN))
    found = by_id(done, "n_tokens", "ids_sha256", "decoded_sha256")
    for row in docs.collect():
        ids = whole(row.text)
        assert found[row.doc_id] == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(row.text.encode()).hexdigest(),
        )


PARTS = st.sampled_from(["a", "Zß", " ", "  ", "\n", "\t ", "'s", "'", "12", "!?", "é", "漢", "　", "\x85", "\x1c", "😀"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.integers(1, 9), st.integers(2, 6))
def test_cuts_change_nothing(text, size, run):
    import re

    from shelflight.llm.common import WHITE

    old = bpe._RUN
    bpe._RUN = re.compile(f"[{WHITE}]{{{run},}}")
    try:
        parts = list(bpe.segments(text, size))
    finally:
        bpe._RUN = old
    enc = bpe.encoding(RANKS, PATTERN)
    assert "".join(p for p, _ in parts) == text
    ids = [i for p, alone in parts for i in (enc._encode_single_piece(p) if alone else enc.encode_ordinary(p))]
    assert ids == whole(text)


def test_very_long_runs():
    enc = bpe.encoding(RANKS, PATTERN)
    for text in (" " * 1_500_000 + "x", "a" * 300_000, "word " * 100_000, "\n" * 200_000):
        assert enc.decode(bpe.encode_text(enc, text).tolist()) == text


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "<|endoftext|>"), (4, "x\u0000y")]
    docs = docs_of(spark, rows).selectExpr("*", "0 as ids", "1 as decoded")
    done = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded).decode()) for r in done if r.doc_id) == sorted(
        (d, whole(t or ""), t or "") for d, t in rows if d
    )
    empty = hashlib.sha256(b"").hexdigest()
    digest = by_id(bpe.round_trip_digest(spark.createDataFrame(done)), "n_tokens", "ids_sha256", "decoded_sha256")
    assert digest[1] == digest[2] == (0, empty, empty)
    assert bpe.encode(docs_of(spark, []), RANKS, PATTERN).count() == 0
    assert bpe.round_trip(docs_of(spark, []), RANKS, PATTERN).count() == 0
    once = bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert sorted(map(repr, once)) == sorted(map(repr, done))
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(lost, RANKS, PATTERN).first().decoded is None
