"""Re-Pair token shards: exact round trips and the library's ids."""

import zlib

import numpy as np
import public_tokenizers as vocabularies
from hypothesis import given, settings, strategies as st

from shelflight.llm import repair
from tests.llm.helpers import docs_of

FILE = vocabularies.path("byte_bpe_50k.json")


def library_ids(text):
    return repair.encoder(FILE).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def written(spark, tmp_path, docs, name="shards", **options):
    path = str(tmp_path / name)
    repair.write_shards(docs, path, FILE, **options)
    return repair.read_shards(spark, path)


def expected(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = library_ids(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_given_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for name, size in (("one", 1 << 20), ("many", 500)):
        shards = written(spark, tmp_path, docs, name, shard_tokens=size)
        digest = repair.digest(repair.decoded_documents(shards))
        assert sorted(tuple(r) for r in digest.collect()) == expected(rows)
    assert shards.count() > 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=80), min_size=1, max_size=6), st.integers(2, 5))
def test_grammar_round_trip(documents, least):
    old, repair.LEAST_COUNT = repair.LEAST_COUNT, least
    try:
        symbols = np.concatenate([np.array(d, np.uint32) for d in documents])
        last = np.zeros(len(symbols), bool)
        last[np.cumsum([len(d) for d in documents]) - 1] = True
        packed, ends, rules = repair.compress(symbols, last.copy(), 5)
    finally:
        repair.LEAST_COUNT = old
    lengths = repair.rule_lengths(rules, 5)
    grammar = repair.Grammar(5, rules, lengths)
    packed = packed.astype(np.int64)
    assert (grammar.expand(packed) == symbols).all()
    cuts = [0, *(np.flatnonzero(ends) + 1).tolist()]
    parts = [grammar.expand(packed[a:b]).tolist() for a, b in zip(cuts, cuts[1:])]
    assert parts == documents
    for low in range(0, len(symbols), 7):
        high = min(low + 9, len(symbols))
        assert (grammar.between(packed, low, high) == symbols[low:high]).all()


def test_frequent_pairs_shrink():
    symbols = np.tile(np.array([1, 2, 3, 4], np.uint32), 1000)
    last = np.zeros(len(symbols), bool)
    last[-1] = True
    packed, _, rules = repair.compress(symbols, last, 10)
    assert len(packed) < len(symbols) / 4 and len(rules)


def test_units_are_what_the_library_sees():
    library = repair.Encoder(FILE)
    texts = [
        " a\x1c.. 's  x　y \n\n z", "", "  ", "a" * 3000, " " * 9000 + "x", "don't  stop\x85\x85 1234 ab12!!!",
        "<|endoftext|> x", "é́ 😀😀 漢字", "\n\n", "tab\tand\r\nbreaks ", "new new  new", "x\u0000 y",
    ]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, library.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)[:-1]


def test_small_cache(monkeypatch):
    monkeypatch.setattr(repair, "CACHE_BYTES", 1)
    library = repair.Encoder(FILE)
    for text in ("one two", "two three", "one two"):
        assert np.frombuffer(library.encode([text])[0], "<u4").tolist() == library_ids(text)[:-1]


def test_edge_cases(spark, tmp_path):
    rows = [(None, "z"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "w " * 30_000)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as tie", "2 as part")
    found = repair.digest(repair.decoded_documents(written(spark, tmp_path, docs, shard_tokens=1000))).collect()
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected(rows)
    none = written(spark, tmp_path, docs_of(spark, []), "none")
    assert repair.decoded_documents(none).count() == 0
