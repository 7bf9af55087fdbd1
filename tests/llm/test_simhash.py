"""SimHash near-dedup against plain Python over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from shelflight.llm import simhash
from shelflight.llm.bktree import BKTree, spanning_links
from tests.llm.helpers import docs_of


def plain_fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
    if words and not shingles:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius):
    """code -> smallest code reachable, over all pairs."""
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


def test_fingerprints_match_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r.fingerprint for r in simhash.fingerprints(docs).collect()}
    for row in docs.collect():
        assert found[row.doc_id] & (2**64 - 1) == plain_fingerprint(row.text)


def test_long_text_is_taken_whole(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    text = " ".join(f"Word{i}\n" for i in range(400))
    monkeypatch.setattr(simhash, "blocks", lambda data: __import__("shelflight.llm.common", fromlist=["x"]).blocks(data, 37))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 8))
def test_tree_finds_the_same_as_all_pairs(seed, n, radius):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(3)]
    codes = {c ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(6))) & (2**64 - 1)
             for c in draw.choices(centres, k=n)}
    codes = np.array(sorted(codes), np.uint64)
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert (BKTree(codes).degree(codes, radius) == (apart <= radius).sum(axis=1)).all()
    u, v = spanning_links(codes, radius)
    expected = plain_components(codes.tolist(), radius)
    root = {c: c for c in codes.tolist()}
    root.update(zip(u.tolist(), v.tolist()))
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert groups(root) == groups(expected)


def test_small_shards_and_chains_keep_every_link(spark):
    """Chains of 3 bit steps, a dense ball, and lone codes; keys cut in chunks."""
    draw = random.Random(5)
    codes = {draw.getrandbits(64) for _ in range(200)}
    chain = draw.getrandbits(64)
    for _ in range(40):
        codes.add(chain)
        for _ in range(3):
            chain ^= 1 << draw.randrange(64)
    ball = draw.getrandbits(64)
    codes |= {ball ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(150)}
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    for shard_rows in (1 << 15, 16):
        links = simhash.links(df, len(signed), 4, shard_rows)
        found = {r.node: r.root for r in simhash.components(links).collect()}
        full = {c: found.get(c, c) for c in signed}
        expected = plain_components(sorted(codes), 4)
        groups = {}
        for c in signed:
            groups.setdefault(full[c], set()).add(c & (2**64 - 1))
        wanted = {}
        for c, r in expected.items():
            wanted.setdefault(r, set()).add(c)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_block_masks_cover_all_bits(agree):
    masks = simhash.block_masks(4, agree)
    draw = random.Random(agree)
    for _ in range(200):
        flips = sum({1 << draw.randrange(64) for _ in range(4)})
        assert any(not flips & m for m in masks)


def test_table_agrees_with_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    roots = plain_components(sorted(set(prints.values())), 4)
    first = {}
    for doc, code in sorted(prints.items()):
        first.setdefault(roots[code], doc)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == {doc: first[roots[code]] for doc, code in prints.items()}


def test_edge_cases(spark):
    rows = [
        (7, None), (5, ""), (6, " \n"), (1, "one two"), (2, "ONE two"), (2, "ONE two"), (None, "one two"),
        (9, "é" * 10), (8, "x " * 5000),
    ]
    docs = docs_of(spark, rows).selectExpr("*", "text as fingerprint", "1 as component_id", "2 as key")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, r.component_id) for r in found), key=repr)
    assert got == sorted(
        [(7, 5), (5, 5), (6, 5), (1, 1), (2, 1), (2, 1), (None, 1), (9, 9), (8, 8)], key=repr
    )
    assert {r.fingerprint for r in found if r.doc_id in (5, 6, 7)} == {0}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 8, 9]


def test_empty_table_and_only_null_ids(spark):
    empty = docs_of(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0
    nameless = docs_of(spark, [(None, "a b c d"), (None, "a b c d")])
    assert simhash.one_of_each(nameless).count() == 1


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Different texts with null ids, and one id with two texts, of which one is a copy."""
    rows = [(None, "a b c d"), (None, "e f g h"), (None, "a b c d"), (1, "i j k l"), (2, "i j k l"), (2, "m n o p")]
    kept = simhash.one_of_each(docs_of(spark, rows).repartition(3))
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(None, "a b c d"), (None, "e f g h"), (1, "i j k l"), (2, "m n o p")], key=repr)


def test_rows_of_one_text_and_id_give_the_same_row_each_time(spark):
    rows = [(1, "a b c d", {"k": i}) for i in range(8)]
    docs = docs_of(spark, rows, "doc_id long, text string, more map<string,int>")
    kept = [simhash.one_of_each(docs.repartition(n)).collect() for n in (1, 5)]
    assert len(kept[0]) == 1 and kept[0] == kept[1]


def test_columns_of_any_name_are_kept(spark):
    names = ["_text_hash", "_row_hash", "_kept_id", "kept", "key", "row", "id", "root", "first_id", "code", "fingerprint"]
    rows = [(1, "a b c d", *range(11)), (2, "a b c d", *range(11)), (3, "e f g h", *range(11, 22))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
