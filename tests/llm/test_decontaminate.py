"""Benchmark decontamination against sets of word windows."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from shelflight.llm import decontaminate as dec
from tests.llm.helpers import docs_of

ITEMS = "item_id long, text string"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_digest(text, items, window=10):
    words = plain_words(text)
    hit, names = [False] * len(words), set()
    for name, item in items:
        found = plain_words(item)
        n = min(window, len(found))
        for k in range(len(found) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p:p + n] == found[k:k + n]:
                    hit[p:p + n] = [True] * n
                    names.add(str(name))
    joined = ",".join(sorted(names))
    return len(words), sum(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), any(hit)


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def check(spark, docs, items, **options):
    got = dec.digest(dec.verbatim_matches(docs_of(spark, docs), docs_of(spark, items, ITEMS), **options))
    found = sorted((tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in got.collect()), key=repr)
    window = options.get("window", 10)
    assert found == sorted(((d, *plain_digest(t, items, window)) for d, t in docs), key=repr)


def test_given_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=700)


def test_edge_cases(spark):
    ten = "a b c d e f g h i j"
    items = [(1, ten), (2, "b C d"), (3, None), (4, " ,."), (5, ten + " k"), (5, "zz"), (6, "same same same")]
    docs = [
        (1, "x " + ten.upper() + " k a-b-c"), (2, None), (3, ""), (None, ten), (4, ten), (4, ten),
        (5, "same " * 50), (6, "b c"), (7, "é b c d è"), (8, "a b c d e f g h i z"),
    ]
    check(spark, docs, items)
    check(spark, docs, items, window=3)
    check(spark, docs, [])
    check(spark, [], items)


def test_random_texts(spark):
    draw = random.Random(3)
    text = lambda n: " ".join(draw.choices("abc", k=draw.randrange(n)))
    docs = [(i, text(120)) for i in range(60)]
    items = [(i, text(18)) for i in range(25)]
    check(spark, docs, items, window=4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 80))
def test_suffix_array_is_sorted(values, depth):
    sequence = np.array(values, np.int32)
    order = dec.suffix_array(sequence, depth).tolist()
    keys = [values[i:i + depth] for i in order]
    assert sorted(order) == list(range(len(values))) and keys == sorted(keys)


def test_matches_are_maximal_and_located(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    doc = "zero " + item.replace("twelve", "thirteen") + " tail"
    found = dec.verbatim_matches(docs_of(spark, [(1, doc)]), docs_of(spark, [(9, item)], ITEMS)).first()
    assert [tuple(m) for m in found.matches] == [("9", 0, 1, 11)]


def test_removal_keeps_columns_and_clean_rows(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, None), (3, "x a b c y"), (4, "clean")]).selectExpr(
        "1 as matches", "doc_id", "text", "'q' as item_id"
    )
    kept = dec.decontaminated(docs, docs_of(spark, [(1, "A b, c")], ITEMS), window=3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4]


def test_long_text_in_pieces(monkeypatch, spark):
    from shelflight.llm import common

    monkeypatch.setattr(common.blocks, "__defaults__", (64,))
    tests = dec.Tests(10)
    tests.add("7", " ".join(f"w{i}" for i in range(100, 130)).encode())
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    counts, found = dec.find_matches([text], [dec.Suffixes(tests)])
    assert counts == [1000] and found == [[("7", 0, 100, 30)]]
