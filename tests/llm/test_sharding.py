"""Feistel sharding: a permutation, its laws and its reproducibility."""

import zlib
from hashlib import md5
from math import isqrt

import pytest
from pyspark.sql import functions as F

from shelflight.llm import sharding
from tests.llm.helpers import docs_of


def plain_place(number, n, seed):
    side = isqrt(n - 1) + 1
    while True:
        left, right = divmod(number, side)
        for i in range(1, sharding.ROUNDS + 1):
            noise = int(md5(f"{seed}:{i}:{right}".encode()).hexdigest()[:12], 16)
            left, right = right, (left + noise) % side
        number = left * side + right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_places_are_a_permutation(spark, n):
    rows = spark.range(n).withColumnRenamed("id", "row_number")
    found = {r.row_number: r.place for r in sharding.permuted(rows, "row_number", n, 7, "place").collect()}
    assert sorted(found.values()) == list(range(n))
    assert found == {i: plain_place(i, n, 7) for i in range(n)}


def test_walk_beyond_the_unrolled_passes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PASSES", 1)
    rows = spark.range(3).withColumnRenamed("id", "row_number")
    for seed in range(6):
        found = sharding.permuted(rows, "row_number", 3, seed, "place").collect()
        assert sorted(r.place for r in found) == [0, 1, 2]


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sharding.shard(docs, 8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = len(texts)
    assert len(found) == n
    order = {d: i for i, d in enumerate(sorted(texts))}
    slots = {}
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.row_number == order[r.doc_id]
        assert r.place == plain_place(r.row_number, n, 20) == r.slot * 8 + r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs.repartition(5).orderBy(F.rand(1)), 8).collect()
    place = lambda rows: {r.doc_id: r.place for r in rows}
    assert place(again) == place(found)


def test_edge_cases(spark):
    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (2, "x" * 100_000), (3, "é")]
    docs = docs_of(spark, rows).selectExpr("*", "1 as shard", "2 as size", "3 as place")
    found = sharding.shard(docs, 4).collect()
    assert sorted(r.place for r in found) == list(range(6))
    assert sorted((r["size"], r.text_crc32) for r in found if r.doc_id is None) == [(1, 0), (2, zlib.crc32(b"a"))]
    assert sharding.shard(docs_of(spark, []), 4).count() == 0
    assert {r.shard for r in sharding.shard(docs, 1).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.shard(docs, 0)


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = sharding.shard(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
