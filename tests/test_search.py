"""Nearest neighbours, re-ranking and hits against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import shelflight as sl
from shelflight.operators.knn import NearestRows
from tests.conftest import rows_of

CATALOG = "row_id bigint, embedding array<float>"
REQUESTS = "query_id string, q string, k int, pool int, boost double, qvec array<float>"


def brute(queries, limits, ids, rows):
    """Sorted (query, distance, id), first ``limit`` each."""
    found = []
    for number, (query, limit) in enumerate(zip(queries, limits)):
        scored = []
        for row_id, row in zip(ids, rows):
            total = 0.0
            for a, b in zip(query, row):
                total += (float(a) - float(b)) * (float(a) - float(b))
            scored.append((total, row_id))
        found += [(number, d, i) for d, i in sorted(scored)[:limit]]
    return found


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(0, 60), st.integers(1, 5))
def test_running_lists_equal_brute_force(seed, n_queries, n_rows, dim):
    rng = np.random.default_rng(seed)
    # few distinct values, so that ties are common
    queries = rng.integers(-2, 3, (n_queries, dim)).astype(np.float32) / 3
    rows = rng.integers(-2, 3, (n_rows, dim)).astype(np.float32) / 3
    ids = rng.permutation(n_rows).astype(np.int64)
    limits = rng.integers(0, 9, n_queries)
    nearest = NearestRows(queries, limits, tile_cells=16, buffer_rows=8)
    for start in range(0, n_rows, 7):
        nearest.offer(ids[start:start + 7], rows[start:start + 7])
    got = [(int(q), float(d), int(i)) for q, d, i in zip(*nearest.result())]
    assert got == brute(queries, limits, ids.tolist(), rows)


def test_running_lists_with_large_and_odd_values():
    queries = np.array([[0.0, 0.0], [1e18, 1.0]], dtype=np.float32)
    rows = np.array([[1e18, 0], [np.nan, 0], [1, 1], [3e19, 0], [0, 2]], dtype=np.float32)
    ids = np.arange(5)
    nearest = NearestRows(queries, [5, 2])
    nearest.offer(ids, rows)
    query, _, found = nearest.result()
    assert found[query == 0].tolist() == [2, 4, 0, 3, 1]  # the NaN row is last, not lost
    assert found[query == 1].tolist() == [0, 2]


def vectors(spark, n=300, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = (rng.integers(-3, 4, (n, dim)) / 2).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(rows)], CATALOG)
    return df.repartition(5), rows


def batch(spark, n=23, dim=6, seed=2):
    rng = np.random.default_rng(seed)
    qvecs = (rng.integers(-3, 4, (n, dim)) / 2).astype(np.float32)
    ks, pools = rng.integers(1, 9, n).tolist(), rng.integers(1, 9, n).tolist()
    data = [
        (f"q{i:02d}", ("rod", "anvil", "7")[i % 3], ks[i], pools[i], float(i % 2), qvecs[i].tolist())
        for i in range(n)
    ]
    return spark.createDataFrame(data, REQUESTS), qvecs, [max(p) for p in zip(ks, pools)]


@pytest.mark.parametrize("limit_bytes", [64 << 20, 2000], ids=["in place", "in cells"])
def test_knn_equals_brute_force_on_both_paths(spark, limit_bytes):
    catalog, rows = vectors(spark)
    requests, qvecs, limits = batch(spark)
    found = sl.knn_candidates(requests, catalog, limit_bytes=limit_bytes)
    got = sorted((r.query_id, r["rank"], r.dist, r.row_id) for r in found.collect())
    expected, rank = [], {}
    for number, dist, row_id in brute(qvecs, limits, range(len(rows)), rows):
        rank[number] = rank.get(number, 0) + 1
        expected.append((f"q{number:02d}", rank[number], dist, row_id))
    assert got == sorted(expected)


def test_large_batches_are_only_measured(spark):
    requests, *_ = batch(spark)
    small, large = sl.measure_batch(requests), sl.measure_batch(requests, limit_bytes=100)
    assert small.rows is not None and large.rows is None
    assert small.footprint == large.footprint > 100
    assert small.requests == 23 and small.dim == 6


def test_whole_search_is_the_same_on_both_paths(spark):
    requests, *_ = batch(spark)
    catalog, _ = vectors(spark, n=80)
    index = catalog.select(
        "row_id", F.col("row_id").cast("string").alias("brand_sku_id"), F.lit("l").alias("label"),
        F.lit("b").alias("brandLabel"), F.lit("c").alias("category"), F.lit("RT").alias("brand_phonetic"),
        "embedding",
    )
    one, other = (sl.hybrid_search(requests, index, limit_bytes=b) for b in (64 << 20, 1000))
    assert rows_of(one) == rows_of(other) != []


def test_pool_larger_than_catalog_and_empty_sides(spark):
    catalog, _ = vectors(spark, n=3)
    requests, *_ = batch(spark, n=2)
    wide = requests.withColumn("pool", F.lit(50))
    assert sl.knn_candidates(wide, catalog).count() == 6
    assert sl.knn_candidates(wide, catalog.where("row_id < 0")).count() == 0
    assert sl.knn_candidates(requests.where("k < 0"), catalog).count() == 0


def test_ties_go_to_the_smaller_row_id(spark):
    catalog = spark.createDataFrame([(9, [1.0]), (4, [1.0]), (7, [1.0])], CATALOG)
    requests = spark.createDataFrame([("q", "x", 2, 2, 0.0, [1.0])], REQUESTS)
    found = sl.knn_candidates(requests, catalog).orderBy("rank").collect()
    assert [r.row_id for r in found] == [4, 7]


def test_odd_vectors_fail(spark):
    good = spark.createDataFrame([("q", "x", 1, 1, 0.0, [1.0, 2.0])], REQUESTS)
    uneven = good.union(spark.createDataFrame([("r", "x", 1, 1, 0.0, [1.0])], REQUESTS))
    with pytest.raises(ValueError, match="differ in length"):
        sl.measure_batch(uneven)
    with pytest.raises(ValueError, match="differ in length"):
        sl.measure_batch(uneven, limit_bytes=1)
    for vector in ([1.0], None):
        catalog = spark.createDataFrame([(1, [1.0, 2.0]), (2, vector)], CATALOG)
        with pytest.raises(Exception, match="expected vectors of length 2"):
            sl.knn_candidates(good, catalog).collect()


INDEX = (
    "row_id bigint, brand_sku_id string, label string, brandLabel string, category string, "
    "brand_phonetic string, embedding array<float>"
)


def small_index(spark):
    data = [
        (0, "a", "ring", "red", "c", "RT", [0.0]),
        (1, "b", "ring", "blue", "c", "BL", [1.0]),
        (2, "", "ring", "rod", "c", "RT", [2.0]),
        (3, "d", "ring", "17", "c", "", [3.0]),
        (4, "e", "ring", "red co", "c", "RT K", [4.0]),
    ]
    return spark.createDataFrame(data, INDEX)


def search(spark, q, k, pool, boost, at=0.9):
    requests = spark.createDataFrame([("q", q, k, pool, boost, [at])], REQUESTS)
    hits = sl.hybrid_search(requests, small_index(spark)).orderBy("rank").collect()
    return [(h.brand_sku_id, round(h.score, 6)) for h in hits]


def test_boost_reorders_the_pool_only(spark):
    assert search(spark, "x", 2, 2, 5.0) == [("b", 0.01), ("a", 0.81)]
    # "rod" sounds like "red": its brands move up, below zero too
    assert search(spark, "Rod", 3, 3, 5.0) == [("a", -4.19), ("", -3.79), ("b", 0.01)]
    # the third-nearest row matches but is outside a pool of two
    assert search(spark, "Rod", 2, 2, 0.1) == [("b", 0.01), ("a", 0.71)]


def test_empty_and_two_word_codes_are_never_boosted(spark):
    assert search(spark, "17 red co", 5, 5, 100.0)[2:] == [("b", 0.01), ("d", 4.41), ("e", 9.61)]


def test_k_as_a_slice(spark):
    assert len(search(spark, "x", 9, 3, 0.0)) == 5
    assert search(spark, "x", 0, 3, 0.0) == []
    assert [h[0] for h in search(spark, "x", -1, 3, 0.0)] == ["b", "a"]


def test_zero_boost_is_plain_order_and_scores_rise(spark):
    catalog, _ = vectors(spark, n=60)
    index = sl.lookup_columns(
        catalog.select(
            "*", F.col("row_id").cast("string").alias("brand_sku_id"), F.lit("p").alias("product_name"),
            F.lit("rod").alias("brand_name"), F.lit("c").alias("category_name"),
            F.when(F.col("row_id") % 2 == 0, "RT").otherwise("BL").alias("brand_phonetic"),
        ),
        "embedding",
    )
    requests, *_ = batch(spark)
    hits = sl.hybrid_search(requests, index)
    by_query = {}
    for h in hits.orderBy("query_id", "rank").collect():
        by_query.setdefault(h.query_id, []).append((h["rank"], h.score))
    for ranked in by_query.values():
        assert [r for r, _ in ranked] == list(range(1, len(ranked) + 1))
        assert [s for _, s in ranked] == sorted(s for _, s in ranked)
    plain = sl.hybrid_search(requests.withColumn("boost", F.lit(0.0)), index)
    nearest = sl.knn_candidates(requests, catalog).join(requests.select("query_id", "k"), "query_id")
    nearest = nearest.where("rank <= k").select("query_id", "rank", F.col("row_id").cast("string"))
    assert rows_of(plain, "query_id", "rank", "brand_sku_id") == rows_of(nearest)
    # how the inputs are partitioned never matters
    again = sl.hybrid_search(requests.repartition(3), index.repartition(1))
    assert rows_of(again) == rows_of(hits)


def test_search_text_is_embedded_when_no_vector_is_given(spark):
    raw = spark.createDataFrame(
        [(0, "1", "Small Ring", "Acme", "tools"), (1, "2", "Large Plate", "Acme", "tools")],
        "row_id bigint, brand_sku_id string, product_name string, brand_name string, category_name string",
    )
    embedder = sl.HashedNGrams()
    prepared = sl.embed_table(sl.prepare_catalog(raw), "search_text", embedder)
    index = sl.lookup_columns(prepared, "embedding")
    requests = spark.createDataFrame([("q", "acme large plate tools")], "query_id string, q string")
    hits = sl.hybrid_search(requests, index, embedder).orderBy("rank").collect()
    assert [h.brand_sku_id for h in hits] == ["2", "1"]


SKUS = "id string, label string, brandId string, brandLabel string, consumerSellingPrice double"
FACETS = "brandSKUId string, standardKey string, standardValue string, value string, isActive boolean"


def test_filters_apply_after_the_best_k(spark):
    skus = spark.createDataFrame([("a", "ring", "1", "red", 50.0), ("b", "ring", "2", "blue", 9.0)], SKUS)
    facets = spark.createDataFrame([("b", "size", "5", None, True)], FACETS)
    data = [("none", {}), ("size", {"size": ["5"]}), ("empty", {"size": []}), ("odd", {"size": ["6"]}),
            ("free", {"price_range": ["Free"]})]
    requests = spark.createDataFrame(data, "query_id string, filters map<string,array<string>>").withColumns(
        {"q": F.lit("x"), "qvec": F.array(F.lit(0.9).cast("float")), "k": F.lit(3)}
    )
    hits = sl.search_with_facets(requests, small_index(spark), skus, facets)
    kept = {}
    for h in hits.orderBy("query_id", "rank").collect():
        kept.setdefault(h.query_id, []).append((h["rank"], h.brand_sku_id))
    everything = [(1, "b"), (2, "a"), (3, "")]
    assert kept["none"] == everything
    assert kept["size"] == [(1, "b")]  # the rank is kept and nothing is refilled
    assert kept["empty"] == kept["free"] == [(1, "b"), (2, "a")]  # a filter map drops hits without id
    assert "odd" not in kept
    totals = dict(rows_of(sl.result_totals(requests, hits)))
    assert totals == {"none": 3, "size": 1, "empty": 2, "odd": 0, "free": 2}


def test_lists_without_any_id_stay_unfiltered(spark):
    hits = spark.createDataFrame([("q", 1, ""), ("q", 2, None)], "query_id string, rank int, brand_sku_id string")
    requests = spark.createDataFrame(
        [("q", {"size": ["5"]})], "query_id string, filters map<string,array<string>>"
    )
    kept = sl.filter_hits(hits, requests, spark.createDataFrame([], SKUS), spark.createDataFrame([], FACETS))
    assert kept.count() == 2


def test_report(spark):
    hits = spark.createDataFrame(
        [("q", 1, "i", "", None, "c", "", 0.0), ("q", 2, "i", "l", "b", "", "", -0.12345678)],
        "query_id string, rank int, brand_sku_id string, label string, brandLabel string, "
        "category string, brand_phonetic string, score double",
    )
    first, second = sl.hit_report(hits).orderBy("rank").collect()
    assert (first.score_text, first.score_label, first.brand, first["product"]) == ("0.0000", "N/A", "N/A", "N/A")
    assert (second.score_text, second.score_label, second.category) == ("-0.1235", "-0.1235", "N/A")


def test_request_values_are_filled_row_by_row(spark):
    index = spark.createDataFrame(
        [(i, str(i), f"p{i}", "red", "c", "RT", [float(i), 0.0]) for i in range(60)],
        "row_id bigint, brand_sku_id string, label string, brandLabel string, category string, "
        "brand_phonetic string, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [("a", "x", None, None, None, [0.0, 0.0]), ("b", "red", 2, 3, None, [0.0, 0.0])],
        "query_id string, q string, k int, pool int, boost double, qvec array<float>",
    )
    found = sl.hybrid_search(asked, index).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [*(("a", i) for i in range(1, 6)), ("b", 1), ("b", 2)]
    assert all(r.score is not None for r in found)
    assert [r.score for r in found if r.query_id == "b"] == [-0.2, 0.8]


@pytest.mark.parametrize("rows, message", [
    ([("a", 5, 5), ("a", 5, 5)], "repeated"), ([("a", 2**31, 5)], "above"), ([("a", 5, 2**40)], "above"),
])
def test_bad_batches_are_refused(spark, rows, message):
    asked = spark.createDataFrame(
        [(*r, [1.0]) for r in rows], "query_id string, k bigint, pool bigint, qvec array<float>"
    )
    index = spark.createDataFrame([(1, [1.0])], "row_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match=message):
        sl.knn_candidates(asked, index)


def test_blocks_check_the_catalog_too(spark):
    asked = spark.createDataFrame(
        [(str(i), 1, 1, [1.0, 0.0]) for i in range(50)], "query_id string, k int, pool int, qvec array<float>"
    )
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "row_id bigint, embedding array<float>").repartition(2)
    with pytest.raises(Exception, match="expected vectors of length 2"):
        sl.knn_candidates(asked, bad, limit_bytes=500).count()
