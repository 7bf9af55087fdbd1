"""Facets, prices, filters and lookups against plain-Python rules."""

import random

import pytest
from pyspark.sql import Window, functions as F

import shelflight as sl
from shelflight.functions.price import BUCKETS, LABELS
from shelflight.operators.ranking import spread_row_number
from tests.conftest import rows_of

SKUS = "id string, label string, brandId string, brandLabel string, consumerSellingPrice double"
FACETS = "brandSKUId string, standardKey string, standardValue string, value string, isActive boolean"
FILTERS = "query_id string, filters map<string,array<string>>"
PLACEHOLDERS = {"n/a", "na", "null", "none", "-"}
PRICES = [None, -1.0, 0.0, 0.01, 99.99, 99.995, 100.0, 249.99, 250.0, 500.0, 1000.0, 2500.0,
          4999.99, 5000.0, 99999.99, 100000.0]


def usable(value):
    return value is not None and value.strip(" ") != "" and value.strip(" ").lower() not in PLACEHOLDERS


def label_of(price):
    return next(label for upper, label, *_ in BUCKETS if upper is None or price < upper)


def world(spark, seed=3):
    """A small random shop, with every kind of odd row."""
    rng = random.Random(seed)
    skus = [(f"s{i}", f"label {i % 7}", f"b{i % 3}", "brand", PRICES[i % len(PRICES)]) for i in range(40)]
    values = ["5", "7", "n/a", " NA ", "", " ", None, "x ", "X", "-"]
    facets = [
        (f"s{rng.randrange(45)}", rng.choice(["size", "type", "colour", "price_range", None]),
         rng.choice(values), rng.choice(values), rng.random() < 0.8)
        for _ in range(400)
    ]
    hits = [(f"q{rng.randrange(8)}", f"s{rng.randrange(48)}") for _ in range(160)]
    filters = [
        {}, {"size": ["5"]}, {"size": ["5", "7"], "type": ["x ", "X"]}, {"size": []},
        {"price_range": ["Under ₹100", "nonsense"]}, {"price_range": ["nonsense"]},
        {"price_range": ["Above ₹5,000", "₹250 - ₹500"], "colour": ["7", "5"]}, {"type": ["n/a", "-"]},
    ]
    requests = [(f"q{i}", f) for i, f in enumerate(filters)]
    frames = (
        spark.createDataFrame(hits, "query_id string, brand_sku_id string").repartition(3),
        spark.createDataFrame(requests, FILTERS),
        spark.createDataFrame(skus, SKUS),
        spark.createDataFrame(facets, FACETS).repartition(3),
    )
    return frames, (hits, requests, skus, facets)


def expected_facet_rows(hits, facets, active=None):
    found = []
    for query, sku in set(hits):
        for owner, key, standard, value, live in facets:
            shown = standard if standard is not None else value
            if owner == sku and live and key is not None and usable(shown):
                if active is None or key in active:
                    found.append((query, sku, key, shown, value, standard))
    return sorted(found, key=repr)


def test_facet_rows(spark):
    (hits, _, _, facets), (h, _, _, f) = world(spark)
    assert rows_of(sl.facet_rows(hits, facets)) == expected_facet_rows(h, f)
    assert rows_of(sl.facet_rows(hits, facets, small_hits=True)) == expected_facet_rows(h, f)
    keys = spark.createDataFrame(
        [("size", True), ("size", True), ("type", False)], "standardKey string, isActive boolean"
    )
    assert rows_of(sl.facet_rows(hits, facets, keys, True)) == expected_facet_rows(h, f, {"size"})
    switched = hits.withColumn("strict", F.col("query_id") == "q1")
    assert rows_of(sl.facet_rows(switched, facets, keys, "strict")) == sorted(
        expected_facet_rows([x for x in h if x[0] == "q1"], f, {"size"})
        + expected_facet_rows([x for x in h if x[0] != "q1"], f),
        key=repr,
    )


def test_counts_are_row_counts(spark):
    (hits, _, _, facets), (h, _, _, f) = world(spark)
    rows, distinct = {}, {}
    for query, sku, key, value, *_ in expected_facet_rows(h, f):
        rows[query, key, value] = rows.get((query, key, value), 0) + 1
        distinct.setdefault((query, key, value), set()).add(sku)
    found = sl.facet_rows(hits, facets)
    assert {tuple(r[:3]): r[3] for r in rows_of(sl.facet_counts(found))} == rows
    assert {tuple(r[:3]): r[3] for r in rows_of(sl.facet_counts(found, distinct_skus=True))} == {
        k: len(v) for k, v in distinct.items()
    }


def expected_prices(hits, skus):
    counted = {}
    for query, sku in set(hits):
        for id_, *_, price in skus:
            if id_ == sku and price is not None and 0 < price < 100000:
                counted[query, label_of(price)] = counted.get((query, label_of(price)), 0) + 1
    return counted


def test_price_histogram(spark):
    (hits, _, skus, _), (h, _, s, _) = world(spark)
    found = sl.price_range_facets(hits, skus)
    assert {(r.query_id, r.facet_value): r.cnt for r in found.collect()} == expected_prices(h, s)
    everything = skus.select(F.lit("all").alias("query_id"), F.col("id").alias("brand_sku_id"))
    total = sl.price_range_facets(everything, skus).agg(F.sum("cnt")).first()[0]
    assert total == sum(p is not None and 0 < p < 100000 for *_, p in s)


def test_price_filter_has_no_window(spark):
    (_, _, skus, _), (_, _, s, _) = world(spark)
    kept = {r.id for r in sl.price_filter(skus, ["Under ₹100", "Above ₹5,000", "nonsense"]).collect()}
    assert kept == {i for i, *_, p in s if p is not None and (p < 100 or p >= 5000)}
    assert sl.price_filter(skus, ["nonsense"]).count() == len(s)
    assert sl.price_filter(skus, []).count() == len(s)


def passes(sku, filters, skus, facets):
    for key, values in filters.items():
        if key == "price_range":
            price = next((p for i, *_, p in skus if i == sku), None)
            ok = price is not None and label_of(price) in values
        else:
            shown = [s if s is not None else v for o, k, s, v, live in facets if o == sku and k == key and live]
            ok = any(usable(x) and x in values for x in shown)
        if not ok:
            return False
    return True


def expected_matches(hits, requests, skus, facets):
    found = []
    for query, filters in requests:
        mine = [sku for q, sku in hits if q == query]
        kept = {
            k: v for k, v in filters.items()
            if v and (k != "price_range" or any(x in LABELS for x in v))
        }
        if not kept:
            found += [(query, sku) for sku in mine]
        else:
            known = {i for i, *_ in skus}
            found += [(query, sku) for sku in set(mine) if sku in known and passes(sku, kept, skus, facets)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("seed", range(3, 6))
@pytest.mark.parametrize("small_hits", [False, True])
def test_filter_skus(spark, seed, small_hits):
    frames, plain = world(spark, seed)
    hits, requests, skus, facets = frames
    assert rows_of(sl.filter_skus(hits, requests, skus, facets, small_hits)) == expected_matches(*plain)


def test_more_values_never_remove_and_more_keys_never_add(spark):
    (hits, _, skus, facets), _ = world(spark)
    hits = hits.where("query_id = 'q1'")

    def found(filters):
        requests = spark.createDataFrame([("q1", filters)], FILTERS)
        return {r.brand_sku_id for r in sl.filter_skus(hits, requests, skus, facets).collect()}

    one = found({"size": ["5"]})
    assert one <= found({"size": ["5", "7"]})
    assert found({"size": ["5"], "type": ["X"]}) <= one


def test_filter_products_has_weaker_rules(spark):
    skus = spark.createDataFrame(
        [("a", "ring", "1", "b", 1.0), ("b", "rod", "1", "b", 1.0), ("c", "ring", "1", "b", 1.0)], SKUS
    )
    facets = spark.createDataFrame(
        [("a", "type", "n/a", None, True), ("b", "type", None, "n/a", True), ("c", "size", "5", None, True),
         ("b", "price_range", "Under ₹100", None, True), ("a", "type", "n/a", None, True)],
        FACETS,
    )
    data = [("p", {"type": ["n/a"]}), ("q", {"price_range": ["Under ₹100"], "type": ["n/a"]}),
            ("r", {"size": []}), ("s", {"type": ["n/a"]}), ("t", {"type": ["N/A"]})]
    requests = spark.createDataFrame(data, FILTERS)
    assert rows_of(sl.filter_products(requests, skus, facets)) == [
        ("p", "ring"), ("p", "rod"), ("q", "rod"), ("s", "ring"), ("s", "rod")]
    names = spark.createDataFrame(
        [("p", "rod"), ("p", "Ring"), ("r", "x"), ("r", "x")], "query_id string, product_name string"
    )
    assert rows_of(sl.filter_products(requests, skus, facets, names)) == [
        ("p", "rod"), ("q", "rod"), ("r", "x"), ("r", "x"), ("s", "ring"), ("s", "rod")]


def test_sku_by_name_first_term_wins(spark):
    skus = spark.createDataFrame(
        [("a", "Red Ring", "1", "b", 1.0), ("b", "red ring", "2", "c", 1.0), ("c", "rod", "1", "b", 1.0)], SKUS
    )
    terms = spark.createDataFrame(
        [("q", 0, "Red ring"), ("q", 1, "red ring"), ("q", 2, "unknown"), ("q", 3, None), ("r", 5, "ROD")],
        "query_id string, pos int, term string",
    )
    assert rows_of(sl.sku_by_name(terms, skus), "query_id", "term", "brand_sku_id", "brand_id") == [
        ("q", "Red ring", "a", "1"), ("q", "Red ring", "b", "2"), ("r", "ROD", "c", "1")]


def options_world(spark):
    rows = [("q", f"s{i}", key, value, value, value)
            for key, value, n in [("size", "5", 3), ("size", "7", 3), ("size", "9", 4), ("type", "x", 2),
                                  ("zeta", "y", 10), ("price_range", "odd", 50)]
            for i in range(n)]
    rows += [("r", "s0", "price_range", "odd", "odd", "odd")]
    schema = "query_id string, brand_sku_id string, standard_key string, facet_value string, " \
             "original_value string, standard_value string"
    prices = [("q", "", "price_range", label, label, label, n, low, low + 1)
              for label, n, low in [("Above ₹5,000", 9, 5000.0), ("Under ₹100", 1, 0.0)]]
    return (
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(prices, schema + ", cnt bigint, min_price double, max_price double"),
    )


@pytest.mark.parametrize("spread", [False, True])
def test_option_and_key_order(spark, spread):
    rows, prices = options_world(spark)
    found = sl.facet_options(rows, prices, spread).orderBy("query_id", "facet_rank", "option_rank").collect()
    assert [(o.standard_key, o.option_rank, o.facet_value, o.cnt, o.total) for o in found if o.query_id == "q"] == [
        ("price_range", 1, "Under ₹100", 1, 10), ("price_range", 2, "Above ₹5,000", 9, 10),
        ("size", 1, "9", 4, 10), ("size", 2, "5", 3, 10), ("size", 3, "7", 3, 10),
        ("zeta", 1, "y", 10, 10), ("type", 1, "x", 2, 2),
    ]
    assert found[0].display_name == "Under ₹100 (1)" and found[2].display_name == "9"
    # a data key of that name stays where there are no price rows to replace it
    assert [(o.standard_key, o.facet_value) for o in found if o.query_id == "r"] == [("price_range", "odd")]


def test_key_orders(spark):
    rows, prices = options_world(spark)
    counts = sl.facet_counts(rows)
    by_total = sl.facet_key_order(counts, prices).where("query_id = 'q'").orderBy("facet_rank").collect()
    assert [(k.standard_key, k.total, k.n_options) for k in by_total] == [
        ("price_range", 10, 2), ("size", 10, 3), ("zeta", 10, 1), ("type", 2, 1)]
    by_name = sl.facet_key_order_alpha(counts, prices).where("query_id = 'q'").orderBy("facet_rank").collect()
    assert [k.standard_key for k in by_name] == ["price_range", "size", "type", "zeta"]


def test_shown_options_are_capped_and_counted(spark):
    rows, prices = options_world(spark)
    many = rows.where("standard_key = 'type'").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(22))))
    many = many.withColumn("facet_value", F.format_string("v%02d", "n")).drop("n")
    shown = sl.facet_top_options(rows.unionByName(many), prices).where("query_id = 'q'")
    per_key = {r.standard_key: (r.n, r.more) for r in shown.groupBy("standard_key").agg(
        F.count("*").alias("n"), F.max("n_more").alias("more")).collect()}
    assert per_key == {"type": (10, 14), "size": (3, 0), "zeta": (1, 0), "price_range": (2, 0)}


def test_bundle_pages_hold_every_row_in_order(spark):
    (hits, _, skus, facets), _ = world(spark)
    rows, prices = sl.facet_rows(hits, facets), sl.price_range_facets(hits, skus)
    flat = sl.facet_bundle_rows(rows, prices)
    with_prices = {r.query_id for r in prices.collect()}
    for r in flat.where("standard_key = 'price_range'").collect():
        assert (r.cnt is not None) == (r.query_id in with_prices)
    pages = sl.facet_bundle(rows, prices, page_rows=4).orderBy("query_id", "standard_key", "page").collect()
    assert all(1 <= len(p.rows) <= 4 for p in pages)
    seen = {}
    for p in pages:
        seen.setdefault((p.query_id, p.standard_key), []).extend(p.rows)
    assert sum(map(len, seen.values())) == flat.count()
    for (_, key), listed in seen.items():
        assert [r.row_no for r in listed] == list(range(1, len(listed) + 1))
        values = [r.facet_value for r in listed]
        assert key == "price_range" or values == sorted(values)


def test_spread_numbers_equal_window_numbers(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"),
        F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 97).alias("v"), "id",
    ).withColumn("g", F.when(F.col("id") % 400 == 1, F.lit(None)).otherwise(F.col("g")))
    order = [F.col("v").desc(), F.col("id")]
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert rows_of(spread_row_number(df, ["g"], order, "n"), "g", "v", "id", "n") == rows_of(plain)
