"""Order and equality by collation, and a lookup that joins where its buckets are."""

import uuid

import pytest
from pyspark.sql import functions as F

import shelflight as sl
from tests.conftest import rows_of

ROWS = "query_id string, brand_sku_id string, standard_key string, facet_value string, original_value string, standard_value string"


def facet_rows(spark):
    values = ["b", "A", "a", "B", "É", "e", "Z", "z", "ä"]
    rows = [("q", f"s{i}", key, v, v, None) for key in ("size", "Type", "brand") for i, v in enumerate(values)]
    return spark.createDataFrame([*rows, *rows[:3], ("r", "s1", "size", "x", "x", "x")], ROWS)


@pytest.mark.parametrize("collation", [None, "UTF8_LCASE", "UNICODE", "UNICODE_CI"])
@pytest.mark.parametrize("spread", [True, False])
def test_positions_follow_the_collation(spark, collation, spread):
    found = sl.in_facet_order(facet_rows(spark), collation, spread)
    q = found.where("query_id = 'q'").orderBy("position").collect()
    assert [r.position for r in q] == list(range(1, 31))
    keys = list(dict.fromkeys(r.standard_key for r in q))
    assert keys == (["Type", "brand", "size"] if collation is None else ["brand", "size", "Type"])
    values = list(dict.fromkeys(r.facet_value for r in q if r.standard_key == "brand"))
    expected = {
        None: ["A", "B", "Z", "a", "b", "e", "z", "É", "ä"],
        "UTF8_LCASE": ["A", "a", "b", "B", "e", "Z", "z", "ä", "É"],
        "UNICODE": ["a", "A", "ä", "b", "B", "e", "É", "z", "Z"],
        "UNICODE_CI": ["A", "a", "ä", "b", "B", "e", "É", "Z", "z"],
    }[collation]
    assert values == expected


def test_names_equal_by_collation(spark):
    skus = spark.createDataFrame(
        [("1", "Café", "b", "B"), ("2", "cafe", "b", "B"), ("3", "CAFÉ", "b", "B")], "id string, label string, brandId string, brandLabel string"
    )
    terms = spark.createDataFrame([("q", 1, "CAFÉ"), ("q", 0, "café"), ("q", 2, None)], "query_id string, pos int, term string")
    ids = lambda c: rows_of(sl.sku_by_name(terms, skus, c), "term", "brand_sku_id")
    assert ids(None) == ids("UNICODE_CI") == ids("UTF8_LCASE") == [("café", "1"), ("café", "3")]
    assert ids("UNICODE_AI") == [("CAFÉ", "3"), ("café", "2")]
    assert {i for _, i in ids("UNICODE_CI_AI")} == {"1", "2", "3"}


def test_options_and_keys_by_collation(spark):
    rows = facet_rows(spark)
    prices = spark.createDataFrame([], "query_id string, standard_key string, facet_value string, cnt long, min_price double, max_price double")
    for spread in (True, False):
        options = sl.facet_options(rows, prices, spread, "UTF8_LCASE").where("query_id = 'q' and standard_key = 'brand'")
        assert [r.facet_value for r in options.orderBy("option_rank").collect()] == ["A", "a", "B", "b", "e", "Z", "z", "ä", "É"]
    keys = sl.facet_key_order_alpha(sl.facet_counts(rows), prices, "UTF8_LCASE").where("query_id = 'q'")
    assert [r.standard_key for r in keys.orderBy("facet_rank").collect()] == ["brand", "size", "Type"]


def test_bucketed_lookup_is_not_moved(spark, tmp_path):
    lookup = spark.range(5000).select(F.col("id").alias("row_id"), F.format_string("label %d", "id").alias("label"))
    name = "lookup_" + uuid.uuid4().hex
    sl.write_bucketed_lookup(lookup, name, 4, f"{tmp_path}/lookup")
    pool = spark.range(0, 20_000, 3).select((F.col("id") % 6000).alias("row_id"), F.col("id").alias("query_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = sl.attach_lookup(pool, spark.table(name))
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        final = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and final.count("Exchange hashpartitioning(row_id") == 1
        scan = final[final.index("FileScan parquet spark_catalog"):]
        assert "SelectedBucketsCount: 4 out of 4" in scan
        assert rows_of(joined) == rows_of(pool.join(lookup, "row_id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
