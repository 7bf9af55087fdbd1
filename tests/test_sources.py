"""Readers, request ingest, index build."""

import json
import os

import pytest
from pyspark.sql import functions as F

import shelflight as sl
from shelflight.settings import scratch_path
from tests.conftest import rows_of

RAW = "row_id bigint, brand_sku_id string, product_name string, brand_name string, category_name string"


def write(path, *lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_scan_csv_numbers_rows_over_files(spark, tmp_path):
    header = "brand_sku_id,product_name,brand_name,category_name,extra"
    write(str(tmp_path / "in" / "a.csv"), header, '007,"Ring, ""big""",NA,tools,1', "2, rod ,Acme,null,2")
    write(str(tmp_path / "in" / "b.csv"), header, "x9,,None,c,3")
    found = sl.scan_csv(spark, str(tmp_path / "in")).orderBy("row_id").collect()
    assert [tuple(r)[:5] for r in found] == [
        (0, "007", 'Ring, "big"', None, "tools"), (1, "2", " rod ", "Acme", None), (2, "x9", None, None, "c")]
    assert sl.scan_csv(spark, str(tmp_path / "in"), max_rows=2).count() == 2
    assert sl.scan_csv(spark, str(tmp_path / "in"), max_rows=0).count() == 3


def test_scan_csv_numbers_rows_over_splits(spark, tmp_path):
    lines = [f"{i},product {i},brand,cat" for i in range(5000)]
    write(str(tmp_path / "in" / "a.csv"), "brand_sku_id,product_name,brand_name,category_name", *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = sl.scan_csv(spark, str(tmp_path / "in"))
        assert found.where(F.col("row_id").cast("string") != F.col("brand_sku_id")).count() == 0
        assert found.select("row_id").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_scan_csv_with_line_breaks(spark, tmp_path):
    write(str(tmp_path / "in" / "a.csv"), "brand_sku_id,product_name,brand_name,category_name",
          '1,"two\nlines",b,c', "2,p,b,c")
    found = sl.scan_csv(spark, str(tmp_path / "in"), multi_line=True).orderBy("row_id").collect()
    assert [(r.row_id, r.product_name) for r in found] == [(0, "two\nlines"), (1, "p")]


HEADER = "brand_sku_id,product_name,brand_name,category_name"


@pytest.mark.parametrize("multi_line", [False, True])
@pytest.mark.parametrize("bad", ["1,p,b,c,extra", "1,p,b"])
def test_scan_csv_refuses_rows_of_another_length(spark, tmp_path, bad, multi_line):
    write(str(tmp_path / "in" / "a.csv"), HEADER, "0,p,b,c", bad)
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        sl.scan_csv(spark, str(tmp_path / "in"), multi_line=multi_line).select("product_name").collect()


@pytest.mark.parametrize("multi_line", [False, True])
def test_scan_csv_refuses_another_header(spark, tmp_path, multi_line):
    write(str(tmp_path / "in" / "a.csv"), HEADER, "0,p,b,c")
    write(str(tmp_path / "in" / "b.csv"), "product_name,brand_sku_id,brand_name,category_name", "p,1,b,c")
    with pytest.raises(Exception, match="header"):
        sl.scan_csv(spark, str(tmp_path / "in"), multi_line=multi_line).collect()


@pytest.mark.parametrize("second", ["y\",b,c", "y\",b,c,\"z\",d"])
def test_scan_csv_refuses_unannounced_line_breaks(spark, tmp_path, second):
    write(str(tmp_path / "in" / "a.csv"), HEADER, '1,"x', second)
    with pytest.raises(Exception, match="multi_line=True"):
        sl.scan_csv(spark, str(tmp_path / "in")).collect()


def test_scan_csv_skips_blank_lines_and_header_only_files(spark, tmp_path):
    write(str(tmp_path / "in" / "a.csv"), HEADER, "", "0,p,b,c", "  ", "1,q,b,c")
    write(str(tmp_path / "in" / "b.csv"), HEADER)
    write(str(tmp_path / "in" / "c.csv"), HEADER, "2,r,b,c")
    found = sl.scan_csv(spark, str(tmp_path / "in"))
    assert rows_of(found, "row_id", "brand_sku_id") == [(0, "0"), (1, "1"), (2, "2")]


def test_required_columns(spark, tmp_path):
    write(str(tmp_path / "in" / "a.csv"), "product_name,brand_name", "p,b")
    with pytest.raises(ValueError, match=r"\['brand_sku_id', 'category_name'\]"):
        sl.scan_csv(spark, str(tmp_path / "in"))


def test_catalog_head(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id").repartition(5)
    assert [r.row_id for r in sl.catalog_head(df, 3).orderBy("row_id").collect()] == [0, 1, 2]
    assert sl.catalog_head(df, None).count() == sl.catalog_head(df, 0).count() == 50
    assert sl.catalog_head(df, 99).count() == 50
    assert sl.catalog_head(df, 30).rdd.getNumPartitions() > 1
    sparse = df.selectExpr("row_id * 7 - 20 as row_id", "'x' as other")
    assert rows_of(sl.catalog_head(sparse, 3)) == [(-13, "x"), (-20, "x"), (-6, "x")]
    assert sl.catalog_head(df.where("row_id < 0"), 3).count() == 0


def test_prepared_catalog(spark):
    raw = spark.createDataFrame([(0, None, " Ring ", None, "Tools"), (1, "5 ", "", "ACME", " ")], RAW)
    first, second = sl.prepare_catalog(raw).orderBy("row_id").collect()
    assert (first.brand_sku_id, first.search_text, first.brand_phonetic) == ("nan", "nan ring tools", "NN")
    # an empty middle part keeps its spaces
    assert (second.search_text, second.brand_sku_id) == ("acme", "5 ")
    assert sl.lookup_columns(sl.prepare_catalog(raw)).orderBy("row_id").collect()[1].brand_sku_id == "5"
    blank = sl.prepare_catalog(raw, null_text="").orderBy("row_id").first()
    assert blank.search_text == "ring tools"


def lines_of(path):
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return [line for f in files for line in open(os.path.join(path, f), encoding="utf-8").read().splitlines()]


def test_index_build_writes_index_lookup_and_meta(spark):
    raw = spark.createDataFrame(
        [(i, str(i), f"Ring {i}", "Crème", "tools") for i in range(30)], RAW
    ).repartition(4)
    path = scratch_path(spark, "test-index")
    index = sl.build_catalog_index(raw, path, max_rows=20)
    assert index.count() == 20 and sl.vector_check(index).first().consistent
    lookup = lines_of(f"{path}/lookup")
    assert [json.loads(line)["row_id"] for line in lookup] == list(range(20))
    assert "crème" in lookup[0]
    assert json.loads(lookup[3]) == {
        "row_id": 3, "id": "3", "label": "ring 3", "brandLabel": "crème", "category": "tools",
        "brand_phonetic": "KRM"}
    assert json.loads(lines_of(f"{path}/meta")[0]) == {
        "num_items": 20, "embedding_dim": 64, "model": "hashed-ngrams", "index_type": "exact_l2"}
    assert rows_of(sl.read_index(spark, f"{path}/index")) == rows_of(index)


def test_vector_check(spark):
    schema = "row_id int, embedding array<float>"
    odd = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)
    lacking = spark.createDataFrame([(1, [1.0]), (2, None)], schema)
    for df in (odd, lacking):
        with pytest.raises(ValueError):
            sl.require_consistent_vectors(df)
    empty = spark.createDataFrame([], schema)
    sl.require_consistent_vectors(empty)
    assert tuple(sl.index_meta(empty, "m").first())[:2] == (0, 0)


def test_embedding_needs_text_and_keeps_identity(spark):
    df = spark.createDataFrame([(i, ("aaa", "bbbb")[i % 2]) for i in range(40)], "row_id int, t string")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def embed(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    found = sl.embed_table(df, "t", sl.ModelEmbedder(load)).collect()
    assert all(r.embedding == [float(len(r.t)), 1.0] for r in found) and len(found) == 40
    assert calls.value == 2  # each distinct text once
    assert sl.embed_table(df.where("row_id < 0"), "t", sl.ModelEmbedder(load)).count() == 0
    for text in ("", None):
        bad = spark.createDataFrame([(1, text)], "row_id int, t string")
        with pytest.raises(Exception, match="non-empty"):
            sl.embed_table(bad, "t", sl.HashedNGrams()).collect()
    uneven = sl.ModelEmbedder(lambda: lambda texts: [[1.0] * len(t) for t in texts])
    with pytest.raises(Exception, match="expected"):
        sl.embed_table(df.coalesce(1), "t", uneven).coalesce(1).collect()


def params(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, pos int, name string, value string")


def test_requests_are_parsed(spark):
    df = params(
        spark,
        ("a", 0, "q", "  Red ring "), ("a", 1, "facet_size", "5"), ("a", 2, "facet_size", " "),
        ("a", 3, "facet_size", "7 "), ("a", 4, "facet_type", ""), ("a", 5, "active_facets", "TRUE"),
        ("a", 6, "other", "x"), ("a", 7, "q", "second"),
        ("b", 0, "q", " \t"), ("b", 1, "k", "5"),
        ("c", 0, "q", "x"), ("c", 1, "k", "five"),
        ("d", 0, "q", "x"), ("d", 1, "k", " -1_0 "), ("d", 2, "active_facets", "true "),
        ("e", 0, "k", "3"),
    )
    parsed = sl.normalise_requests(df)
    by_id = {r.query_id: r for r in parsed.collect()}
    a = by_id["a"]
    assert (a.q, a.k, a.only_active, a.error) == ("Red ring", 50, True, None)
    assert a.filters == {"size": ["5", "7 "], "type": []}
    assert (by_id["d"].k, by_id["d"].only_active, by_id["d"].filters) == (-10, False, {})
    assert {r.query_id for r in sl.accepted(parsed).collect()} == {"a", "d"}
    assert rows_of(sl.rejected(parsed)) == [
        ("b", "No search query provided"), ("c", "k is not an integer"), ("e", "No search query provided")]
    assert rows_of(sl.filter_rows(sl.accepted(parsed))) == [("a", "size", "5"), ("a", "size", "7 "), ("a", "type", None)]


def test_facet_requests(spark):
    df = params(spark, ("a", 0, "brand_sku_ids", "1"), ("a", 1, "brand_sku_ids", "2"),
                ("a", 2, "active_facets", "true"), ("b", 0, "facet_size", "5"))
    assert rows_of(sl.facet_request_hits(df)) == [("a", "1", True), ("a", "2", True)]
    assert rows_of(sl.rejected_facet_requests(df)) == [("b", "No brand_sku_ids provided")]


def test_search_defaults_fill_gaps_only(spark):
    df = spark.createDataFrame([("a", None), ("b", 7)], "query_id string, k int")
    assert rows_of(sl.with_search_defaults(df)) == [("a", 20, 100, 0.2), ("b", 7, 100, 0.2)]


def test_tables_by_path(spark, sf):
    assert sl.read_table(spark, f"{sf}/part.parquet", "parquet").count() == 200
