"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

import shelflight as sl
from shelflight.functions.vector import squared_l2
from shelflight.settings import DEFAULT_K, DEFAULT_POOL, scratch_path
from workload.views import table, view, with_filters


# ---- inputs ---------------------------------------------------------------


def catalog(spark, sf):
    return sl.prepare_catalog(view(spark, sf, "catalog_raw"))


def index(spark, sf):
    """Stored vectors next to the lookup columns of their SKU."""
    vectors = table(spark, sf, "embeddings")
    vectors = vectors.select(F.col("vec_id").alias("row_id"), "embedding")
    raw = view(spark, sf, "catalog_raw").join(vectors.select("row_id"), "row_id", "left_semi")
    return sl.lookup_columns(sl.prepare_catalog(raw)).join(vectors, "row_id")


@lru_cache(maxsize=8)
def built_index(spark, sf):
    """The index that the library builds from every part, built once per session."""
    return sl.build_catalog_index(view(spark, sf, "catalog_raw"), scratch_path(spark, "index"))


def text_requests(spark, sf):
    """Requests as texts; the library embeds them."""
    return with_filters(view(spark, sf, "text_requests"))


EMBEDDER = sl.HashedNGrams()


def vector_requests(spark, sf):
    """The same with vectors, and every value filled in."""
    asked = sl.with_search_defaults(text_requests(spark, sf), DEFAULT_K, DEFAULT_POOL)
    return sl.embed_table(asked, "q", EMBEDDER, "qvec")


def skus(spark, sf):
    return view(spark, sf, "brand_sku")


def facets(spark, sf):
    return view(spark, sf, "brand_sku_facet")


def keys(spark, sf):
    return view(spark, sf, "facet_keys")


def lists(spark, sf):
    return view(spark, sf, "brand_lists")


def rows(spark, sf):
    return sl.facet_rows(lists(spark, sf), facets(spark, sf))


def prices(spark, sf):
    return sl.price_range_facets(lists(spark, sf), skus(spark, sf))


def counts(spark, sf):
    return sl.facet_counts(rows(spark, sf))


# ---- sources, sinks, projections ------------------------------------------


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "catalog-csv")
    view(spark, sf, "catalog_raw").orderBy("row_id").drop("row_id").write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return sl.scan_csv(spark, path)


def scan_csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a line break, quotes and a comma in every product name."""
    path = scratch_path(spark, "catalog-csv")
    tail = F.concat(F.lit('\n"'), F.col("brand_sku_id"), F.lit('",'))
    raw = view(spark, sf, "catalog_raw").withColumn("product_name", F.concat("product_name", tail))
    raw.orderBy("row_id").drop("row_id").write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return sl.scan_csv(spark, path, multi_line=True)


def catalog_head(spark, sf):
    return sl.catalog_head(view(spark, sf, "catalog_raw"), 100)


def catalog_normalize(spark, sf):
    return catalog(spark, sf).select(
        "row_id", "brand_sku_id", "product_name", "brand_name", "category_name"
    )


def search_text(spark, sf):
    return catalog(spark, sf).select("row_id", "search_text")


def lookup_export(spark, sf):
    return sl.lookup_export(sl.lookup_columns(catalog(spark, sf)))


def index_meta(spark, sf):
    return sl.index_meta(index(spark, sf), "stored")


def lookup_json(spark, sf):
    """The lookup artifact of a built index, read back."""
    path = scratch_path(spark, "index")
    sl.build_catalog_index(view(spark, sf, "catalog_raw"), path)
    schema = "row_id bigint, id string, label string, brandLabel string, category string, brand_phonetic string"
    return spark.read.schema(schema).json(f"{path}/lookup")


def meta_json(spark, sf):
    """The metadata artifact of a built index, read back."""
    path = scratch_path(spark, "index")
    sl.build_catalog_index(view(spark, sf, "catalog_raw"), path)
    schema = "num_items bigint, embedding_dim int, model string, index_type string"
    return spark.read.schema(schema).json(f"{path}/meta")


def vector_check(spark, sf):
    return sl.vector_check(table(spark, sf, "embeddings"))


def embed_catalog(spark, sf):
    """Non-zero vector elements of every row's search text."""
    embedded = sl.embed_table(
        catalog(spark, sf).select("row_id", "search_text"), "search_text", sl.HashedNGrams()
    )
    return embedded.select("row_id", F.posexplode("embedding").alias("dim", "weight")).where("weight <> 0")


def build_catalog_index(spark, sf):
    built = sl.build_catalog_index(view(spark, sf, "catalog_raw"), scratch_path(spark, "index"))
    return built.withColumn("dim", F.size("embedding")).drop("embedding")


def rebuild_catalog_index(spark, sf):
    """A second build, where a third of the products had other names in the first."""
    path, raw = scratch_path(spark, "builds"), view(spark, sf, "catalog_raw")
    before = F.when(F.col("row_id") % 3 == 0, F.lit("other")).otherwise(F.col("product_name"))
    sl.rebuild_catalog_index(raw.withColumn("product_name", before), path)
    built = sl.rebuild_catalog_index(raw, path)
    return built.withColumn("dim", F.size("embedding")).drop("embedding", "text_key")


# ---- search ---------------------------------------------------------------


def vector_distance(spark, sf):
    """Distance of every vector to the first vector of its label."""
    vectors = table(spark, sf, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return vectors.join(first, "label").select(
        "vec_id", squared_l2(F.col("embedding"), F.col("anchor")).alias("dist")
    )


def knn_candidates(spark, sf):
    return sl.knn_candidates(vector_requests(spark, sf), built_index(spark, sf).select("row_id", "embedding"))


def knn_candidates_blocks(spark, sf):
    """The same search with a batch far above what is shipped at once."""
    vectors = built_index(spark, sf).select("row_id", "embedding")
    return sl.knn_candidates(vector_requests(spark, sf), vectors, limit_bytes=10_000)


@lru_cache(maxsize=8)
def cell_index(spark, sf):
    """The built index's vectors in cells of about 500 rows."""
    vectors = built_index(spark, sf).select("row_id", "embedding")
    return sl.write_cells(vectors, scratch_path(spark, "cells"), cells=max(2, vectors.count() // 500))


def knn_cells(spark, sf):
    return sl.knn_in_cells(vector_requests(spark, sf), cell_index(spark, sf))


def knn_wide(spark, sf):
    """Every request by distributed selection, as if its pool were too wide for lists."""
    vectors = built_index(spark, sf).select("row_id", "embedding")
    return sl.knn_candidates(vector_requests(spark, sf), vectors, wide_pool=0)


def knn_whole_catalog(spark, sf):
    """Pools wider than the index: every row of a label's vectors is ranked."""
    vectors = table(spark, sf, "embeddings")
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qvec"))
    asked = first.select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("query_id"), F.lit(5).alias("k"),
        F.lit(1_000_000).alias("pool"), "qvec",
    )
    return sl.knn_candidates(asked, vectors.select(F.col("vec_id").alias("row_id"), "embedding"))


def knn_lookup(spark, sf):
    found = knn_candidates(spark, sf)
    return sl.attach_lookup(found, sl.lookup_columns(catalog(spark, sf)))


def brand_phonetic(spark, sf):
    return sl.brand_codes(catalog(spark, sf))


def query_phonetic(spark, sf):
    return text_requests(spark, sf).select("query_id", F.explode(sl.query_codes(F.col("q"))).alias("code"))


def brand_phonetic_double(spark, sf):
    return sl.brand_codes(catalog(spark, sf), sl.DOUBLE_METAPHONE)


def query_phonetic_double(spark, sf):
    codes = sl.query_codes(F.col("q"), sl.DOUBLE_METAPHONE)
    return text_requests(spark, sf).select("query_id", F.explode(codes).alias("code"))


@lru_cache(maxsize=8)
def double_index(spark, sf):
    """The index with the two-code encoder's brand codes."""
    return sl.build_catalog_index(
        view(spark, sf, "catalog_raw"), scratch_path(spark, "index"), phonetic=sl.DOUBLE_METAPHONE
    )


def hybrid_search_double(spark, sf):
    """From text to hits, boosted where a brand's code is one of a token's two codes."""
    return sl.hybrid_search(
        text_requests(spark, sf), double_index(spark, sf), EMBEDDER, phonetic=sl.DOUBLE_METAPHONE
    )


def phonetic_rerank(spark, sf):
    return sl.ranked_pool(text_requests(spark, sf), built_index(spark, sf), EMBEDDER).select(
        "query_id", "row_id", "brand_phonetic", "dist", "score", "rank"
    )


def hybrid_search(spark, sf):
    """From text to hits."""
    return sl.hybrid_search(text_requests(spark, sf), built_index(spark, sf), EMBEDDER)


def hit_report(spark, sf):
    return sl.hit_report(hybrid_search(spark, sf))


# ---- facets and prices ----------------------------------------------------


def facet_rows_ordered(spark, sf):
    return sl.in_facet_order(rows(spark, sf))


def facet_rows_ordered_nocase(spark, sf):
    """The same order by a collation that ignores case."""
    return sl.in_facet_order(rows(spark, sf), "UTF8_LCASE")


def facet_rows_active(spark, sf):
    return sl.facet_rows(lists(spark, sf), facets(spark, sf), keys(spark, sf), True)


def facet_totals(spark, sf):
    return sl.facet_totals(counts(spark, sf))


def facet_bundle_rows(spark, sf):
    return sl.facet_bundle_rows(rows(spark, sf), prices(spark, sf))


def facet_bundle(spark, sf):
    pages = sl.facet_bundle(rows(spark, sf), prices(spark, sf))
    return pages.select(
        "query_id", "standard_key", "page", F.size("rows").alias("n_rows"),
        F.array_join(F.transform("rows", lambda r: r["facet_value"]), "|").alias("facet_values"),
        F.array_join(F.transform("rows", lambda r: r["brand_sku_id"]), "|").alias("sku_ids"),
    )


def facet_options(spark, sf):
    return sl.facet_options(rows(spark, sf), prices(spark, sf), spread=True)


def facet_key_order(spark, sf):
    return sl.facet_key_order(counts(spark, sf), prices(spark, sf))


def facet_key_order_alpha(spark, sf):
    return sl.facet_key_order_alpha(counts(spark, sf), prices(spark, sf))


def facet_top_options(spark, sf):
    return sl.facet_top_options(rows(spark, sf), prices(spark, sf))


def facet_titles(spark, sf):
    return sl.facet_titles(counts(spark, sf), prices(spark, sf))


def facets_for_hits(spark, sf):
    """Options of each search's hits, each search with its own active-keys switch."""
    asked = text_requests(spark, sf)
    hits = hybrid_search(spark, sf).join(asked.select("query_id", "only_active"), "query_id")
    hits = sl.freeze(hits, "hits")
    return sl.facets_for_hits(
        hits, skus(spark, sf), facets(spark, sf), keys(spark, sf), "only_active", spread=False,
        small_hits=True,
    )


# ---- filters and lookups --------------------------------------------------


def filter_price(spark, sf):
    return sl.price_filter(skus(spark, sf), ["Under ₹100", "₹500 - ₹1,000", "Free of charge"]).select(
        "id", "consumerSellingPrice"
    )


def filter_skus(spark, sf):
    asked = with_filters(view(spark, sf, "supplier_requests"))
    return sl.filter_skus(
        view(spark, sf, "supplier_lists"), asked, skus(spark, sf), facets(spark, sf)
    )


@lru_cache(maxsize=8)
def facet_index(spark, sf):
    return sl.build_facet_index(skus(spark, sf), facets(spark, sf), scratch_path(spark, "facet-index"))


def filter_skus_indexed(spark, sf):
    """The same from the inverted index."""
    asked = with_filters(view(spark, sf, "supplier_requests"))
    return sl.filter_skus_indexed(view(spark, sf, "supplier_lists"), asked, facet_index(spark, sf))


def filter_products(spark, sf):
    asked = with_filters(view(spark, sf, "supplier_requests"))
    return sl.filter_products(asked, skus(spark, sf), facets(spark, sf))


def filter_products_indexed(spark, sf):
    """The same from the inverted index."""
    asked = with_filters(view(spark, sf, "supplier_requests"))
    return sl.filter_products_indexed(asked, facet_index(spark, sf))


def filter_products_named(spark, sf):
    """The same, limited to each supplier's own product names where it has a list."""
    asked = with_filters(view(spark, sf, "supplier_requests"))
    names = view(spark, sf, "supplier_names")
    return sl.filter_products(asked, skus(spark, sf), facets(spark, sf), names)


def knn_lookup_bucketed(spark, sf):
    """The pool joined with a lookup that stays where its buckets are."""
    name = "lookup_" + uuid.uuid4().hex
    sl.write_bucketed_lookup(sl.lookup_columns(catalog(spark, sf)), name, 8, scratch_path(spark, "bucketed-lookup"))
    return sl.attach_lookup(knn_candidates(spark, sf), spark.table(name))


def sku_by_name_collated(spark, sf):
    return sl.sku_by_name(view(spark, sf, "terms"), skus(spark, sf), "UTF8_LCASE")


def sku_by_name(spark, sf):
    return sl.sku_by_name(view(spark, sf, "terms"), skus(spark, sf))


def search_with_facets(spark, sf):
    return sl.search_with_facets(
        text_requests(spark, sf), built_index(spark, sf), skus(spark, sf), facets(spark, sf), EMBEDDER
    )


def search_with_facets_indexed(spark, sf):
    return sl.search_with_facets(
        text_requests(spark, sf), built_index(spark, sf), skus(spark, sf), facets(spark, sf), EMBEDDER,
        facet_index=facet_index(spark, sf),
    )


def result_totals(spark, sf):
    return sl.result_totals(text_requests(spark, sf), search_with_facets(spark, sf))


# ---- request ingest -------------------------------------------------------


def normalize_requests(spark, sf):
    parsed = sl.normalise_requests(view(spark, sf, "request_params"))
    entries = F.array_sort(F.map_entries("filters"))
    return parsed.select(
        "query_id", "q", "k", "only_active",
        F.array_join(
            F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))),
            ";",
        ).alias("filters"),
        "error",
    )


def facet_requests(spark, sf):
    """Hit lists and switches of facet requests, and the requests without any id."""
    params = view(spark, sf, "facet_params")
    named = sl.facet_request_hits(params).withColumn("error", F.lit(None).cast("string"))
    return named.unionByName(sl.rejected_facet_requests(params), allowMissingColumns=True)


def rejected_requests(spark, sf):
    return sl.rejected(sl.normalise_requests(view(spark, sf, "request_params")))


QUERIES = {
    "scan_csv": scan_csv,
    "scan_csv_multiline": scan_csv_multiline,
    "catalog_head": catalog_head,
    "catalog_normalize": catalog_normalize,
    "search_text": search_text,
    "lookup_export": lookup_export,
    "index_meta": index_meta,
    "lookup_json": lookup_json,
    "meta_json": meta_json,
    "vector_check": vector_check,
    "embed_catalog": embed_catalog,
    "build_catalog_index": build_catalog_index,
    "rebuild_catalog_index": rebuild_catalog_index,
    "vector_distance": vector_distance,
    "knn_candidates": knn_candidates,
    "knn_candidates_blocks": knn_candidates_blocks,
    "knn_cells": knn_cells,
    "knn_wide": knn_wide,
    "knn_whole_catalog": knn_whole_catalog,
    "knn_lookup": knn_lookup,
    "knn_lookup_bucketed": knn_lookup_bucketed,
    "brand_phonetic": brand_phonetic,
    "query_phonetic": query_phonetic,
    "brand_phonetic_double": brand_phonetic_double,
    "query_phonetic_double": query_phonetic_double,
    "hybrid_search_double": hybrid_search_double,
    "phonetic_rerank": phonetic_rerank,
    "hybrid_search": hybrid_search,
    "hit_report": hit_report,
    "facet_rows": rows,
    "facet_rows_ordered": facet_rows_ordered,
    "facet_rows_ordered_nocase": facet_rows_ordered_nocase,
    "facet_rows_active": facet_rows_active,
    "facet_counts": counts,
    "facet_totals": facet_totals,
    "price_range_facets": prices,
    "facet_bundle_rows": facet_bundle_rows,
    "facet_bundle": facet_bundle,
    "facet_options": facet_options,
    "facet_key_order": facet_key_order,
    "facet_key_order_alpha": facet_key_order_alpha,
    "facet_top_options": facet_top_options,
    "facet_titles": facet_titles,
    "facets_for_hits": facets_for_hits,
    "filter_price": filter_price,
    "filter_skus": filter_skus,
    "filter_skus_indexed": filter_skus_indexed,
    "search_with_facets_indexed": search_with_facets_indexed,
    "filter_products": filter_products,
    "filter_products_indexed": filter_products_indexed,
    "filter_products_named": filter_products_named,
    "sku_by_name": sku_by_name,
    "sku_by_name_collated": sku_by_name_collated,
    "normalize_requests": normalize_requests,
    "rejected_requests": rejected_requests,
    "facet_requests": facet_requests,
    "search_with_facets": search_with_facets,
    "result_totals": result_totals,
}
