"""Filters answered from an inverted index: a bitmap of SKU numbers for each key and value.

The index is built once from the catalog: SKUs are numbered, and every (key, value) has
one bitmap for each 32,768 numbers in which it occurs, by Spark's bitmap functions. A
filter map is evaluated once, however many requests use it: the bitmaps of a key's values
are joined by OR, those of its keys by AND. A hit is then one bit of one bitmap, so a call
neither writes nor groups the catalog's attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelflight.operators.facets import usable_facets
from shelflight.operators.filters import _wanted, filter_sets, named_products
from shelflight.operators.prices import price_labels
from shelflight.operators.ranking import small_side, spread_row_number
from shelflight.settings import PRICE_KEY

SKU_RULE, PRODUCT_RULE = "sku", "product"


@dataclass(frozen=True)
class FacetIndex:
    """``numbers``: ``brand_sku_id, number, label``; ``bitmaps``: ``rule, standard_key,
    facet_value, bucket, bitmap``. Rule ``sku`` holds usable values and price labels,
    rule ``product`` all active values."""

    numbers: DataFrame
    bitmaps: DataFrame


def build_facet_index(skus: DataFrame, facets: DataFrame, path: str) -> FacetIndex:
    """Number the SKUs, gather the bitmaps of their usable facets and price labels, write
    both below ``path`` and return the index as read back. Facets of ids that no SKU has
    are left out: a restricted filter never returns such ids."""
    ids = skus.where(F.col("id").isNotNull()).select(F.col("id").alias("brand_sku_id"), "label").distinct()
    one = spread_row_number(
        ids.withColumn("_all", F.lit(1)), ["_all"], [F.col("brand_sku_id"), F.col("label")], "number"
    )
    one.select("brand_sku_id", F.col("number").cast("long").alias("number"), "label").write.parquet(f"{path}/numbers")
    numbers = read_facet_index(skus.sparkSession, path, with_bitmaps=False).numbers

    pairs = ["brand_sku_id", "standard_key", "facet_value"]
    usable = usable_facets(facets).where(F.col("standard_key") != PRICE_KEY).select(F.lit(SKU_RULE).alias("rule"), *pairs)
    priced = price_labels(skus).where(F.col("price_label").isNotNull()).select(
        F.lit(SKU_RULE).alias("rule"), F.col("id").alias("brand_sku_id"), F.lit(PRICE_KEY).alias("standard_key"),
        F.col("price_label").alias("facet_value"),
    )
    active = facets.where(F.col("isActive")).select(
        F.lit(PRODUCT_RULE).alias("rule"), F.col("brandSKUId").alias("brand_sku_id"),
        F.col("standardKey").alias("standard_key"), F.coalesce("standardValue", "value").alias("facet_value"),
    ).where(F.col("standard_key").isNotNull() & F.col("facet_value").isNotNull())
    held = usable.unionByName(priced).unionByName(active).join(numbers, "brand_sku_id")
    place = ["rule", "standard_key", "facet_value", "bucket"]
    bitmaps = held.withColumn("bucket", F.bitmap_bucket_number("number")).groupBy(*place).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")
    )
    bitmaps.repartitionByRange(*place).sortWithinPartitions(*place).write.parquet(f"{path}/bitmaps")
    return read_facet_index(skus.sparkSession, path)


def read_facet_index(spark: SparkSession, path: str, with_bitmaps: bool = True) -> FacetIndex:
    numbers = spark.read.schema("brand_sku_id string, number long, label string").parquet(f"{path}/numbers")
    if not with_bitmaps:
        return FacetIndex(numbers, numbers.limit(0))
    return FacetIndex(numbers, spark.read.schema(
        "rule string, standard_key string, facet_value string, bucket long, bitmap binary"
    ).parquet(f"{path}/bitmaps"))


def _bit(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def matching_skus(sets: DataFrame, index: FacetIndex, rule: str = SKU_RULE) -> DataFrame:
    """``set_no, bucket, bitmap`` of the SKUs that meet each filter map by a rule; ``sets``
    has ``set_no`` and ``conditions``."""
    pairs = ["standard_key", "facet_value"]
    wanted = _wanted(sets, "set_no")
    by_key = index.bitmaps.where(F.col("rule") == rule).join(small_side(wanted), pairs).groupBy("set_no", "standard_key", "bucket").agg(
        F.bitmap_or_agg("bitmap").alias("bitmap")
    )
    keys = sets.select("set_no", F.size("conditions").alias("_keys"))
    return (
        by_key.groupBy("set_no", "bucket")
        .agg(F.count(F.lit(1)).alias("_met"), F.bitmap_and_agg("bitmap").alias("bitmap"))
        .join(keys, "set_no").where(F.col("_met") == F.col("_keys"))
        .where(F.bitmap_count("bitmap") > 0).select("set_no", "bucket", "bitmap")
    )


def filter_skus_indexed(hits: DataFrame, requests: DataFrame, index: FacetIndex, small_hits: bool = False) -> DataFrame:
    """The rows of ``filter_skus``, from an index.

    A request without any usable condition passes its ids on unchanged; otherwise ids are
    distinct and known SKUs. ``small_hits`` says that the lists are expected to be small:
    they are counted, and within the limit the numbers are looked up in place.
    """
    sets, numbered = filter_sets(requests, price_aware=True)
    numbered = numbered.where(F.col("set_no").isNotNull())
    hits = hits.select("query_id", "brand_sku_id")
    untouched = hits.join(numbered.select("query_id"), "query_id", "left_anti")
    listed = hits.distinct().join(numbered, "query_id")
    known = index.numbers.select("brand_sku_id", "number")
    placed = known.join(small_side(listed) if small_hits else listed, "brand_sku_id").select(
        "query_id", "brand_sku_id", "set_no", F.bitmap_bucket_number("number").alias("bucket"),
        F.bitmap_bit_position("number").alias("position"),
    )
    met = placed.join(matching_skus(sets, index), ["set_no", "bucket"]).where(_bit(F.col("bitmap"), F.col("position")))
    return met.select("query_id", "brand_sku_id").distinct().unionByName(untouched)


def filter_products_indexed(requests: DataFrame, index: FacetIndex, names: DataFrame | None = None) -> DataFrame:
    """The rows of ``filter_products``, from an index.

    The numbers are read once, where they lie, past the bitmaps of the distinct filter
    maps; nothing of the catalog's facets is read.
    """
    sets, numbered = filter_sets(requests, price_aware=False)
    matched = matching_skus(sets, index, PRODUCT_RULE)
    placed = index.numbers.where(F.col("label").isNotNull()).select(
        F.col("label").alias("product_name"), F.bitmap_bucket_number("number").alias("bucket"),
        F.bitmap_bit_position("number").alias("position"),
    )
    met = placed.join(matched, "bucket").where(_bit(F.col("bitmap"), F.col("position")))
    return named_products(numbered, met.select("set_no", "product_name").distinct(), names)
