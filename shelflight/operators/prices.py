"""Price histogram and price filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.functions.price import (
    LABELS, bucket_label, bucket_max, bucket_min, bucket_number, in_price_window,
)
from shelflight.operators.ranking import small_side
from shelflight.settings import PRICE_KEY


def price_range_facets(hits: DataFrame, skus: DataFrame, small_hits: bool = False) -> DataFrame:
    """Non-empty price buckets of each hit list, in facet-row shape.

    Counts are combined per bucket number before the shuffle; labels and bounds
    are attached to the few rows that remain. ``small_hits`` says that the
    lists are expected to be small: they are counted, and within the limit SKUs
    need no shuffle.
    """
    listed = hits.select("query_id", F.col("brand_sku_id").alias("id")).distinct()
    if small_hits:
        listed = small_side(listed)
    counted = (
        skus.where(in_price_window(F.col("consumerSellingPrice")))
        .select("id", bucket_number(F.col("consumerSellingPrice")).alias("bucket"))
        .join(listed, "id")
        .groupBy("query_id", "bucket")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    label = bucket_label(F.col("bucket"))
    return counted.select(
        "query_id",
        F.lit("").alias("brand_sku_id"),
        F.lit(PRICE_KEY).alias("standard_key"),
        label.alias("facet_value"),
        label.alias("original_value"),
        label.alias("standard_value"),
        "cnt",
        bucket_min(F.col("bucket")).alias("min_price"),
        bucket_max(F.col("bucket")).alias("max_price"),
    )


def price_filter(skus: DataFrame, labels: list[str]) -> DataFrame:
    """SKUs inside any of the labelled ranges. Unknown labels are ignored, and
    with none left every SKU stays. There is no price window here: prices at or
    below 0 are in the first range, 100000 and above in the last."""
    known = [label for label in labels if label in LABELS]
    if not known:
        return skus
    chosen = bucket_number(F.col("consumerSellingPrice"))
    return skus.where(chosen.isin(*[LABELS.index(label) for label in known]))


def price_labels(skus: DataFrame) -> DataFrame:
    """``id, price_label`` of every SKU, without the window; null without a price."""
    label = bucket_label(bucket_number(F.col("consumerSellingPrice")))
    return skus.select("id", label.alias("price_label"))
