"""Product name -> SKU lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.functions.text import collated


def sku_by_name(terms: DataFrame, skus: DataFrame, collation: str | None = None) -> DataFrame:
    """SKUs whose label equals a term, ignoring case, or by one of Spark's collations.

    ``terms``: ``query_id, pos, term``. When terms of a request differ only in
    case (or are equal by the collation), the first one receives the rows. Terms are
    reduced to one for each such text before they meet the SKUs.
    """
    folded = (lambda c: collated(F.col(c), collation)) if collation else F.lower
    first = (
        terms.where(F.col("term").isNotNull())
        .groupBy("query_id", folded("term").alias("_folded"))
        .agg(F.min_by("term", "pos").alias("term"))
    )
    return (
        skus.withColumn("_folded", folded("label"))
        .join(first, "_folded")
        .select(
            "query_id",
            "term",
            F.col("id").alias("brand_sku_id"),
            F.col("label").alias("brand_sku_label"),
            F.col("brandId").alias("brand_id"),
            F.col("brandLabel").alias("brand_name"),
            F.col("label").alias("product_name"),
        )
    )
