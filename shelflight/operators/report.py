"""Delivery forms of hit lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.functions.text import or_not_available


def hit_report(hits: DataFrame) -> DataFrame:
    """Report rows: position, score to four decimals, labels with fallbacks.

    ``score_text`` always shows a number; ``score_label`` shows ``N/A`` for a
    zero or missing score, as the page does.
    """
    text = F.format_string("%.4f", F.col("score"))
    return hits.select(
        "query_id",
        "rank",
        F.when(F.col("score").isNotNull(), text).alias("score_text"),
        F.when(F.col("score").isNull() | (F.col("score") == 0), F.lit("N/A"))
        .otherwise(text)
        .alias("score_label"),
        or_not_available(F.col("brandLabel")).alias("brand"),
        or_not_available(F.col("label")).alias("product"),
        or_not_available(F.col("category")).alias("category"),
    )


def result_totals(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits left per request, zero included."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    return requests.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("total_results", F.lit(0)).cast("long").alias("total_results")
    )
