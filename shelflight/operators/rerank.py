"""Phonetic boost and the second ranking stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.operators.ranking import row_numbers


def boosted_score(dist, code, codes, boost):
    """``dist - boost`` for a non-empty code in the query's set, else ``dist``."""
    matches = (code != "") & F.array_contains(codes, code)
    return F.when(matches, dist - boost).otherwise(dist)


def phonetic_rerank(candidates: DataFrame, requests: DataFrame, spread: bool = False) -> DataFrame:
    """Score the pool and renumber it within each query.

    ``candidates``: ``query_id, row_id, dist, brand_phonetic, …`` (the pool was
    already cut by distance, so a phonetic match outside it cannot return);
    ``requests``: ``query_id, k, boost, codes``. Adds ``score``, ``boosted`` and
    ``rank``; equal scores keep the distance order. ``spread=True`` ranks pools of any
    width, no task holding a whole one.
    """
    scored = candidates.join(requests.select("query_id", "k", "boost", "codes"), "query_id")
    scored = scored.withColumn(
        "score",
        boosted_score(F.col("dist"), F.col("brand_phonetic"), F.col("codes"), F.col("boost")),
    )
    order = [F.col("score"), F.col("dist"), F.col("row_id")]
    return row_numbers(scored.drop("codes", "boost"), ["query_id"], order, "rank", spread)


def best_k(reranked: DataFrame) -> DataFrame:
    """The first ``k`` of each query; a negative ``k`` leaves out the last rows,
    as a list slice would."""
    cut_short = reranked.where(F.col("k") < 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    limit = F.when(F.col("k") >= 0, F.col("k").cast("long")).otherwise(F.col("_found") + F.col("k"))
    return (
        reranked.join(cut_short, "query_id", "left")
        .withColumn("_limit", limit)
        .where(F.col("rank") <= F.col("_limit"))
        .select(
            "query_id", "rank", "brand_sku_id", "label", "brandLabel", "category",
            "brand_phonetic", "score",
        )
    )
