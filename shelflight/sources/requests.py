"""Request ingest: rows of raw parameters -> typed request and hit tables.

``params`` has one row per parameter: ``query_id, pos, name, value``, where
``pos`` is the position within the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflight.functions.text import strip
from shelflight.settings import DEFAULT_BOOST, FACETED_K, FACETED_POOL, REQUEST_K

_PREFIX = "facet_"

# Messages of rejected requests; the first and the last are fixed values.
NO_QUERY = "No search query provided"
BAD_K = "k is not an integer"
NO_IDS = "No brand_sku_ids provided"


def _first(name: str) -> Column:
    """Value of the first parameter of that name."""
    return F.min(F.when(F.col("name") == name, F.struct("pos", "value")))["value"]


def _is_true(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def _filters(entries: Column) -> Column:
    """Sorted (pos, key, value) entries -> key -> non-blank values. A key whose
    values are all blank stays with an empty list."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    values = F.transform(
        keys,
        lambda key: F.transform(
            F.filter(entries, lambda e: (e["key"] == key) & (strip(e["value"]) != "")),
            lambda e: e["value"],
        ),
    )
    return F.map_from_arrays(keys, values)


def normalise_requests(params: DataFrame) -> DataFrame:
    """``query_id, q, k, only_active, filters, error``; ``error`` is null for
    requests that can be searched. A parameter list is one web request, so what
    is gathered per request is small."""
    entry = F.struct(
        "pos",
        F.substring("name", len(_PREFIX) + 1, 1 << 30).alias("key"),
        F.coalesce("value", F.lit("")).alias("value"),
    )
    gathered = params.groupBy("query_id").agg(
        strip(F.coalesce(_first("q"), F.lit(""))).alias("q"),
        strip(_first("k")).alias("raw_k"),
        _is_true(_first("active_facets")).alias("only_active"),
        F.array_sort(F.collect_list(F.when(F.col("name").startswith(_PREFIX), entry))).alias("entries"),
    )
    integer = F.col("raw_k").rlike(r"^[+-]?\d+(_?\d+)*$")
    k = F.when(F.col("raw_k").isNull(), F.lit(REQUEST_K).cast("long")).when(
        integer, F.regexp_replace("raw_k", "_", "").try_cast("long")
    )
    return gathered.withColumn("k", k).select(
        "query_id",
        "q",
        "k",
        "only_active",
        _filters(F.col("entries")).alias("filters"),
        F.when(F.col("k").isNull(), F.lit(BAD_K)).when(F.col("q") == "", F.lit(NO_QUERY)).alias("error"),
    )


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("error").isNull()).drop("error")


def rejected(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("error").isNotNull()).select("query_id", "error")


def with_search_defaults(
    requests: DataFrame, k: int = FACETED_K, pool: int = FACETED_POOL, boost: float = DEFAULT_BOOST
) -> DataFrame:
    """Fill in what the faceted search uses where a request names no value."""
    for name, default in (("k", k), ("pool", pool), ("boost", boost)):
        given = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(given, F.lit(default)))
    return requests


def filter_rows(requests: DataFrame) -> DataFrame:
    """Filters in long form; a key without values gives one row with a null."""
    return requests.select("query_id", F.explode("filters").alias("standard_key", "accepted")).select(
        "query_id", "standard_key", F.explode_outer("accepted").alias("facet_value")
    )


def facet_request_hits(params: DataFrame) -> DataFrame:
    """``query_id, brand_sku_id, only_active`` of facet requests."""
    strict = params.groupBy("query_id").agg(_is_true(_first("active_facets")).alias("only_active"))
    ids = params.where(F.col("name") == "brand_sku_ids")
    return ids.select("query_id", F.col("value").alias("brand_sku_id")).join(strict, "query_id")


def rejected_facet_requests(params: DataFrame) -> DataFrame:
    """Facet requests without any id."""
    named = params.groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.col("name") == "brand_sku_ids"), F.lit(False)).alias("has_ids")
    )
    return named.where(~F.col("has_ids")).select("query_id", F.lit(NO_IDS).alias("error"))
