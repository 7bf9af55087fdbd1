"""Facet rows, counts, totals, ordering and bundles of hit lists.

Facets stay long (one row per SKU, key and value): keys are data. Counting is
split between map and reduce side, so a value that holds most rows costs one
partial count per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflight.functions.text import collated, facet_title, is_usable
from shelflight.operators.ranking import row_numbers, small_side
from shelflight.settings import PRICE_KEY
from shelflight.sources.sinks import freeze

# Options shown per key before "and N more" (fixed values).
OPTION_CAP = 10
PRICE_OPTION_CAP = 20


def usable_facets(facets: DataFrame) -> DataFrame:
    """Active facet rows with a key and a usable value."""
    value = F.coalesce("standardValue", "value")
    return facets.where(F.col("isActive") & F.col("standardKey").isNotNull() & is_usable(value)).select(
        F.col("brandSKUId").alias("brand_sku_id"),
        F.col("standardKey").alias("standard_key"),
        value.alias("facet_value"),
        F.col("value").alias("original_value"),
        F.col("standardValue").alias("standard_value"),
    )


def facet_rows(
    hits: DataFrame,
    facets: DataFrame,
    keys: DataFrame | None = None,
    only_active: bool | str = False,
    small_hits: bool = False,
) -> DataFrame:
    """Usable facet rows of every hit list; a repeated id counts once.

    ``only_active`` limits rows to active keys of ``keys``: for all lists
    (``True``) or per list, by the name of a boolean column of ``hits``.
    ``small_hits`` says that the lists are expected to be small: they are counted,
    and within the limit facets are filtered in place and not shuffled.
    """
    rows = usable_facets(facets)
    active = None
    if only_active:
        active = keys.where("isActive").select(F.col("standardKey").alias("standard_key")).distinct()
    listed = hits.select("query_id", "brand_sku_id")
    if only_active is True:
        rows = rows.join(active, "standard_key", "left_semi")
    elif only_active:
        listed = hits.select("query_id", "brand_sku_id", F.col(only_active).alias("_strict"))
        rows = rows.join(active.withColumn("_live", F.lit(True)), "standard_key", "left")
    listed = listed.distinct()
    joined = rows.join(small_side(listed) if small_hits else listed, "brand_sku_id")
    if isinstance(only_active, str):
        joined = joined.where(~F.coalesce("_strict", F.lit(False)) | F.col("_live").isNotNull())
    return joined.select(
        "query_id", "brand_sku_id", "standard_key", "facet_value", "original_value", "standard_value"
    )


def in_facet_order(rows: DataFrame, collation: str | None = None, spread: bool = True) -> DataFrame:
    """Facet rows with ``position``, their place in the delivery order of their list: key,
    then value, then SKU.

    Keys and values are compared by ``collation``, one of Spark's (None: by bytes); what it
    holds equal is told apart by SKU, then by bytes. ``spread=True`` is for lists of any
    length, see ``row_numbers``.
    """
    by_collation = [collated(F.col(c), collation) for c in ("standard_key", "facet_value")]
    rest = ["standard_key", "facet_value", "original_value", "standard_value"]
    order = [*by_collation, F.col("brand_sku_id"), *(F.col(c) for c in rest)]
    return row_numbers(rows, ["query_id"], order, "position", spread)


def facet_counts(rows: DataFrame, distinct_skus: bool = False) -> DataFrame:
    """Rows per value; duplicates of one SKU count again unless ``distinct_skus``."""
    if distinct_skus:
        rows = rows.select("query_id", "standard_key", "facet_value", "brand_sku_id").distinct()
    return rows.groupBy("query_id", "standard_key", "facet_value").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def facet_totals(counts: DataFrame) -> DataFrame:
    """Sum of the option counts of each key."""
    return counts.groupBy("query_id", "standard_key").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_options")
    )


def facet_bundle_rows(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Facet rows followed by price rows. Where a list has price rows, data rows
    that happen to use the same key are replaced by them.

    Only rows with that key meet the lists that have prices; all others pass by
    without a shuffle."""
    same_key = F.coalesce(F.col("standard_key") == PRICE_KEY, F.lit(False))
    unpriced = rows.where(same_key).join(prices.select("query_id").distinct(), "query_id", "left_anti")
    kept = rows.where(~same_key).unionByName(unpriced)
    return kept.unionByName(prices, allowMissingColumns=True)


def _all_options(counts: DataFrame, prices: DataFrame) -> DataFrame:
    """Value options and price options of all keys, before replacement."""
    values = counts.withColumns({"display_name": F.col("facet_value"), "is_price": F.lit(False)})
    ranges = prices.select(
        "query_id", "standard_key", "facet_value", "cnt", "min_price", "max_price",
        F.concat("facet_value", F.lit(" ("), F.col("cnt").cast("string"), F.lit(")")).alias(
            "display_name"
        ),
        F.lit(True).alias("is_price"),
    )
    return values.unionByName(ranges, allowMissingColumns=True)


def _option_order(collation: str | None = None) -> list[Column]:
    """Price options by their minimum, others by count and then value. Price
    options come first, so data rows they replace never take their numbers."""
    return [
        F.col("is_price").desc(),
        F.col("min_price"),
        F.when(~F.col("is_price"), -F.col("cnt")),
        *([collated(F.col("facet_value"), collation)] if collation else []),
        F.col("facet_value"),
    ]


def _key_totals(options: DataFrame) -> DataFrame:
    """Total and number of options per key, of the price options where a key has them."""
    is_price = F.col("is_price")
    return (
        options.groupBy("query_id", "standard_key")
        .agg(
            F.bool_or(is_price).alias("has_price"),
            F.sum(F.when(is_price, F.col("cnt"))).alias("_price_total"),
            F.sum("cnt").alias("_all_total"),
            F.count(F.when(is_price, 1)).alias("_price_options"),
            F.count(F.lit(1)).alias("_all_options"),
        )
        .select(
            "query_id",
            "standard_key",
            "has_price",
            F.coalesce("_price_total", "_all_total").alias("total"),
            F.when(F.col("has_price"), F.col("_price_options"))
            .otherwise(F.col("_all_options"))
            .alias("n_options"),
        )
    )


def _key_order() -> list[Column]:
    return [F.col("standard_key") != PRICE_KEY, F.col("total").desc(), F.col("standard_key")]


def facet_key_order(counts: DataFrame, prices: DataFrame) -> DataFrame:
    """Price first, then keys by falling total, ties by name. A list has as many
    rows here as it has keys."""
    order = Window.partitionBy("query_id").orderBy(*_key_order())
    totals = _key_totals(_all_options(counts, prices)).drop("has_price")
    return totals.withColumn("facet_rank", F.row_number().over(order))


def facet_key_order_alpha(counts: DataFrame, prices: DataFrame, collation: str | None = None) -> DataFrame:
    """Price first, then keys by name (by ``collation``, what it holds equal by bytes)."""
    order = Window.partitionBy("query_id").orderBy(
        F.col("standard_key") != PRICE_KEY, collated(F.col("standard_key"), collation), F.col("standard_key")
    )
    totals = _key_totals(_all_options(counts, prices)).drop("has_price")
    return totals.withColumn("facet_rank", F.row_number().over(order))


def facet_options(
    rows: DataFrame, prices: DataFrame, spread: bool = False, collation: str | None = None
) -> DataFrame:
    """All options of all keys with their positions.

    A list bounded by a search's ``k`` is brought together once, by its query,
    and every window runs on that partitioning. ``spread=True`` is for lists
    without such a bound: totals come from split sums and options are ranked
    without one task per list or key; the counted options are written, since both
    read them. Options of equal count are in the order of ``collation``, then of bytes.
    """
    options = _all_options(facet_counts(rows), prices)
    if spread:
        options = freeze(options, "options")
        numbered = row_numbers(
            options, ["query_id", "standard_key"], _option_order(collation), "option_rank", spread
        )
        order = Window.partitionBy("query_id").orderBy(*_key_order())
        keys = _key_totals(options).withColumn("facet_rank", F.row_number().over(order))
        placed = numbered.join(keys, ["query_id", "standard_key"])
    else:
        by_key = Window.partitionBy("query_id", "standard_key")
        placed = (
            options.repartition("query_id")
            .withColumns(
                {
                    "has_price": F.bool_or("is_price").over(by_key),
                    "option_rank": F.row_number().over(by_key.orderBy(*_option_order(collation))),
                }
            )
            .where(F.col("is_price") | ~F.col("has_price"))
            .withColumn("total", F.sum("cnt").over(by_key))
            .withColumn(
                "facet_rank",
                F.dense_rank().over(Window.partitionBy("query_id").orderBy(*_key_order())),
            )
        )
    return placed.where(F.col("is_price") | ~F.col("has_price")).select(
        "query_id", "facet_rank", "standard_key", "total", "option_rank", "facet_value", "cnt",
        "display_name", "min_price", "max_price",
    )


def facet_top_options(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """The options shown per key and how many more there are.

    The literal bound on the rank lets each task cut its share before the
    shuffle; the number of options comes from a split count. The counted options are
    written, since both read them.
    """
    options = freeze(_all_options(facet_counts(rows), prices), "options")
    order = Window.partitionBy("query_id", "standard_key").orderBy(*_option_order())
    cap = F.when(F.col("standard_key") == PRICE_KEY, PRICE_OPTION_CAP).otherwise(OPTION_CAP)
    shown = (
        options.withColumn("option_rank", F.row_number().over(order))
        .where(F.col("option_rank") <= PRICE_OPTION_CAP)
        .where(F.col("option_rank") <= cap)
    )
    return (
        shown.join(_key_totals(options), ["query_id", "standard_key"])
        .where(F.col("is_price") | ~F.col("has_price"))
        .select(
            "query_id", "standard_key", "option_rank", "facet_value", "cnt", "display_name",
            F.greatest(F.col("n_options") - cap, F.lit(0)).cast("long").alias("n_more"),
        )
    )


def facet_titles(counts: DataFrame, prices: DataFrame) -> DataFrame:
    """Shown title of every key in use."""
    keys = counts.select("standard_key").union(prices.select("standard_key")).distinct()
    return keys.select("standard_key", facet_title(F.col("standard_key")).alias("title"))


def facet_bundle(
    rows: DataFrame, prices: DataFrame, page_rows: int = 1000, spread: bool = True
) -> DataFrame:
    """Key -> ordered list of rows, as nested pages.

    A page holds at most ``page_rows`` rows, and the pages of a key follow each
    other, so no array and no task has to hold a whole key.
    """
    order = [F.col("min_price").asc_nulls_first(), F.col("facet_value"), F.col("brand_sku_id"),
             F.col("original_value"), F.col("standard_value")]
    placed = row_numbers(
        facet_bundle_rows(rows, prices), ["query_id", "standard_key"], order, "row_no", spread
    )
    fields = ["row_no", "brand_sku_id", "facet_value", "original_value", "standard_value",
              "cnt", "min_price", "max_price"]
    page = F.floor((F.col("row_no") - 1) / page_rows).cast("int").alias("page")
    return placed.groupBy("query_id", "standard_key", page).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")
    )
