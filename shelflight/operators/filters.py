"""Facet filters over whole batches of requests.

A request's filters are a map from key to accepted values: values of one key
are alternatives, keys must all hold.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from shelflight.functions.price import LABELS
from shelflight.operators.facets import usable_facets
from shelflight.operators.prices import price_labels
from shelflight.operators.ranking import is_small, small_side
from shelflight.settings import PRICE_KEY
from shelflight.sources.sinks import freeze

if TYPE_CHECKING:
    from shelflight.operators.facet_index import FacetIndex


def _usable_values(key: Column, values: Column, price_aware: bool) -> Column:
    """Values of a filter that can restrict anything."""
    if not price_aware:
        return values
    known = F.array(*[F.lit(label) for label in LABELS])
    return F.when(key == PRICE_KEY, F.array_intersect(values, known)).otherwise(values)


def _conditions(filters: Column, price_aware: bool) -> Column:
    """Filter map without keys that restrict nothing: no values, or only unknown
    price labels."""
    kept = F.transform_values(
        filters, lambda key, values: _usable_values(key, values, price_aware)
    )
    kept = F.map_filter(kept, lambda _, values: F.size(values) > 0)
    return F.coalesce(kept, F.create_map().cast("map<string,array<string>>"))


def _wanted(conditions: DataFrame, owner: str) -> DataFrame:
    """Long form: one row per (owner, key, accepted value)."""
    by_key = conditions.select(owner, F.explode("conditions").alias("standard_key", "accepted"))
    return by_key.select(
        owner, "standard_key", F.explode(F.array_distinct("accepted")).alias("facet_value")
    )


def _held(values: DataFrame, owner: str, *also: Column) -> DataFrame:
    """Attributes of each owner as a map from key to its distinct values.

    ``values`` has ``attribute`` structs; repeats are removed before the
    shuffle, so a set holds at most the distinct attributes asked for. The sets
    are written: they are read by several steps, and a join with them shuffles
    both of its sides itself, so an owner that most rows refer to can be split.
    """
    gathered = values.groupBy(owner).agg(F.collect_set("attribute").alias("attributes"), *also)
    keys = F.array_distinct("attributes.standard_key")
    held = F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda key: F.transform(
                F.filter("attributes", lambda a: a["standard_key"] == key), lambda a: a["facet_value"]
            ),
        ),
    )
    return freeze(gathered.withColumn("held", held), "attribute-sets")


def _satisfied() -> Column:
    """Every condition shares a value with the attributes held."""
    return F.forall(
        F.map_entries("conditions"),
        lambda c: F.coalesce(
            F.arrays_overlap(F.element_at("held", c["key"]), c["value"]), F.lit(False)
        ),
    )


def filter_skus(
    hits: DataFrame,
    requests: DataFrame,
    skus: DataFrame,
    facets: DataFrame,
    small_hits: bool = False,
) -> DataFrame:
    """Ids of each hit list that satisfy the request's filters.

    A request without any usable condition passes its ids on unchanged, even
    ids no SKU has; otherwise ids are distinct and known SKUs.

    Each SKU's asked-for attributes are gathered into one set, combined before
    the shuffle on its id. A hit then meets its request's conditions and its
    SKU's set in one row, so no join multiplies rows. ``small_hits`` says that
    the lists are expected to be small: they are counted, and within the limit
    attributes of other SKUs are dropped where they are read.
    """
    conditions = freeze(
        requests.select("query_id", _conditions(F.col("filters"), price_aware=True).alias("conditions")),
        "conditions",
    )
    restricting = conditions.where(F.size("conditions") > 0)
    hits = hits.select("query_id", "brand_sku_id")
    untouched = hits.join(restricting.select("query_id"), "query_id", "left_anti")
    # Repeats leave before the conditions are attached, so only ids are shuffled.
    listed = hits.distinct().join(restricting, "query_id")

    attribute = F.struct("standard_key", "facet_value").alias("attribute")
    wanted = _wanted(conditions, "query_id").select("standard_key", "facet_value").distinct()
    values = (
        usable_facets(facets)
        .where(F.col("standard_key") != PRICE_KEY)
        .join(wanted, ["standard_key", "facet_value"], "left_semi")
        .select("brand_sku_id", attribute, F.lit(False).alias("known"))
    )
    # Price is one more attribute; this side also tells which ids exist.
    priced = price_labels(skus).select(
        F.col("id").alias("brand_sku_id"),
        F.struct(F.lit(PRICE_KEY).alias("standard_key"), F.col("price_label").alias("facet_value")),
        F.lit(True),
    )
    values = values.union(priced)
    if small_hits:
        ids = small_side(hits.select("brand_sku_id").distinct())
        values = values.join(ids, "brand_sku_id", "left_semi")
    sets = _held(values, "brand_sku_id", F.bool_or("known").alias("known")).where("known").drop("attributes")
    matched = listed.join(sets, "brand_sku_id").where(_satisfied()).select("query_id", "brand_sku_id")
    return matched.unionByName(untouched)


def filter_hits(
    hits: DataFrame,
    requests: DataFrame,
    skus: DataFrame,
    facets: DataFrame,
    small_hits: bool = False,
    index: FacetIndex | None = None,
) -> DataFrame:
    """Hits whose id passes the filters; ranks are kept, nothing is refilled.

    Hits of a request without filters stay, and so do all hits of a list in
    which no hit has an id. With an ``index`` (see ``build_facet_index``) the filters
    are answered from it, and ``skus`` and ``facets`` are not read.
    """
    asked = requests.select(
        "query_id", (F.coalesce(F.size("filters"), F.lit(0)) > 0).alias("_filtered")
    )
    has_id = F.coalesce(F.col("brand_sku_id") != "", F.lit(False))
    lists = hits.groupBy("query_id").agg(F.bool_or(has_id).alias("_any_id"))
    marked = (
        hits.join(asked, "query_id", "left")
        .join(lists, "query_id")
        .withColumn("_has_id", has_id)
    )
    usable = marked.where(F.col("_filtered") & F.col("_has_id"))
    if index is None:
        found = filter_skus(usable, requests, skus, facets, small_hits)
    else:
        from shelflight.operators.facet_index import filter_skus_indexed

        found = filter_skus_indexed(usable, requests, index, small_hits)
    matched = (
        found.distinct()
        .withColumn("_matched", F.lit(True))
    )
    if small_hits and is_small(hits):
        matched = F.broadcast(matched)
    return (
        marked.join(matched, ["query_id", "brand_sku_id"], "left")
        .where(
            ~F.coalesce("_filtered", F.lit(False)) | ~F.col("_any_id") | F.col("_matched").isNotNull()
        )
        .select(*hits.columns)
    )


def filter_products(
    requests: DataFrame, skus: DataFrame, facets: DataFrame, names: DataFrame | None = None
) -> DataFrame:
    """Distinct product labels that satisfy each request's filters.

    The rules are weaker than those of ``filter_skus``: placeholder values
    count, and a price key is an ordinary key. ``names`` (``query_id,
    product_name``) limits the labels; without usable filters the names are
    returned as they are.

    Work is done once per distinct filter map and handed to its requests at the
    end, so a popular filter costs no more than a rare one. Facets are read once,
    into one set per SKU of the attributes that any map asks for. Each map looks
    SKUs up by its rarest key only; the SKU's set, in the same row, is then checked
    against all keys, so a value most SKUs have multiplies nothing unless a map
    asks for nothing rarer.
    """
    sets, numbered = filter_sets(requests, price_aware=False)
    wanted = _wanted(sets, "set_no")

    pairs = ["standard_key", "facet_value"]
    values = (
        facets.where(F.col("isActive"))
        .select(
            F.col("brandSKUId").alias("id"),
            F.col("standardKey").alias("standard_key"),
            F.coalesce("standardValue", "value").alias("facet_value"),
        )
        .join(wanted.select(*pairs).distinct(), pairs, "left_semi")
    )
    held = _held(values.select("id", F.struct(*pairs).alias("attribute")), "id")
    having = held.select("id", "held", F.explode("attributes").alias("attribute")).select("id", "held", "attribute.*")
    frequent = having.groupBy(*pairs).agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(frequent, pairs, "left")
        .groupBy("set_no", "standard_key")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
        .groupBy("set_no")
        .agg(F.min(F.struct("n", "standard_key"))["standard_key"].alias("standard_key"))
    )
    entry = freeze(
        wanted.join(rarest, ["set_no", "standard_key"]).join(sets.select("set_no", "conditions"), "set_no"),
        "rarest-entries",
    )
    matched = having.join(entry, pairs).where(_satisfied()).select("set_no", "id")
    labels = (
        matched.join(skus.select("id", F.col("label").alias("product_name")), "id")
        .select("set_no", "product_name")
        .distinct()
    )
    return named_products(numbered, labels, names)


def filter_sets(requests: DataFrame, price_aware: bool) -> tuple[DataFrame, DataFrame]:
    """(distinct filter maps, requests), written tables: ``set_no, text, conditions``, and
    ``query_id, set_no`` with null for requests without a usable condition. Few and short:
    one row and one number for each distinct map."""
    entries = F.array_sort(
        F.transform(
            F.map_entries(_conditions(F.col("filters"), price_aware)),
            lambda e: F.struct(
                e["key"].alias("key"), F.array_sort(F.array_distinct(e["value"])).alias("value")
            ),
        )
    )
    asked = requests.select("query_id", entries.alias("entries")).withColumn("text", F.to_json("entries"))
    sets = freeze(
        asked.where(F.size("entries") > 0).groupBy("text").agg(F.first("entries").alias("entries"))
        .select("text", F.monotonically_increasing_id().alias("set_no"),
                F.map_from_entries("entries").alias("conditions")),
        "filter-sets",
    )
    numbered = freeze(
        asked.select("query_id", F.when(F.size("entries") > 0, F.col("text")).alias("text"))
        .join(sets.select("text", "set_no"), "text", "left").select("query_id", "set_no"),
        "numbered-requests",
    )
    return sets, numbered


def named_products(numbered: DataFrame, labels: DataFrame, names: DataFrame | None) -> DataFrame:
    """``query_id, product_name``: the labels (``set_no, product_name``) of each request's
    map, within ``names`` where a request has some; without a map the names themselves."""
    found = numbered.where(F.col("set_no").isNotNull()).join(labels, "set_no").select("query_id", "product_name")
    if names is None:
        return found
    names = names.select("query_id", "product_name")
    named = names.select("query_id").distinct().withColumn("_named", F.lit(True))
    limited = (
        found.join(named, "query_id", "left")
        .join(names.distinct().withColumn("_listed", F.lit(True)), ["query_id", "product_name"], "left")
        .where(F.col("_named").isNull() | F.col("_listed").isNotNull())
        .select("query_id", "product_name")
    )
    unfiltered = numbered.where(F.col("set_no").isNull()).select("query_id")
    return limited.unionByName(names.join(unfiltered, "query_id", "left_semi"))
