"""Input views over the given tables, as SQL that Spark and DuckDB both run.

``{table}`` stands for a table. A view may use another one by ``{view}``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Filters given to requests, by filter case (fixed values).
FILTER_CASES = {
    0: {},
    1: {"type": ["promo", "economy", "small"]},
    2: {"ship_flag": ["A", "R"], "type": ["medium", "large", "standard"]},
    3: {"price_range": ["Under ₹100", "Above ₹5,000"]},
    4: {"price_range": ["Free of charge"], "size": []},
    5: {"price_range": ["₹1,000 - ₹2,500", "Above ₹5,000", "Free of charge"],
        "size": ["1", "2", "3", "5", "8", "13", "21", "34"]},
}

VIEWS = {
    "brand_sku": """
        SELECT CAST(p_partkey AS STRING) AS id, p_name AS label, p_brand AS brandId,
               split_part(p_name, ' ', 1) AS brandLabel,
               CASE WHEN p_partkey % 53 = 0 THEN NULL
                    ELSE CAST(((p_partkey * 7919) % 1000) * ((p_partkey * 7919) % 1000) AS DOUBLE) / 9 - 1
               END AS consumerSellingPrice
        FROM {part}""",
    "brand_sku_facet": """
        SELECT CAST(p_partkey AS STRING) AS brandSKUId,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'size' END AS standardKey,
               CAST(p_size AS STRING) AS standardValue,
               concat(CAST(p_size AS STRING), ' cm') AS value,
               p_partkey % 11 <> 0 AS isActive
        FROM {part}
        UNION ALL
        SELECT CAST(p_partkey AS STRING), 'brand_line', CAST(NULL AS STRING), p_brand, true FROM {part}
        UNION ALL
        SELECT CAST(p_partkey AS STRING), 'type',
               CASE p_partkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '  ' WHEN 2 THEN '-'
                                  WHEN 3 THEN NULL ELSE lower(p_type) END,
               p_type, true
        FROM {part}
        UNION ALL
        SELECT CAST(l_partkey AS STRING), 'ship_flag', l_returnflag, l_returnflag, l_linestatus = 'O'
        FROM {lineitem}
        UNION ALL
        SELECT CAST(p_partkey AS STRING), 'price_range',
               CASE WHEN p_partkey % 2 = 0 THEN 'Free of charge' ELSE 'Under ₹100' END, 'as listed', true
        FROM {part} WHERE p_partkey % 17 = 0""",
    "facet_keys": """
        SELECT * FROM (VALUES ('size', true), ('brand_line', true), ('type', false))
               AS t(standardKey, isActive)""",
    "catalog_raw": """
        SELECT p_partkey AS row_id,
               CASE WHEN p_partkey % 61 = 0 THEN ' ' ELSE CAST(p_partkey AS STRING) END AS brand_sku_id,
               CASE WHEN p_partkey % 59 = 0 THEN '  '
                    ELSE concat('  ', upper(split_part(p_name, ' ', 2)), ' ') END AS product_name,
               CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN '100'
                    WHEN p_partkey % 43 = 0 THEN '3M 300' WHEN p_partkey % 47 = 0 THEN 'Celik'
                    ELSE split_part(p_name, ' ', 1) END AS brand_name,
               p_type AS category_name
        FROM {part}""",
    # every SKU, listed under its brand
    "brand_lists": """
        SELECT p_brand AS query_id, CAST(p_partkey AS STRING) AS brand_sku_id,
               length(p_brand) % 2 = 0 AS only_active
        FROM {part}""",
    # every SKU name wanted of every supplier that has line items
    "supplier_names": """
        SELECT DISTINCT concat('s', CAST(l_suppkey AS STRING)) AS query_id, p_name AS product_name
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    # every ordered part, listed under its supplier, repeats included
    "supplier_lists": """
        SELECT concat('s', CAST(l_suppkey AS STRING)) AS query_id,
               CAST(l_partkey AS STRING) AS brand_sku_id
        FROM {lineitem}""",
    "supplier_requests": """
        SELECT concat('s', CAST(s_suppkey AS STRING)) AS query_id, s_suppkey % 6 AS filter_case
        FROM {supplier}""",
    # the name of every part, in changing case, as one list of terms
    "terms": """
        SELECT 'all' AS query_id, p_partkey AS pos,
               CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
                                  ELSE concat(p_name, ' ') END AS term
        FROM {part}""",
    # a search log as texts: every product name of the catalog
    "text_requests": """
        SELECT concat('t', CAST(min(p_partkey) AS STRING)) AS query_id,
               CASE WHEN min(p_partkey) % 7 = 0 THEN concat(p_name, ' 2000 celik') ELSE p_name END AS q,
               CASE min(p_partkey) % 3 WHEN 0 THEN 5 WHEN 1 THEN 20 ELSE NULL END AS k,
               CASE min(p_partkey) % 4 WHEN 0 THEN 5 WHEN 1 THEN 50 ELSE NULL END AS pool,
               CAST(CASE WHEN min(p_partkey) % 5 = 0 THEN 0 ELSE NULL END AS DOUBLE) AS boost,
               min(p_partkey) % 2 = 0 AS only_active, min(p_partkey) % 6 AS filter_case
        FROM {part} GROUP BY p_name""",
    # every order as a facet request with the parts it lists as ids
    "facet_params": """
        SELECT concat('o', CAST(l_orderkey AS STRING)) AS query_id, l_linenumber AS pos,
               CASE WHEN l_orderkey % 9 = 0 THEN 'other' ELSE 'brand_sku_ids' END AS name,
               CASE WHEN l_partkey % 23 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END AS value
        FROM {lineitem}
        UNION ALL
        SELECT concat('o', CAST(o_orderkey AS STRING)), 0, 'active_facets',
               CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'True' ELSE 'no' END
        FROM {orders}""",
    # every conversation turn as a web request
    "request_params": """
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS query_id, 0 AS pos, 'q' AS name,
               CASE WHEN turn % 5 = 3 THEN '   ' ELSE concat('  ', text, ' ') END AS value
        FROM {conversations}
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 1, 'k',
               CASE conv_id % 4 WHEN 0 THEN ' 12 ' WHEN 1 THEN '+7' WHEN 2 THEN 'many' ELSE '1_000' END
        FROM {conversations} WHERE role <> 'system'
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 2, 'active_facets',
               CASE role WHEN 'user' THEN 'TRUE' ELSE 'yes' END
        FROM {conversations}
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 3, 'facet_role', role
        FROM {conversations}
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 4, 'facet_role', ' any'
        FROM {conversations}
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 5, 'facet_empty', '  '
        FROM {conversations}
        UNION ALL
        SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), 6, 'page', '2'
        FROM {conversations}""",
}


def expand(sql: str) -> str:
    """Plain SQL with table names in place and views inlined."""
    return re.sub(
        r"\{(\w+)\}",
        lambda m: m[1] if m[1] in TABLES else f"({expand(VIEWS[m[1]])})",
        sql,
    )


@lru_cache(maxsize=256)
def _table(spark: SparkSession, path: str) -> DataFrame:
    """A table reference; its footer is read once per session."""
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of ``sf_dir``."""
    sql = VIEWS[name]
    used = {t for t in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in used})


def with_filters(requests: DataFrame) -> DataFrame:
    """Replace ``filter_case`` by the filter map."""
    chosen = F.lit(None)
    for case, filters in FILTER_CASES.items():
        pairs = [
            part
            for key, values in filters.items()
            for part in (
                F.lit(key),
                F.array(*[F.lit(value) for value in values]).cast("array<string>"),
            )
        ]
        as_map = F.create_map(*pairs).cast("map<string,array<string>>")
        chosen = F.when(F.col("filter_case") == case, as_map).otherwise(chosen)
    return requests.withColumn("filters", chosen).drop("filter_case")


def filter_values() -> str:
    """The filters in long form, as SQL rows (filter_case, standard_key, facet_value)."""
    rows = [
        f"({case}, '{key}', '{value}')"
        for case, filters in FILTER_CASES.items()
        for key, values in filters.items()
        for value in values
    ]
    return ", ".join(rows)
