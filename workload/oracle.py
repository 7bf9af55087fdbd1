"""SQL counterparts of the registered queries, run by DuckDB on the same tables."""

from __future__ import annotations

from workload.views import expand, filter_values

# Metaphone codes of the words that occur as brands or in queries (fixed values).
WORD_CODES = {
    "red": "RT", "blue": "BL", "large": "LRJ", "new": "N", "cold": "KLT", "hot": "HT",
    "old": "OLT", "small": "SML", "ring": "RNK", "bolt": "BLT", "anvil": "ANFL",
    "widget": "WJT", "gear": "JR", "gizmo": "JSM", "plate": "PLT", "rod": "RT", "nan": "NN",
    "100": "", "2000": "", "3m 300": "M ", "çelik": "SLK", "celik": "SLK",
}
_CODES = "(VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in WORD_CODES.items()) + ") AS codes(word, code)"

# Double Metaphone codes of the same words, where the second differs both (fixed values).
DOUBLE_CODES = {
    "red": "RT", "blue": "PL", "large": "LRJ LRK", "new": "N NF", "cold": "KLT", "hot": "HT",
    "old": "ALT", "small": "SML XML", "ring": "RNK", "bolt": "PLT", "anvil": "ANFL",
    "widget": "AJT FJT", "gear": "JR KR", "gizmo": "JSM KSM", "plate": "PLT", "rod": "RT", "nan": "NN",
    "100": "", "2000": "", "3m 300": "M", "çelik": "SLK", "celik": "SLK",
}
_DOUBLE = "(VALUES " + ", ".join(
    f"('{w}', '{code}')" for w, codes in DOUBLE_CODES.items() for code in codes.split(" ")) + ") AS codes(word, code)"
_FIRST = "(VALUES " + ", ".join(
    f"('{w}', '{codes.split(' ')[0]}')" for w, codes in DOUBLE_CODES.items()) + ") AS codes(word, code)"

# Price buckets: number, label, lower bound, upper bound, shown minimum and maximum
# (fixed values).
_BUCKETS = """(VALUES
    (0, 'Under ₹100', NULL, 100, 0, 99.99),
    (1, '₹100 - ₹250', 100, 250, 100, 249.99),
    (2, '₹250 - ₹500', 250, 500, 250, 499.99),
    (3, '₹500 - ₹1,000', 500, 1000, 500, 999.99),
    (4, '₹1,000 - ₹2,500', 1000, 2500, 1000, 2499.99),
    (5, '₹2,500 - ₹5,000', 2500, 5000, 2500, 4999.99),
    (6, 'Above ₹5,000', 5000, NULL, 5000, 999999)) AS b(no, label, low, high, shown_min, shown_max)"""
_IN_BUCKET = ("(b.low IS NULL OR consumerSellingPrice >= b.low) AND "
              "(b.high IS NULL OR consumerSellingPrice < b.high)")

_NORMAL = """
    SELECT row_id, brand_sku_id,
           lower(trim(coalesce(product_name, 'nan'))) AS product_name,
           lower(trim(coalesce(brand_name, 'nan'))) AS brand_name,
           lower(trim(coalesce(category_name, 'nan'))) AS category_name
    FROM {catalog_raw}"""
_TEXT = f"""
    SELECT row_id, trim(concat(brand_name, ' ', product_name, ' ', category_name)) AS search_text
    FROM ({_NORMAL})"""
_LOOKUP = f"""
    SELECT row_id, trim(brand_sku_id) AS brand_sku_id, product_name AS label, brand_name AS brandLabel,
           category_name AS category, trim(code) AS brand_phonetic
    FROM ({_NORMAL}) JOIN {_CODES} ON word = brand_name"""

# ---- search from text on a built index --------------------------------------

def _word(sql: str) -> str:
    """32-bit unsigned value of an expression that may be wider."""
    return f"(({sql}) & 4294967295::HUGEINT)"


def _rotate(sql: str, bits: int) -> str:
    return _word(f"(({sql}) * {1 << bits}) | (({sql}) // {1 << (32 - bits)})")


def _times(sql: str, factor: int) -> str:
    return _word(f"({sql}) * {factor}::HUGEINT")


# Murmur3 (x86, 32 bit, seed 42) of "a b c": one 4-byte block and one tail byte.
def _embed_ctes(texts: str) -> str:
    """CTE ``weights``: row_id, dim, weight of the texts of a table (row_id, search_text)."""
    return f"""
     grams AS (
         SELECT row_id, unnest(range(1, length(search_text) - 1)) AS i, search_text FROM {texts}),
     bytes AS (
         SELECT row_id,
                (ascii(search_text[i]) + 32 * 256 + ascii(search_text[i + 1]) * 65536
                 + 32 * 16777216)::HUGEINT AS block,
                ascii(search_text[i + 2])::HUGEINT AS tail
         FROM grams),
     s1 AS (SELECT row_id, tail, {_times('block', 0xcc9e2d51)} AS k1 FROM bytes),
     s2 AS (SELECT row_id, tail, {_times(_rotate('k1', 15), 0x1b873593)} AS k1 FROM s1),
     s3 AS (SELECT row_id, tail, xor(42::HUGEINT, k1) AS h FROM s2),
     s4 AS (SELECT row_id, tail, {_word(f"{_rotate('h', 13)} * 5 + {0xe6546b64}::HUGEINT")} AS h FROM s3),
     t1 AS (SELECT row_id, h, {_times('tail', 0xcc9e2d51)} AS k1 FROM s4),
     t2 AS (SELECT row_id, xor(h, {_times(_rotate('k1', 15), 0x1b873593)}) AS h FROM t1),
     f0 AS (SELECT row_id, xor(h, 5::HUGEINT) AS h FROM t2),
     f1 AS (SELECT row_id, {_times('xor(h, h // 65536)', 0x85ebca6b)} AS h FROM f0),
     f2 AS (SELECT row_id, {_times('xor(h, h // 8192)', 0xc2b2ae35)} AS h FROM f1),
     f3 AS (SELECT row_id, xor(h, h // 65536) AS h FROM f2),
     hashed AS (SELECT row_id, CAST(h % 64 AS INTEGER) AS dim FROM f3),
     counted AS (SELECT row_id, dim, CAST(count(*) AS DOUBLE) AS n FROM hashed GROUP BY ALL),
     weights AS (
         SELECT row_id, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY row_id)) AS FLOAT) AS weight
         FROM counted)"""


_EMBED = f"WITH texts AS ({_TEXT})," + _embed_ctes("texts") + " SELECT * FROM weights"

_SCORED = """
     codes AS (
         SELECT DISTINCT query_id, code
         FROM (SELECT query_id, unnest(string_split(q, ' ')) AS word FROM req) JOIN {codes} USING (word)
         WHERE code <> ''),
     scored AS (
         SELECT p.query_id, p.row_id, l.brand_sku_id, l.label, l.brandLabel, l.category,
                l.brand_phonetic, p.dist, r.k,
                CASE WHEN EXISTS (SELECT 1 FROM codes c
                                  WHERE c.query_id = p.query_id AND c.code = l.brand_phonetic)
                     THEN p.dist - r.boost ELSE p.dist END AS score
         FROM pool p JOIN lookup l USING (row_id) JOIN req r USING (query_id)),
     reranked AS (
         SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, dist, row_id) AS INTEGER) AS rank
         FROM scored),
     hits AS (
         SELECT query_id, rank, brand_sku_id, label, brandLabel, category, brand_phonetic, score
         FROM reranked WHERE rank <= k)""".replace("{codes}", _CODES)


def _built(k: int, pool: int) -> str:
    """Catalog and requests embedded by the same SQL, the requests' ids shifted apart,
    then all pairs and the two ranking stages; ``k`` and ``pool`` fill what is null."""
    return f"""
WITH lookup AS ({_LOOKUP}),
     req AS (
         SELECT query_id, q, coalesce(k, {k}) AS k, coalesce(pool, {pool}) AS pool,
                coalesce(boost, 0.2) AS boost, only_active, filter_case,
                -CAST(substr(query_id, 2) AS BIGINT) - 1 AS row_id
         FROM {{text_requests}}),
     texts AS (SELECT * FROM ({_TEXT}) UNION ALL SELECT row_id, q FROM req),""" + _embed_ctes("texts") + f""",
     dense AS (
         SELECT t.row_id, list(coalesce(w.weight, 0)::DOUBLE ORDER BY d.dim) AS vec
         FROM texts t CROSS JOIN (SELECT CAST(unnest(range(64)) AS INTEGER) AS dim) d
         LEFT JOIN weights w ON w.row_id = t.row_id AND w.dim = d.dim
         GROUP BY t.row_id),
     pairs AS (
         SELECT a.query_id, v.row_id, greatest(a.pool, a.k) AS pool_limit,
                list_sum(list_transform(range(1, 65), lambda i: (x.vec[i] - v.vec[i]) * (x.vec[i] - v.vec[i]))) AS dist
         FROM req a JOIN dense x ON x.row_id = a.row_id, dense v WHERE v.row_id >= 0),
     numbered AS (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS n FROM pairs),
     pool AS (SELECT query_id, CAST(n AS INTEGER) AS rank, row_id, dist FROM numbered WHERE n <= pool_limit),""" + _SCORED


_HYBRID = _built(5, 50)
# brands take the first code, queries both
_HYBRID_DOUBLE = _HYBRID.replace("JOIN " + _CODES + " USING (word)", "JOIN " + _DOUBLE + " USING (word)").replace(
    "JOIN " + _CODES + " ON word", "JOIN " + _FIRST + " ON word")

# ---- facets ----------------------------------------------------------------

# The placeholder words are fixed values.
_USABLE = """
    SELECT brandSKUId AS brand_sku_id, standardKey AS standard_key,
           coalesce(standardValue, value) AS facet_value, value AS original_value,
           standardValue AS standard_value
    FROM {brand_sku_facet}
    WHERE isActive AND standardKey IS NOT NULL AND coalesce(standardValue, value) IS NOT NULL
      AND trim(coalesce(standardValue, value)) <> ''
      AND lower(trim(coalesce(standardValue, value))) NOT IN ('n/a', 'na', 'null', 'none', '-')"""
_ACTIVE_KEYS = "(SELECT standardKey FROM {facet_keys} WHERE isActive)"


def _facet_ctes(lists: str, strict: str = "FALSE") -> str:
    """CTEs over a hit list: rows, prices, counts, options, totals."""
    return f"""
     listed AS (SELECT DISTINCT query_id, brand_sku_id, {strict} AS strict FROM {lists}),
     facet_rows AS (
         SELECT l.query_id, u.*
         FROM ({_USABLE}) u JOIN listed l USING (brand_sku_id)
         WHERE NOT l.strict OR u.standard_key IN {_ACTIVE_KEYS}),
     price_rows AS (
         SELECT query_id, '' AS brand_sku_id, 'price_range' AS standard_key, b.label AS facet_value,
                b.label AS original_value, b.label AS standard_value, count(*) AS cnt,
                CAST(shown_min AS DOUBLE) AS min_price, CAST(shown_max AS DOUBLE) AS max_price
         FROM {{brand_sku}} s JOIN listed l ON l.brand_sku_id = s.id JOIN {_BUCKETS} ON {_IN_BUCKET}
         WHERE consumerSellingPrice > 0 AND consumerSellingPrice < 100000
         GROUP BY query_id, b.label, shown_min, shown_max),
     facet_counts AS (
         SELECT query_id, standard_key, facet_value, count(*) AS cnt FROM facet_rows GROUP BY ALL),
     priced AS (SELECT DISTINCT query_id FROM price_rows),
     kept_rows AS (
         SELECT * FROM facet_rows
         WHERE standard_key <> 'price_range' OR query_id NOT IN (SELECT query_id FROM priced)),
     kept_counts AS (
         SELECT * FROM facet_counts
         WHERE standard_key <> 'price_range' OR query_id NOT IN (SELECT query_id FROM priced)),
     options AS (
         SELECT query_id, standard_key, facet_value, cnt, facet_value AS display_name,
                CAST(NULL AS DOUBLE) AS min_price, CAST(NULL AS DOUBLE) AS max_price FROM kept_counts
         UNION ALL
         SELECT query_id, standard_key, facet_value, cnt, concat(facet_value, ' (', cnt, ')'), min_price, max_price
         FROM price_rows),
     totals AS (
         SELECT query_id, standard_key, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_options
         FROM options GROUP BY ALL),
     key_order AS (
         SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                   ORDER BY standard_key <> 'price_range', total DESC, standard_key) AS INTEGER) AS facet_rank
         FROM totals),
     ranked AS (
         SELECT *, CAST(row_number() OVER (PARTITION BY query_id, standard_key
                   ORDER BY min_price NULLS FIRST, CASE WHEN min_price IS NULL THEN -cnt END, facet_value)
                   AS INTEGER) AS option_rank
         FROM options),
     facet_options AS (
         SELECT r.query_id, k.facet_rank, r.standard_key, k.total, r.option_rank, r.facet_value, r.cnt,
                r.display_name, r.min_price, r.max_price
         FROM ranked r JOIN key_order k USING (query_id, standard_key))"""


_FACETS = "WITH" + _facet_ctes("{brand_lists}")

# ---- filters ---------------------------------------------------------------

_CONDITIONS = f"(VALUES {filter_values()}) AS w(filter_case, standard_key, facet_value)"


def _filter_ctes(lists: str, requests: str) -> str:
    """CTE ``matched``: ids per request that satisfy its filters, by one
    EXISTS-like count per key."""
    return f"""
     wanted AS (
         SELECT r.query_id, w.standard_key, w.facet_value
         FROM {requests} r JOIN {_CONDITIONS} USING (filter_case)
         WHERE w.standard_key <> 'price_range' OR w.facet_value IN (SELECT label FROM {_BUCKETS})),
     required AS (
         SELECT r.query_id, count(DISTINCT w.standard_key) AS required
         FROM {requests} r LEFT JOIN wanted w USING (query_id) GROUP BY ALL),
     attributes AS (
         SELECT DISTINCT brand_sku_id, standard_key, facet_value FROM ({_USABLE})
         WHERE standard_key <> 'price_range'
         UNION ALL
         SELECT id, 'price_range', b.label FROM {{brand_sku}} JOIN {_BUCKETS} ON {_IN_BUCKET}),
     satisfied AS (
         SELECT h.query_id, h.brand_sku_id, count(DISTINCT a.standard_key) AS met
         FROM (SELECT DISTINCT query_id, brand_sku_id FROM {lists}) h
         JOIN attributes a USING (brand_sku_id)
         JOIN wanted w ON w.query_id = h.query_id AND w.standard_key = a.standard_key
                      AND w.facet_value = a.facet_value
         WHERE h.brand_sku_id IN (SELECT id FROM {{brand_sku}})
         GROUP BY ALL),
     matched AS (
         SELECT s.query_id, s.brand_sku_id FROM satisfied s JOIN required r USING (query_id)
         WHERE s.met = r.required
         UNION ALL
         SELECT h.query_id, h.brand_sku_id FROM {lists} h JOIN required r USING (query_id)
         WHERE r.required = 0)"""


_FILTERED_HYBRID = _built(20, 100) + "," + _filter_ctes("hits", "req") + """,
     kept AS (
         SELECT h.* FROM hits h JOIN req r USING (query_id)
         WHERE r.filter_case = 0
            OR EXISTS (SELECT 1 FROM matched m
                       WHERE m.query_id = h.query_id AND m.brand_sku_id = h.brand_sku_id
                         AND h.brand_sku_id <> ''))"""

# a filter case with an empty key leaves that key out; case 0 restricts nothing
_PRODUCTS = f"""
    WITH facets AS (
             SELECT brandSKUId AS id, standardKey, coalesce(standardValue, value) AS v
             FROM {{brand_sku_facet}} WHERE isActive),
         per_case AS (
             SELECT w.filter_case, f.id
             FROM {_CONDITIONS} JOIN facets f ON f.standardKey = w.standard_key AND f.v = w.facet_value
             GROUP BY w.filter_case, f.id
             HAVING count(DISTINCT w.standard_key) =
                    (SELECT count(DISTINCT standard_key) FROM {_CONDITIONS.replace('AS w', 'AS x')}
                     WHERE x.filter_case = w.filter_case)),
         found AS (
             SELECT DISTINCT r.query_id, s.label AS product_name
             FROM {{supplier_requests}} r JOIN per_case USING (filter_case) JOIN {{brand_sku}} s USING (id))"""

# ---- text ------------------------------------------------------------------

_SPACE = r"[\s\x1c-\x1f]"

_NORMALISED = f"""
WITH p AS (SELECT * FROM {{request_params}}),
     one AS (
         SELECT query_id,
                coalesce(max(CASE WHEN name = 'q' THEN value END), '') AS q,
                max(CASE WHEN name = 'k' THEN trim(value) END) AS k,
                max(CASE WHEN name = 'active_facets' THEN lower(value) END) AS strict
         FROM p GROUP BY query_id),
     keyed AS (
         SELECT query_id, substr(name, 7) AS key,
                string_agg(CASE WHEN trim(value) <> '' THEN value END, '|' ORDER BY pos) AS accepted
         FROM p WHERE starts_with(name, 'facet_') GROUP BY ALL),
     filters AS (
         SELECT query_id, string_agg(concat(key, '=', coalesce(accepted, '')), ';' ORDER BY key) AS filters
         FROM keyed GROUP BY ALL)
SELECT query_id,
       regexp_replace(regexp_replace(q, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS q,
       CASE k WHEN '12' THEN 12 WHEN '+7' THEN 7 WHEN '1_000' THEN 1000
              WHEN 'many' THEN NULL ELSE 50 END::BIGINT AS k,
       coalesce(strict = 'true', FALSE) AS only_active,
       filters,
       CASE WHEN k = 'many' THEN 'k is not an integer'
            WHEN trim(q) = '' THEN 'No search query provided' END AS error
FROM one JOIN filters USING (query_id)"""


_SQL = {
    "scan_csv": "SELECT row_id, brand_sku_id, product_name, brand_name, category_name FROM {catalog_raw}",
    "catalog_head": "SELECT * FROM {catalog_raw} ORDER BY row_id LIMIT 100",
    "catalog_normalize": _NORMAL,
    "search_text": _TEXT,
    "lookup_export": f"""SELECT row_id, brand_sku_id AS id, label, brandLabel, category, brand_phonetic
                         FROM ({_LOOKUP})""",
    "index_meta": """
        SELECT count(*) AS num_items, CAST(max(len(embedding)) AS INTEGER) AS embedding_dim,
               'stored' AS model, 'exact_l2' AS index_type
        FROM {embeddings} JOIN {part} ON p_partkey = vec_id""",
    "vector_check": """
        SELECT count(*) AS num_items, count(embedding) AS num_vectors,
               CAST(min(len(embedding)) AS INTEGER) AS min_dim,
               CAST(max(len(embedding)) AS INTEGER) AS max_dim,
               count(*) = count(embedding) AND min(len(embedding)) = max(len(embedding)) AS consistent
        FROM {embeddings}""",
    "embed_catalog": _EMBED,
    "build_catalog_index": f"SELECT *, CAST(64 AS INTEGER) AS dim FROM ({_LOOKUP})",
    "rebuild_catalog_index": f"SELECT *, CAST(64 AS INTEGER) AS dim FROM ({_LOOKUP})",
    "vector_distance": """
        WITH anchors AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM {embeddings} GROUP BY label)
        SELECT vec_id,
               list_sum(list_transform(range(1, len(embedding) + 1), lambda i:
                   (embedding[i]::DOUBLE - anchor[i]::DOUBLE) * (embedding[i]::DOUBLE - anchor[i]::DOUBLE))) AS dist
        FROM {embeddings} JOIN anchors USING (label)""",
    "knn_candidates": _HYBRID + " SELECT * FROM pool",
    "lookup_json": f"""SELECT row_id, brand_sku_id AS id, label, brandLabel, category, brand_phonetic
                       FROM ({_LOOKUP})""",
    "meta_json": """SELECT count(*) AS num_items, CAST(64 AS INTEGER) AS embedding_dim,
                           'hashed-ngrams' AS model, 'exact_l2' AS index_type FROM {part}""",
    "rejected_requests": f"SELECT query_id, error FROM ({_NORMALISED}) WHERE error IS NOT NULL",
    "facet_requests": """
        WITH p AS (SELECT * FROM {facet_params}),
             strict AS (
                 SELECT query_id, coalesce(bool_or(name = 'active_facets' AND lower(value) = 'true'), FALSE) AS only_active,
                        bool_or(name = 'brand_sku_ids') AS has_ids
                 FROM p GROUP BY query_id)
        SELECT query_id, value AS brand_sku_id, only_active, NULL AS error
        FROM p JOIN strict USING (query_id) WHERE name = 'brand_sku_ids'
        UNION ALL
        SELECT query_id, NULL, NULL, 'No brand_sku_ids provided' FROM strict WHERE NOT has_ids""",
    "knn_whole_catalog": """
        WITH firsts AS (SELECT label, arg_min(embedding, vec_id) AS qvec FROM {embeddings} GROUP BY label),
             pairs AS (
                 SELECT concat('l', f.label) AS query_id, vec_id AS row_id,
                        list_sum(list_transform(range(1, len(qvec) + 1), lambda i:
                            (qvec[i]::DOUBLE - embedding[i]::DOUBLE) * (qvec[i]::DOUBLE - embedding[i]::DOUBLE))) AS dist
                 FROM firsts f, {embeddings})
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS INTEGER) AS rank,
               row_id, dist FROM pairs""",
    "knn_candidates_blocks": _HYBRID + " SELECT * FROM pool",
    "knn_cells": _HYBRID + " SELECT * FROM pool",
    "knn_wide": _HYBRID + " SELECT * FROM pool",
    "scan_csv_multiline": """
        SELECT row_id, brand_sku_id, concat(product_name, chr(10), '"', brand_sku_id, '",') AS product_name,
               brand_name, category_name FROM {catalog_raw}""",
    "knn_lookup": _HYBRID + " SELECT pool.*, lookup.* EXCLUDE (row_id) FROM pool JOIN lookup USING (row_id)",
    "knn_lookup_bucketed": _HYBRID + " SELECT pool.*, lookup.* EXCLUDE (row_id) FROM pool JOIN lookup USING (row_id)",
    "brand_phonetic": f"""SELECT DISTINCT brand_name, code AS brand_phonetic
                          FROM ({_NORMAL}) JOIN {_CODES} ON word = brand_name""",
    "query_phonetic": _HYBRID + " SELECT * FROM codes",
    "brand_phonetic_double": f"""SELECT DISTINCT brand_name, code AS brand_phonetic
                                 FROM ({_NORMAL}) JOIN {_FIRST} ON word = brand_name""",
    "query_phonetic_double": _HYBRID_DOUBLE + " SELECT * FROM codes",
    "hybrid_search_double": _HYBRID_DOUBLE + " SELECT * FROM hits",
    "phonetic_rerank": _HYBRID + " SELECT query_id, row_id, brand_phonetic, dist, score, rank FROM reranked",
    "hybrid_search": _HYBRID + " SELECT * FROM hits",
    "hit_report": _HYBRID + """
        SELECT query_id, rank, printf('%.4f', score) AS score_text,
               CASE WHEN score = 0 THEN 'N/A' ELSE printf('%.4f', score) END AS score_label,
               coalesce(nullif(brandLabel, ''), 'N/A') AS brand,
               coalesce(nullif(label, ''), 'N/A') AS product,
               coalesce(nullif(category, ''), 'N/A') AS category
        FROM hits""",
    "facet_rows": _FACETS + " SELECT * FROM facet_rows",
    "facet_rows_ordered": _FACETS + """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY standard_key, facet_value, brand_sku_id,
                  original_value, standard_value NULLS FIRST) AS INTEGER) AS position FROM facet_rows""",
    "facet_rows_ordered_nocase": _FACETS + """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY lower(standard_key), lower(facet_value),
                  brand_sku_id, standard_key, facet_value, original_value, standard_value NULLS FIRST) AS INTEGER) AS position
        FROM facet_rows""",
    "facet_rows_active": _FACETS + f" SELECT * FROM facet_rows WHERE standard_key IN {_ACTIVE_KEYS}",
    "facet_counts": _FACETS + " SELECT * FROM facet_counts",
    "facet_totals": _FACETS + """
        SELECT query_id, standard_key, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_options
        FROM facet_counts GROUP BY ALL""",
    "price_range_facets": _FACETS + " SELECT * FROM price_rows",
    "facet_bundle_rows": _FACETS + " SELECT * FROM kept_rows UNION ALL BY NAME SELECT * FROM price_rows",
    "facet_bundle": _FACETS + """,
     bundle AS (SELECT * FROM kept_rows UNION ALL BY NAME SELECT * FROM price_rows),
     placed AS (
         SELECT *, row_number() OVER (PARTITION BY query_id, standard_key ORDER BY min_price NULLS FIRST,
                   facet_value, brand_sku_id, original_value, standard_value NULLS FIRST) AS row_no
         FROM bundle)
        SELECT query_id, standard_key, CAST((row_no - 1) // 1000 AS INTEGER) AS page,
               CAST(count(*) AS INTEGER) AS n_rows,
               string_agg(facet_value, '|' ORDER BY row_no) AS facet_values,
               string_agg(brand_sku_id, '|' ORDER BY row_no) AS sku_ids
        FROM placed GROUP BY ALL""",
    "facet_options": _FACETS + " SELECT * FROM facet_options",
    "facet_key_order": _FACETS + " SELECT * FROM key_order",
    "facet_key_order_alpha": _FACETS + """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id
                  ORDER BY standard_key <> 'price_range', standard_key) AS INTEGER) AS facet_rank
        FROM totals""",
    "facet_top_options": _FACETS + """
        SELECT r.query_id, r.standard_key, r.option_rank, r.facet_value, r.cnt, r.display_name,
               greatest(t.n_options - CASE WHEN r.standard_key = 'price_range' THEN 20 ELSE 10 END, 0) AS n_more
        FROM ranked r JOIN totals t USING (query_id, standard_key)
        WHERE r.option_rank <= CASE WHEN r.standard_key = 'price_range' THEN 20 ELSE 10 END""",
    "facet_titles": _FACETS + """
        SELECT DISTINCT standard_key,
               CASE standard_key WHEN 'price_range' THEN '💰 Price Range'
                    ELSE array_to_string(list_transform(string_split(standard_key, '_'),
                         lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ') END AS title
        FROM options""",
    "facets_for_hits": _HYBRID + """,
     strict_hits AS (SELECT h.query_id, h.brand_sku_id, r.only_active FROM hits h JOIN req r USING (query_id)),"""
    + _facet_ctes("strict_hits", "only_active") + " SELECT * FROM facet_options",
    "filter_price": """
        SELECT id, consumerSellingPrice FROM {brand_sku}
        WHERE consumerSellingPrice < 100 OR (consumerSellingPrice >= 500 AND consumerSellingPrice < 1000)""",
    "filter_skus": "WITH" + _filter_ctes("{supplier_lists}", "{supplier_requests}") + " SELECT * FROM matched",
    "filter_skus_indexed": "WITH" + _filter_ctes("{supplier_lists}", "{supplier_requests}") + " SELECT * FROM matched",
    "filter_products": _PRODUCTS + " SELECT * FROM found",
    "filter_products_indexed": _PRODUCTS + " SELECT * FROM found",
    "filter_products_named": _PRODUCTS + """
        SELECT * FROM found f
        WHERE query_id NOT IN (SELECT query_id FROM {supplier_names})
           OR EXISTS (SELECT 1 FROM {supplier_names} n
                      WHERE n.query_id = f.query_id AND n.product_name = f.product_name)
        UNION ALL
        SELECT n.query_id, n.product_name FROM {supplier_names} n JOIN {supplier_requests} r USING (query_id)
        WHERE r.filter_case = 0""",
    "sku_by_name": """
        WITH firsts AS (
            SELECT query_id, lower(term) AS folded, arg_min(term, pos) AS term FROM {terms} GROUP BY ALL)
        SELECT f.query_id, f.term, s.id AS brand_sku_id, s.label AS brand_sku_label, s.brandId AS brand_id,
               s.brandLabel AS brand_name, s.label AS product_name
        FROM {brand_sku} s JOIN firsts f ON lower(s.label) = f.folded""",
    "sku_by_name_collated": """
        WITH firsts AS (
            SELECT query_id, lower(term) AS folded, arg_min(term, pos) AS term FROM {terms} GROUP BY ALL)
        SELECT f.query_id, f.term, s.id AS brand_sku_id, s.label AS brand_sku_label, s.brandId AS brand_id,
               s.brandLabel AS brand_name, s.label AS product_name
        FROM {brand_sku} s JOIN firsts f ON lower(s.label) = f.folded""",
    "normalize_requests": _NORMALISED,
    "search_with_facets": _FILTERED_HYBRID + " SELECT * FROM kept",
    "search_with_facets_indexed": _FILTERED_HYBRID + " SELECT * FROM kept",
    "result_totals": _FILTERED_HYBRID + """
        SELECT r.query_id, count(k.query_id) AS total_results
        FROM req r LEFT JOIN kept k USING (query_id) GROUP BY r.query_id""",
}

ORACLE_SQL = {name: expand(sql) for name, sql in _SQL.items()}
