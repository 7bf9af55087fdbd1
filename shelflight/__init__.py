"""Batch catalog search and facet analytics on Spark."""

from shelflight.functions.double_metaphone import DOUBLE_METAPHONE, double_codes
from shelflight.functions.phonetic import METAPHONE, PhoneticEncoder, metaphone, query_codes
from shelflight.operators.cells import CellIndex, knn_in_cells, read_cells, write_cells
from shelflight.operators.checks import index_meta, require_consistent_vectors, vector_check
from shelflight.operators.embedding import HashedNGrams, ModelEmbedder, embed_table
from shelflight.operators.facet_index import (
    FacetIndex, build_facet_index, filter_products_indexed, filter_skus_indexed, read_facet_index,
)
from shelflight.operators.facets import (
    facet_bundle, facet_bundle_rows, facet_counts, facet_key_order, facet_key_order_alpha,
    facet_options, facet_rows, facet_titles, facet_top_options, facet_totals, in_facet_order,
)
from shelflight.operators.filters import filter_hits, filter_products, filter_skus
from shelflight.operators.knn import attach_lookup, knn_candidates, measure_batch
from shelflight.operators.lookup import sku_by_name
from shelflight.operators.prices import price_filter, price_range_facets
from shelflight.operators.report import hit_report, result_totals
from shelflight.operators.rerank import best_k, phonetic_rerank
from shelflight.plans.index_build import (
    brand_codes, build_catalog_index, lookup_columns, lookup_export, prepare_catalog,
)
from shelflight.plans.rebuild import (
    current_build, drop_old_builds, read_catalog_index, rebuild_catalog_index,
)
from shelflight.plans.search import facets_for_hits, hybrid_search, ranked_pool, search_with_facets
from shelflight.settings import clear_scratch
from shelflight.sources.catalog import catalog_head, read_jdbc, read_table, scan_csv
from shelflight.sources.requests import (
    accepted, facet_request_hits, filter_rows, normalise_requests, rejected,
    rejected_facet_requests, with_search_defaults,
)
from shelflight.sources.sinks import (
    freeze, read_index, write_bucketed_lookup, write_index, write_lookup, write_meta,
)
