"""Batch search plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflight.functions.phonetic import METAPHONE, PhoneticEncoder, query_codes
from shelflight.operators.embedding import embed_table
from shelflight.operators.facet_index import FacetIndex
from shelflight.operators.facets import facet_options, facet_rows
from shelflight.operators.filters import filter_hits
from shelflight.operators.knn import RequestBatch, attach_lookup, knn_candidates, measure_batch
from shelflight.operators.prices import price_range_facets
from shelflight.operators.rerank import best_k, phonetic_rerank
from shelflight.settings import BATCH_LIMIT_BYTES, DEFAULT_BOOST, DEFAULT_K, DEFAULT_POOL, WIDE_POOL
from shelflight.sources.requests import with_search_defaults
from shelflight.sources.sinks import freeze

_METADATA = ("brand_sku_id", "label", "brandLabel", "category", "brand_phonetic")


def _complete(requests: DataFrame, embedder) -> DataFrame:
    """Requests with every column a search needs; a value that a request does not
    name is filled in, row by row."""
    requests = with_search_defaults(requests, DEFAULT_K, DEFAULT_POOL, DEFAULT_BOOST)
    if "qvec" not in requests.columns:
        # Measured, fetched or joined later: the model must not run each time.
        requests = freeze(embed_table(requests, "q", embedder, "qvec"), "requests")
    filters = [name for name in ("filters",) if name in requests.columns]
    return requests.select("query_id", "q", "k", "pool", "boost", "qvec", *filters)


def _as_computed(requests: DataFrame, batch: RequestBatch) -> DataFrame:
    """Requests without vectors; those that arrived with the measurement are not
    computed again."""
    plain = requests.drop("qvec")
    if batch.rows is None:
        return plain
    rows = batch.rows.drop_columns(["qvec", "pool_limit"])
    return requests.sparkSession.createDataFrame(rows, plain.schema)


def _ranked(
    requests: DataFrame, index: DataFrame, batch: RequestBatch, limit_bytes: int, phonetic: PhoneticEncoder
) -> DataFrame:
    candidates = knn_candidates(requests, index.select("row_id", "embedding"), batch, limit_bytes)
    # The pool is far smaller than the catalog: only its rows' metadata is read on.
    pool = attach_lookup(candidates.drop("rank"), index.select("row_id", *_METADATA))
    asked = _as_computed(requests, batch)
    wanted = asked.select("query_id", "k", "boost", query_codes(F.col("q"), phonetic).alias("codes"))
    return phonetic_rerank(pool, wanted, spread=batch.max_limit > WIDE_POOL)


def ranked_pool(
    requests: DataFrame, index: DataFrame, embedder=None, limit_bytes: int = BATCH_LIMIT_BYTES,
    phonetic: PhoneticEncoder = METAPHONE,
) -> DataFrame:
    """Candidate pool of every request with distance, boosted score and rank."""
    requests = _complete(requests, embedder)
    return _ranked(requests, index, measure_batch(requests, limit_bytes), limit_bytes, phonetic)


def hybrid_search(
    requests: DataFrame, index: DataFrame, embedder=None, limit_bytes: int = BATCH_LIMIT_BYTES,
    phonetic: PhoneticEncoder = METAPHONE,
) -> DataFrame:
    """Nearest rows, phonetic boost, best ``k`` of every request.

    ``requests``: ``query_id, q`` and optionally ``k, pool, boost, qvec``;
    ``index``: see ``build_catalog_index``, built with the same ``phonetic`` encoder. A
    single search is a batch of one.
    """
    return best_k(ranked_pool(requests, index, embedder, limit_bytes, phonetic))


def search_with_facets(
    requests: DataFrame,
    index: DataFrame,
    skus: DataFrame,
    facets: DataFrame,
    embedder=None,
    limit_bytes: int = BATCH_LIMIT_BYTES,
    phonetic: PhoneticEncoder = METAPHONE,
    facet_index: FacetIndex | None = None,
) -> DataFrame:
    """Hybrid search whose hits are then narrowed by the request's filters.

    Filters apply after the best ``k`` are taken, so fewer may remain. The hits
    are written once and then filtered; the batch bounds their number, which
    decides whether they may be broadcast. With a ``facet_index`` filters are answered
    from it.
    """
    requests = _complete(with_search_defaults(requests), embedder)
    batch = measure_batch(requests, limit_bytes)
    hits = freeze(best_k(_ranked(requests, index, batch, limit_bytes, phonetic)), "hits")
    asked = _as_computed(requests, batch)
    return filter_hits(hits, asked, skus, facets, batch.result_bytes <= limit_bytes, facet_index)


def facets_for_hits(
    hits: DataFrame,
    skus: DataFrame,
    facets: DataFrame,
    keys: DataFrame | None = None,
    only_active: bool | str = False,
    spread: bool = True,
    small_hits: bool = False,
) -> DataFrame:
    """Ordered facet options of hit lists. Computed over the lists as given;
    the filters of a request play no part here. ``spread=False`` is for lists that
    a search's ``k`` bounds."""
    rows = facet_rows(hits, facets, keys, only_active, small_hits)
    return facet_options(rows, price_range_facets(hits, skus, small_hits), spread)
