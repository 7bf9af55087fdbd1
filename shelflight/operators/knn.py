"""Exact k-nearest-neighbour join of a request batch with a catalog.

The pairwise work is a theta join, so Spark only ever sees its outcome: each
task streams its share of the catalog as Arrow batches past the request
vectors and keeps the running nearest rows of every request. A task emits at
most ``limit`` rows per request; no pair table exists anywhere.

The catalog is never shuffled. The measured batch is cut in blocks of at most
``BATCH_LIMIT_BYTES``; a block is shipped to every task, and the catalog is
scanned in place once for each block. With several blocks, a first look at the
start of some partitions bounds each request's list, and each block's lists are
merged and written before the next block is shipped, so the driver holds one
block at a time.

The partial lists are merged in two steps. Requests whose lists would be too long for
that are answered by distributed selection (``selection``).
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.operators.selection import wide_candidates
from shelflight.settings import BATCH_LIMIT_BYTES, MERGE_FANIN, WIDE_POOL
from shelflight.sources.sinks import freeze

# Tasks get this module by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# The largest number of rows that a request may ask for.
MAX_LIMIT = 2**31 - 1
# Partitions and rows of each that the first look takes.
FIRST_PARTITIONS = 64
FIRST_ROWS = 65_536


@dataclass(frozen=True)
class RequestBatch:
    """A measured request batch; ``rows`` holds it when it is small."""

    requests: int
    dim: int
    total_limit: int
    max_limit: int
    other_bytes: int = 0
    id_bytes: int = 0
    rows: pa.Table | None = None

    @property
    def footprint(self) -> int:
        """Bytes a task holds: vectors in double and single precision, twice the
        running lists, and everything else the requests carry."""
        return self.requests * (12 * self.dim + 64) + self.total_limit * 48 + self.other_bytes

    @property
    def result_bytes(self) -> int:
        """Upper bound of the candidate table, known before it is computed."""
        return self.total_limit * (64 + self.id_bytes)


def pool_limit():
    """Rows pulled per request: the larger of ``pool`` and ``k``."""
    return F.greatest(F.col("pool").cast("long"), F.col("k").cast("long"), F.lit(0).cast("long"))


def measure_batch(requests: DataFrame, limit_bytes: int = BATCH_LIMIT_BYTES) -> RequestBatch:
    """Size of the batch, from one small aggregate; rejects missing vectors,
    unequal lengths, repeated ids and limits beyond 2^31 - 1. A batch within ``limit_bytes`` is fetched as well; it is
    kept between the two steps, so that it is computed once."""
    asked = requests.withColumn("pool_limit", pool_limit()).persist()
    try:
        return _measured(asked, limit_bytes)
    finally:
        asked.unpersist()


def _measured(asked: DataFrame, limit_bytes: int) -> RequestBatch:
    size = F.size("qvec")
    carried = F.struct(*[name for name in asked.columns if name != "qvec"])
    row = asked.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("qvec").alias("vectors"),
        F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
        F.count_distinct(F.struct("query_id")).alias("ids"),
        F.max(F.octet_length(F.col("query_id").cast("string"))).alias("id_bytes"),
        F.sum("pool_limit").alias("total"),
        F.max("pool_limit").alias("widest"),
        F.sum(F.octet_length(F.to_json(carried)).cast("long")).alias("carried"),
    ).first()
    if row.n and (row.vectors != row.n or row.shortest != row.longest):
        raise ValueError("request vectors are missing or differ in length")
    if row.ids != row.n:
        raise ValueError("query_id is repeated within the batch")
    if (row.widest or 0) > MAX_LIMIT:
        raise ValueError(f"k or pool is above {MAX_LIMIT}")
    batch = RequestBatch(
        row.n, row.longest or 0, row.total or 0, row.widest or 0, row.carried or 0, row.id_bytes or 0
    )
    if batch.footprint > limit_bytes:
        return batch
    return replace(batch, rows=asked.toArrow())


class NearestRows:
    """Running nearest rows of a block of queries, exact and in bounded memory.

    Matrix products give approximate distances for a whole batch; rows within
    the rounding error of a query's current bound are then measured again by
    summing squared differences in element order, which is what decides.
    """

    def __init__(self, vectors, limits, bound=None, tile_cells=1_000_000, buffer_rows=262_144):
        self.queries = np.ascontiguousarray(vectors, dtype=np.float64)
        self.limits = np.asarray(limits, dtype=np.int64)
        self.norms = np.einsum("ij,ij->i", self.queries, self.queries)
        ones = np.ones((len(self.queries), 1))
        wide = np.hstack([-2.0 * self.queries, ones])
        with np.errstate(over="ignore"):
            self.doubled = {np.float64: wide, np.float32: wide.astype(np.float32)}
        self.bound = np.where(self.limits > 0, np.inf if bound is None else bound, -np.inf)
        self.tile_cells = tile_cells
        self.buffer_rows = buffer_rows
        empty = np.empty(0, dtype=np.int64)
        self.kept = (empty, np.empty(0), empty)
        self.fresh = []
        self.fresh_rows = 0

    def offer(self, ids, vectors):
        rows = np.asarray(vectors, dtype=np.float64)
        norms = np.einsum("ij,ij->i", rows, rows)
        largest = max(np.nanmax(norms, initial=0.0), np.nanmax(self.norms, initial=0.0))
        # Single precision is enough to discard; double where it could overflow.
        kind = np.float32 if largest < 1e30 else np.float64
        # One product gives |row|^2 - 2 query.row, the distance less |query|^2.
        left = self.doubled[kind]
        right = np.vstack([rows.T, norms]).astype(kind)
        error = 4 * (rows.shape[1] + 8) * np.finfo(kind).eps
        step = max(1, self.tile_cells // len(rows))
        for start in range(0, len(left), step):
            tile = slice(start, start + step)
            with np.errstate(invalid="ignore", over="ignore"):
                near = left[tile] @ right
            slack = error * (self.norms[tile] + largest)
            self._bound_from(near, slack, start)
            # "not greater" rather than "less": a NaN distance ranks last but stays.
            reach = (self.bound[tile] + slack - self.norms[tile]).astype(kind)
            cells = np.flatnonzero(~(near > reach[:, None]))
            if len(cells):
                query, row = np.divmod(cells, len(rows))
                query += start
                self.fresh.append((query, self._measure(query, row, rows), ids[row]))
                self.fresh_rows += len(query)
        if self.fresh_rows > max(self.buffer_rows, len(self.kept[0])):
            self._merge()

    def _bound_from(self, near, slack, start):
        """First bound of queries that have none: their limit-th best of this batch."""
        open_rows = np.flatnonzero(np.isposinf(self.bound[start:start + len(near)]))
        for limit in np.unique(self.limits[start + open_rows]):
            if limit > near.shape[1]:
                continue
            chosen = open_rows[self.limits[start + open_rows] == limit]
            nth = np.partition(near[chosen], limit - 1, axis=1)[:, limit - 1]
            bound = nth + self.norms[start + chosen] + slack[chosen]
            self.bound[start + chosen] = np.where(np.isnan(bound), np.inf, bound)

    def _measure(self, query, row, rows, chunk=65_536):
        parts = []
        for start in range(0, len(query), chunk):
            part = slice(start, start + chunk)
            with np.errstate(invalid="ignore"):
                gap = self.queries[query[part]] - rows[row[part]]
                gap *= gap
                # cumsum adds strictly left to right, unlike sum
                parts.append(np.cumsum(gap, axis=1)[:, -1] if gap.shape[1] else np.zeros(len(gap)))
        return np.concatenate(parts)

    def _merge(self):
        pieces = [self.kept, *self.fresh]
        query, dist, ids = (np.concatenate([piece[i] for piece in pieces]) for i in range(3))
        self.fresh, self.fresh_rows = [], 0
        order = np.lexsort((ids, dist, query))
        query, dist, ids = query[order], dist[order], ids[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        limit = self.limits[query]
        last = place == limit - 1
        self.bound[query[last]] = np.fmin(self.bound[query[last]], dist[last])
        keep = place < limit
        self.kept = (query[keep], dist[keep], ids[keep])

    def result(self):
        self._merge()
        return self.kept


def _matrix(vectors, dim):
    """Arrow list column -> (rows, dim) array; refuses missing or odd vectors."""
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    flat = vectors.flatten()
    if lengths != [dim] or flat.null_count:
        raise ValueError(f"expected vectors of length {dim} without nulls, got lengths {lengths}")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _column(table, name):
    """A table column as one array."""
    return pa.concat_arrays(table.column(name).chunks)


def _emit(nearest, query_ids, limits, schema, rows=65_536):
    query, dist, ids = nearest.result()
    for start in range(0, len(query), rows):
        part = slice(start, start + rows)
        yield pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(query[part])),
                pa.array(limits[query[part]].astype(np.int32)),
                pa.array(ids[part]),
                pa.array(dist[part]),
            ],
            schema=schema,
        )


def _result_types(requests: DataFrame):
    id_type = requests.schema["query_id"].dataType
    spark_schema = (
        T.StructType()
        .add("query_id", id_type)
        .add("pool_limit", T.IntegerType())
        .add("row_id", T.LongType())
        .add("dist", T.DoubleType())
    )
    return spark_schema, to_arrow_schema(spark_schema)


def _scan_in_place(catalog, spark_schema, shipped, dim):
    """Partial lists of one shipped block; the catalog is scanned where it lies."""
    arrow_schema = to_arrow_schema(spark_schema)

    def scan(batches):
        query_ids, limits, vectors, bound = shipped.value
        nearest = NearestRows(vectors, limits, bound)
        for part in batches:
            if part.num_rows:
                nearest.offer(part.column(0).to_numpy(), _matrix(part.column(1), dim))
        yield from _emit(nearest, query_ids, limits, arrow_schema)

    return catalog.mapInArrow(scan, spark_schema)


def _first_bounds(catalog, shipped, dim, queries):
    """For each request of a block a distance within which ``limit`` rows lie, or
    infinity: the best of what the first rows of some partitions show. It leaves
    out no row that belongs in a list, and rows beyond it are never emitted."""
    fields = T.StructType().add("query", T.IntegerType()).add("bound", T.DoubleType())

    def look(batches):
        if TaskContext.get().partitionId() >= FIRST_PARTITIONS:
            return
        _, limits, vectors, _ = shipped.value
        nearest, seen = NearestRows(vectors, limits), 0
        for part in batches:
            if part.num_rows:
                nearest.offer(part.column(0).to_numpy(), _matrix(part.column(1), dim))
            seen += part.num_rows
            if seen >= FIRST_ROWS:
                break
        query, dist, _ = nearest.result()
        counts = np.bincount(query, minlength=len(limits))
        full = np.flatnonzero((counts == limits) & (limits > 0))
        worst = dist[np.cumsum(counts)[full] - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(worst)], schema=to_arrow_schema(fields)
        )

    found = catalog.mapInArrow(look, fields).groupBy("query").agg(F.min("bound").alias("bound")).toArrow()
    bound = np.full(queries, np.inf)
    bound[found["query"].to_numpy()] = found["bound"].to_numpy()
    return np.where(np.isnan(bound), np.inf, bound)


def _merged(partial, max_limit, keep_limit=False):
    """The best rows of each request from its partial lists, in two steps: first in
    MERGE_FANIN lanes, so that one request's lists are never in one task."""
    nearest_first = (F.col("dist"), F.col("row_id"))
    spread = Window.partitionBy("query_id", "_lane").orderBy(*nearest_first)
    final = Window.partitionBy("query_id").orderBy(*nearest_first)
    cut = (F.col("rank") <= max_limit) & (F.col("rank") <= F.col("pool_limit"))
    lanes = partial.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(MERGE_FANIN)))
    first = lanes.withColumn("rank", F.row_number().over(spread)).where(cut)
    return first.withColumn("rank", F.row_number().over(final)).where(cut).select(
        "query_id", "rank", "row_id", "dist", *(["pool_limit"] if keep_limit else [])
    )


def knn_candidates(
    requests: DataFrame,
    catalog: DataFrame,
    batch: RequestBatch | None = None,
    limit_bytes: int = BATCH_LIMIT_BYTES,
    wide_pool: int = WIDE_POOL,
) -> DataFrame:
    """The ``max(pool, k)`` nearest catalog rows of every request.

    ``requests``: ``query_id, k, pool, qvec``; ``catalog``: ``row_id, embedding``.
    Returns ``query_id, rank, row_id, dist`` with ties broken by ``row_id``. The
    distance is the squared L2 distance in DOUBLE. Requests for more than ``wide_pool``
    rows are answered by ``wide_candidates``: no task holds or sorts one's whole pool.
    """
    asked = requests.select("query_id", "k", "pool", "qvec")
    batch = batch or measure_batch(asked, limit_bytes)
    if batch.max_limit > wide_pool:
        return _with_wide_pools(asked, catalog, batch, limit_bytes, wide_pool)
    spark = catalog.sparkSession
    spark_schema, arrow_schema = _result_types(requests)
    vectors = catalog.select(F.col("row_id").cast("long"), "embedding")

    def ship(table, bound=None):
        ids = _column(table, "query_id").cast(arrow_schema.field(0).type)
        limits = _column(table, "pool_limit").to_numpy().astype(np.int64)
        return spark.sparkContext.broadcast((ids, limits, _matrix(_column(table, "qvec"), batch.dim), bound))

    if batch.requests == 0:
        return spark.createDataFrame([], "query_id string, rank int, row_id bigint, dist double").withColumn(
            "query_id", F.col("query_id").cast(requests.schema["query_id"].dataType)
        )
    if batch.rows is not None:
        candidates = _merged(_scan_in_place(vectors, spark_schema, ship(batch.rows), batch.dim), batch.max_limit)
    else:
        blocks = math.ceil(batch.footprint / limit_bytes)
        numbered = freeze(
            asked.withColumns({
                "pool_limit": pool_limit(), "_block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"),
            }), "request-blocks",
        )
        parts = []
        for block in range(blocks):
            table = numbered.where(F.col("_block") == block).toArrow()
            if not table.num_rows:
                continue
            first = ship(table)
            bound = _first_bounds(vectors, first, batch.dim, table.num_rows)
            first.unpersist()
            shipped = ship(table, bound)
            partial = _scan_in_place(vectors, spark_schema, shipped, batch.dim)
            parts.append(freeze(_merged(partial, batch.max_limit), "block-lists"))
            shipped.unpersist()
        candidates = reduce(DataFrame.unionByName, parts)
    # Its size is known from the batch, so a later join may broadcast it.
    return F.broadcast(candidates) if batch.result_bytes <= limit_bytes else candidates


def _with_wide_pools(
    asked: DataFrame, catalog: DataFrame, batch: RequestBatch, limit_bytes: int, wide_pool: int
) -> DataFrame:
    """Requests within ``wide_pool`` rows by lists, the others by selection."""
    spark = catalog.sparkSession
    asked = freeze(asked, "requests")
    wide = asked.where(pool_limit() > wide_pool).withColumn("pool_limit", pool_limit())
    narrow = knn_candidates(asked.where(pool_limit() <= wide_pool), catalog, None, limit_bytes, wide_pool)
    schema, arrow_schema = _result_types(asked)

    def ship(table):
        ids = _column(table, "query_id").cast(arrow_schema.field(0).type)
        limits = _column(table, "pool_limit").to_numpy().astype(np.int64)
        queries = _matrix(_column(table, "qvec"), batch.dim).astype(np.float64)
        return spark.sparkContext.broadcast((ids, limits, queries, None))

    at_once = max(1, limit_bytes // (16 * batch.dim + 64))
    vectors = catalog.select(F.col("row_id").cast("long"), "embedding")
    found = wide_candidates(wide, vectors, batch.dim, at_once, schema, ship, _matrix)
    return narrow.unionByName(found)


def attach_lookup(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """Metadata of each candidate, by key instead of by position."""
    return candidates.join(lookup, "row_id")
