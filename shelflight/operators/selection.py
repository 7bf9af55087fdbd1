"""Nearest rows for pools of any width, without a list or a task that holds a pool.

1. Each task counts its distances in a histogram of fine buckets. Buckets are the first
   bits of the distance itself, so their order is the order of distances and no range
   has to be known beforehand. Counts are added up and each request's cut is the bucket
   that holds its last wanted row.
2. A second scan passes on the rows up to the cut, batch by batch.
3. A range sort spreads each request's rows over tasks and numbers them.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.operators.ranking import spread_row_number
from shelflight.sources.sinks import freeze

# Tasks get this module by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bits of a distance left out of its bucket: 256 buckets for each doubling.
FINE_BITS = 44
# Distances measured at once.
TILE = 1 << 20


def buckets(dist: np.ndarray) -> np.ndarray:
    """Bucket numbers in the order of the distances; NaN is last."""
    return np.abs(dist).view(np.int64) >> FINE_BITS


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, added in element order, of every query and row."""
    made = np.zeros((len(queries), len(rows)))
    for i in range(queries.shape[1]):
        gap = queries[:, i, None] - rows[None, :, i]
        made += gap * gap
    return made


def _tiles(queries: np.ndarray, batch: pa.RecordBatch, matrix):
    """(first query, row ids, distances) of the tiles of a batch."""
    if not batch.num_rows:
        return
    rows = matrix(batch.column(1), queries.shape[1]).astype(np.float64)
    ids = batch.column(0).to_numpy()
    step = max(1, TILE // max(len(rows), 1))
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(queries), step):
            yield at, ids, _distances(queries[at:at + step], rows)


_COUNTS = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])


def _histogram(catalog: DataFrame, shipped, matrix) -> DataFrame:
    """``query, bucket, n``: how many rows lie in each bucket of distances."""
    arrow = to_arrow_schema(_COUNTS)

    def count(batches):
        queries = shipped.value[2]
        for batch in batches:
            for at, _, dist in _tiles(queries, batch, matrix):
                key = (np.arange(at, at + len(dist))[:, None] << 20) | buckets(dist)
                found, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((found >> 20).astype(np.int32)), pa.array(found & 0xFFFFF), pa.array(n)], schema=arrow
                )

    partial = catalog.mapInArrow(count, _COUNTS)
    return partial.groupBy("query", "bucket").agg(F.sum("n").alias("n"))


def _cuts(counts: DataFrame, limits: np.ndarray) -> np.ndarray:
    """The last bucket that each query reads; a query with fewer rows reads them all."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame(list(enumerate(limits.tolist())), "query int, wanted long")
    so_far = Window.partitionBy("query").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).join(F.broadcast(wanted), "query")
    last = reached.where("before < wanted").groupBy("query").agg(F.max("bucket").alias("bucket")).toArrow()
    cuts = np.full(len(limits), -1, np.int64)
    cuts[last["query"].to_numpy()] = last["bucket"].to_numpy()
    return cuts


def _rows_up_to(catalog: DataFrame, shipped, cuts: np.ndarray, schema: T.StructType, matrix) -> DataFrame:
    """``query_id, pool_limit, row_id, dist`` of the rows within each query's cut."""
    arrow = to_arrow_schema(schema)

    def scan(batches):
        query_ids, limits, queries, _ = shipped.value
        for batch in batches:
            for at, ids, dist in _tiles(queries, batch, matrix):
                query, row = np.nonzero(buckets(dist) <= cuts[at:at + len(dist), None])
                for a in range(0, len(query), 1 << 16):
                    some = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([
                        query_ids.take(pa.array(query[some] + at)), pa.array(limits[query[some] + at].astype(np.int32)),
                        pa.array(ids[row[some]]), pa.array(dist[query[some], row[some]]),
                    ], schema=arrow)

    return catalog.mapInArrow(scan, schema)


def wide_candidates(
    asked: DataFrame, catalog: DataFrame, dim: int, block_requests: int, schema: T.StructType, ship, matrix
) -> DataFrame:
    """``query_id, rank, row_id, dist`` of requests (``query_id, pool_limit, qvec``) whose
    pools are too wide to be kept in lists. ``block_requests`` vectors are shipped at once."""
    numbered = freeze(asked, "wide-requests")
    blocks = max(1, math.ceil(numbered.count() / block_requests))
    parts = []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
        table = numbered.where(mine).toArrow()
        if not table.num_rows:
            continue
        shipped = ship(table)
        cuts = _cuts(_histogram(catalog, shipped, matrix), shipped.value[1])
        parts.append(freeze(_rows_up_to(catalog, shipped, cuts, schema, matrix), "wide-pools"))
        shipped.unpersist()
    if not parts:
        return numbered.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0)).select(
            "query_id", "rank", "row_id", "dist"
        )
    rows = reduce(DataFrame.unionByName, parts)
    ranked = spread_row_number(rows, ["query_id"], [F.col("dist"), F.col("row_id")], "rank")
    return ranked.where(F.col("rank") <= F.col("pool_limit")).select("query_id", "rank", "row_id", "dist")
