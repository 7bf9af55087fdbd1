"""Exact nearest neighbours on an index in cells, of which whole files stay unread.

The index is written in one folder for each cell: the rows nearest to the cell's centre.
A cell's radius is the distance of its farthest row, so by the triangle inequality no row
of it is nearer to a query than the query's distance to the centre less the radius.

1. Centres and radii bound each request's last distance from above, and cells from below.
2. The most promising cells of each request are read first; the distances found bound the
   request's list more tightly.
3. Of all other cells those are read that may hold a nearer row for some request. What is
   left out is left out as files, by the scan's partition filter.

Requests whose best cells are neighbours share a block, so a block reads few cells. Where
vectors have no structure, every cell is read once, as without cells. Rows whose vectors
hold NaN or infinity are in a cell of their own that is always read.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelflight.operators.knn import (
    RequestBatch, _column, _matrix, _merged, _result_types, _scan_in_place, measure_batch, pool_limit,
)
from shelflight.settings import BATCH_LIMIT_BYTES
from shelflight.sources.sinks import freeze

# Tasks get this module by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of an index, at most, and rows of a cell, about, where more would fit.
MOST_CELLS, CELL_ROWS = 1024, 10_000
# Rows for each cell that the centres are fitted on (a bounded sample), and its rounds.
FITTED_ROWS, ROUNDS = 32, 8
# Distances to centres that are held at once.
GAPS_AT_ONCE = 1 << 20
# The cell of rows that have no distance.
ODD = -1
# Relative room for rounding in bounds.
SLACK = 1e-9


@dataclass(frozen=True)
class CellIndex:
    """``vectors``: ``cell, row_id, embedding``, partitioned by ``cell``; the cells' numbers,
    centres, radii and rows (bounded by MOST_CELLS, so they are held)."""

    vectors: DataFrame
    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``, in double precision."""
    made = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        made += gap * gap
    return np.sqrt(made)


def _slices(rows: int, cells: int):
    """Slices of so many rows that their distances to all cells fit GAPS_AT_ONCE."""
    step = max(1, GAPS_AT_ONCE // max(cells, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a nearest centre, the distance to it) of each row. Matrix products choose the
    centre, up to their rounding; the distance is measured on the vectors."""
    norms = np.einsum("ij,ij->i", centres, centres)
    cell, apart = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    for part in _slices(len(rows), len(centres)):
        with np.errstate(invalid="ignore", over="ignore"):
            near = norms - 2.0 * (rows[part] @ centres.T)
            near[np.isnan(near)] = np.inf
            cell[part] = near.argmin(axis=1)
            gap = rows[part] - centres[cell[part]]
            apart[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return cell, apart


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample: spread first rows, then means of the nearest rows."""
    order = np.random.default_rng(20).permutation(len(sample))
    centres = sample[order[:cells]].copy()
    for _ in range(ROUNDS):
        nearest, _ = _nearest(sample, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        for i in range(sample.shape[1]):
            sums = np.bincount(nearest, weights=sample[:, i], minlength=len(centres))
            centres[:, i] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, i])
    return np.unique(centres, axis=0)


def write_cells(vectors: DataFrame, path: str, cells: int | None = None) -> CellIndex:
    """Write ``row_id, embedding`` below ``path`` in cells and return the index.

    ``cells``: how many are wanted; an index has MOST_CELLS at most, so that the sample,
    the centres and the number of files stay bounded while the cells grow with the table.
    Centres are fitted on a sample of FITTED_ROWS rows for each cell, taken by the hash of
    ``row_id``; every row is assigned to its nearest centre, and radii are those of all
    rows. Vectors must have one length and no null. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col("row_id").cast("long").alias("row_id"), "embedding")
    n = given.count()
    cells = max(1, min(MOST_CELLS, cells or math.ceil(n / CELL_ROWS)))
    wanted = cells * FITTED_ROWS
    share = min(1.0, 2 * wanted / max(n, 1))
    taken = given.where(F.pmod(F.xxhash64("row_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else given
    table = taken.select("embedding").limit(wanted).toArrow()
    dim = len(table["embedding"][0]) if table.num_rows else 0
    sample = _matrix(_column(table, "embedding"), dim).astype(np.float64) if table.num_rows else np.zeros((0, 0))
    sample = sample[np.isfinite(sample).all(axis=1)]
    centres = _fit(sample, cells) if len(sample) else np.zeros((0, dim))
    sent = spark.sparkContext.broadcast(centres)
    schema = T.StructType([
        T.StructField("row_id", T.LongType()), given.schema["embedding"],
        T.StructField("cell", T.IntegerType()), T.StructField("apart", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def assign(batches):
        middle = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1), dim).astype(np.float64)
            cell, apart = np.full(len(rows), ODD, np.int32), np.full(len(rows), np.inf)
            fine = np.flatnonzero(np.isfinite(rows).all(axis=1))
            if len(middle):
                cell[fine], apart[fine] = _nearest(rows[fine], middle)
            cell[~np.isfinite(apart)] = ODD
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1).cast(arrow[1].type), pa.array(cell), pa.array(apart),
            ], schema=arrow)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Small cells are in a file or two; a large one is spread over tasks.
    dealt = given.mapInArrow(assign, schema).repartitionByRange(parts, "cell", "row_id")
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    sent.unpersist()
    bounds = _read_vectors(spark, path, given.schema["embedding"].dataType, apart=True).groupBy("cell").agg(
        F.max("apart").alias("radius"), F.count(F.lit(1)).alias("rows")
    ).where(F.col("cell") != ODD)
    places = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>"
    )
    bounds.join(F.broadcast(places), "cell").write.parquet(f"{path}/cells")
    return read_cells(spark, path, given.schema["embedding"].dataType)


def _read_vectors(spark: SparkSession, path: str, kind: T.DataType, apart: bool = False) -> DataFrame:
    fields = [T.StructField("row_id", T.LongType()), T.StructField("embedding", kind)]
    fields += [T.StructField("apart", T.DoubleType())] if apart else []
    return spark.read.schema(T.StructType([*fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/vectors")


def read_cells(spark: SparkSession, path: str, kind: T.DataType | None = None) -> CellIndex:
    """The index that ``write_cells`` left at ``path``."""
    cells = spark.read.schema("cell int, radius double, rows long, centre array<double>").parquet(f"{path}/cells")
    rows = cells.orderBy("cell").toArrow()
    numbers = rows["cell"].to_numpy().astype(np.int64)
    dim = len(rows["centre"][0]) if rows.num_rows else 0
    centres = _matrix(_column(rows, "centre"), dim) if rows.num_rows else np.zeros((0, 0))
    vectors = _read_vectors(spark, path, kind or T.ArrayType(T.FloatType()))
    return CellIndex(vectors, numbers, centres, rows["radius"].to_numpy(), rows["rows"].to_numpy())


def _within(index: CellIndex, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance of each query to the rows of each cell."""
    with np.errstate(invalid="ignore", over="ignore"):
        gaps = _gaps(queries, index.centres)
        room = SLACK * (gaps + index.radii + 1e-30)
        least = np.maximum(gaps - index.radii - room, 0.0)
        greatest = gaps + index.radii + room
    odd = ~np.isfinite(queries).all(axis=1)
    least[odd] = 0.0
    greatest[odd] = np.inf
    return np.nan_to_num(least, nan=0.0, posinf=0.0), np.nan_to_num(greatest, nan=np.inf, posinf=np.inf)


def _first_cells(index: CellIndex, least, greatest, limits) -> tuple[np.ndarray, np.ndarray]:
    """(distance that each request's list surely stays within, mask of the cells that the
    requests should look at first)."""
    order = np.argsort(greatest, axis=1, kind="stable")
    held = np.cumsum(index.rows[order], axis=1)
    full = held >= np.maximum(limits, 1)[:, None]
    last = np.where(full.any(axis=1), full.argmax(axis=1), -1)
    reach = np.where(last >= 0, np.take_along_axis(greatest, np.take_along_axis(order, np.maximum(last, 0)[:, None], 1), 1)[:, 0], np.inf)
    first = np.zeros(len(index.numbers), bool)
    near = np.argsort(least + greatest, axis=1, kind="stable")
    needed = (np.cumsum(index.rows[near], axis=1) >= np.maximum(limits, 1)[:, None]).argmax(axis=1)
    for row, count in zip(near, needed):
        first[row[:min(count, 3) + 1]] = True
    return reach, first


def _found_within(lists: DataFrame, ids: pa.Array, limits: np.ndarray) -> np.ndarray:
    """The last squared distance of each request's list, infinity if it is not full."""
    best = _merged(lists, int(limits.max(initial=0)), keep_limit=True).where(F.col("rank") == F.col("pool_limit"))
    rows = best.select("query_id", "dist").toArrow()
    place = {name: i for i, name in enumerate(ids.to_pylist())}
    bound = np.full(len(ids), np.inf)
    for name, dist in zip(rows["query_id"].to_pylist(), rows["dist"].to_pylist()):
        bound[place[name]] = np.inf if math.isnan(dist) else dist
    return bound


def knn_in_cells(
    requests: DataFrame, index: CellIndex, batch: RequestBatch | None = None,
    limit_bytes: int = BATCH_LIMIT_BYTES, read: list | None = None,
) -> DataFrame:
    """The rows of ``knn_candidates`` from an index in cells.

    ``read``, if given, gets for each block the numbers of the cells that were read.
    """
    asked = requests.select("query_id", "k", "pool", "qvec")
    batch = batch or measure_batch(asked, limit_bytes)
    spark = index.vectors.sparkSession
    schema, arrow_schema = _result_types(requests)
    empty = spark.createDataFrame([], schema).withColumn("rank", F.lit(0)).select("query_id", "rank", "row_id", "dist")
    if batch.requests == 0:
        return empty
    blocks = math.ceil(batch.footprint / limit_bytes)
    numbered = freeze(asked.withColumns({"pool_limit": pool_limit(), "_home": _home(spark, index)}), "cell-requests")
    if blocks > 1:
        parts = numbered.repartitionByRange(blocks, "_home", "query_id")
        numbered = freeze(parts.withColumn("_block", F.spark_partition_id()), "cell-blocks")
    made = []
    for block in range(blocks):
        table = (numbered.where(F.col("_block") == block) if blocks > 1 else numbered).toArrow()
        if table.num_rows:
            made.append(_block_lists(index, table, batch, schema, arrow_schema, read))
    candidates = reduce(DataFrame.unionByName, made) if made else empty
    return F.broadcast(candidates) if batch.result_bytes <= limit_bytes else candidates


def _home(spark: SparkSession, index: CellIndex):
    """The centre nearest to a request; what orders requests into blocks."""
    if not len(index.numbers):
        return F.lit(0)
    sent = spark.sparkContext.broadcast(index.centres)

    @F.pandas_udf("int")
    def nearest(vectors):
        import pandas as pd

        rows = np.vstack(vectors.to_list()).astype(np.float64)
        return pd.Series(_nearest(rows, sent.value)[0])

    return nearest("qvec")


def _block_lists(index: CellIndex, table: pa.Table, batch: RequestBatch, schema, arrow_schema, read) -> DataFrame:
    """Merged lists of one block of requests."""
    spark = index.vectors.sparkSession
    ids = _column(table, "query_id").cast(arrow_schema.field(0).type)
    limits = _column(table, "pool_limit").to_numpy().astype(np.int64)
    queries = _matrix(_column(table, "qvec"), batch.dim)
    wide = queries.astype(np.float64)
    reach, first = np.full(len(ids), np.inf), np.zeros(len(index.numbers), bool)
    parts = [*_slices(len(ids), len(index.numbers))] if len(index.numbers) else []
    for part in parts:
        reach[part], promising = _first_cells(index, *_within(index, wide[part]), limits[part])
        first |= promising

    def scan(cells: np.ndarray, bound: np.ndarray) -> DataFrame:
        shipped = spark.sparkContext.broadcast((ids, limits, queries, bound))
        chosen = index.vectors.where(F.col("cell").isin([*map(int, cells)])).select("row_id", "embedding")
        lists = freeze(_scan_in_place(chosen, schema, shipped, batch.dim), "cell-lists")
        shipped.unpersist()
        return lists

    with np.errstate(over="ignore"):
        before = reach * reach * (1 + SLACK)
    lists = scan(np.append(index.numbers[first], ODD), before)
    bound = np.minimum(_found_within(lists, ids, limits), before)
    rest = np.zeros(len(index.numbers), bool)
    for part in parts:
        least, _ = _within(index, wide[part])
        open_ = (least * least * (1 - SLACK) <= bound[part, None]) & (limits[part] > 0)[:, None]
        rest |= open_.any(axis=0) & ~first
    if rest.any():
        lists = lists.unionByName(scan(index.numbers[rest], bound))
    if read is not None:
        read.append(sorted(index.numbers[first | rest].tolist()))
    return freeze(_merged(lists, batch.max_limit), "block-lists")
